"""Entries: schemas, limits, and the conversions between Python values, bytes and columns.

An entry is (key BINARY NOT NULL, value BINARY); a NULL value is a tombstone, empty bytes are a live value.
Keys are ordered as unsigned bytes, which is how Spark compares BINARY.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_KEY = 65_535
MAX_VALUE = 2**31 - 1
ENTRY = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), True)])
LOG = T.StructType([*ENTRY.fields, T.StructField("seq", T.LongType(), False), T.StructField("ord", T.LongType(), False)])


def to_bytes(x: str | bytes | bytearray | memoryview) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def check_entry(key: bytes, value: bytes | None) -> None:
    if len(key) > MAX_KEY:
        raise ValueError(f"a key has {len(key)} bytes; {MAX_KEY} are allowed")
    if value is not None and len(value) > MAX_VALUE:
        raise ValueError(f"a value has {len(value)} bytes; {MAX_VALUE} are allowed")


def pairs_of(data: Mapping | Iterable) -> list[tuple[bytes, bytes | None]]:
    """Pairs, ``{"key":, "value":}`` entries or a mapping, in order; strings become UTF-8."""
    rows = data.items() if isinstance(data, Mapping) else ((e["key"], e.get("value")) if isinstance(e, Mapping) else tuple(e) for e in data)
    out = [(to_bytes(k), None if v is None else to_bytes(v)) for k, v in rows]
    for k, v in out:
        check_entry(k, v)
    return out


def entries(spark: SparkSession, data: DataFrame | Mapping | Iterable) -> DataFrame:
    """(key, value, ord) of anything ``pairs_of`` takes, or of a DataFrame with key, value and perhaps ord, which is null without."""
    if isinstance(data, DataFrame):
        order = F.col("ord").cast("long") if "ord" in data.columns else F.lit(None).cast("long")
        return data.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), order.alias("ord"))
    rows = [(bytearray(k), None if v is None else bytearray(v), i) for i, (k, v) in enumerate(pairs_of(data))]
    return spark.createDataFrame(rows, T.StructType([*ENTRY.fields, T.StructField("ord", T.LongType(), False)]))


def validated(df: DataFrame) -> DataFrame:
    """``df``, failing when it runs on a null or oversized key."""
    ok = F.when(F.col("key").isNull(), F.raise_error(F.lit("a key is null"))).when(F.length("key") > MAX_KEY, F.raise_error(F.lit(f"a key has more than {MAX_KEY} bytes"))).otherwise(F.col("key"))
    return df.withColumn("key", ok)


def utf8(value: Column) -> Column:
    """Bytes as text; NULL where they are no valid UTF-8."""
    return F.try_validate_utf8(value.cast("string"))


def json_of(value: Column) -> Column:
    """Bytes as VARIANT where their text begins with { or [ and parses; NULL else. A byte-order mark is skipped."""
    text = F.regexp_replace(utf8(value), "^﻿", "")
    return F.when(F.substring(text, 1, 1).isin("{", "["), F.try_parse_json(text))


def decoded(df: DataFrame) -> DataFrame:
    """``df`` (key, value) with the columns ``text`` and ``json``: the three ways to read a value."""
    return df.withColumn("text", utf8(F.col("value"))).withColumn("json", json_of(F.col("value")))


def encode_value(x: object) -> bytes:
    if isinstance(x, (str, bytes, bytearray, memoryview)):
        return to_bytes(x)
    return json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()


def decode_value(raw: bytes | None) -> object:
    """Text, parsed JSON if it begins with { or [, or the bytes if they are no UTF-8."""
    if raw is None:
        return None
    try:
        text = bytes(raw).decode().removeprefix("﻿")
    except UnicodeDecodeError:
        return bytes(raw)
    if text[:1] in ("{", "["):
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def padded(number: Column, width: int) -> Column:
    """Numbers as keys that sort by value: decimal, filled with zeros. A negative number, or one of more digits, fails the run."""
    digits = number.cast("string")
    bad = F.raise_error(F.concat(F.lit(f"a number does not fit in {width} digits: "), digits))
    return F.when((number < 0) | (F.length(digits) > width), bad).otherwise(F.lpad(digits, width, "0")).cast("binary")


def big_endian(number: Column) -> Column:
    """Non-negative numbers as eight bytes, greatest first. A negative number fails the run."""
    n = number.cast("long")
    return F.when(n < 0, F.raise_error(F.concat(F.lit("a number is negative: "), n.cast("string")))).otherwise(F.unhex(F.lpad(F.hex(n), 16, "0")))
