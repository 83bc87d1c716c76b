"""Patterns over live views: expiry, counters, chunked values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.model import utf8


def expired(live: DataFrame, now: Column | int, field: str = "$.exp") -> DataFrame:
    """Tombstones (key, NULL) for values whose JSON ``field`` lies before ``now``: put them to purge."""
    when = F.get_json_object(utf8(F.col("value")), field).cast("double")
    return live.filter(when < (F.lit(now) if isinstance(now, int) else now)).select("key", F.lit(None).cast("binary").alias("value"))


def increments(changes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(key, value) after adding ``amount`` by key to the counters of ``live``, which are decimal text."""
    sums = changes.groupBy("key").agg(F.sum("amount").alias("amount"))
    if live is None:
        return sums.select("key", F.col("amount").cast("string").cast("binary").alias("value"))
    old = F.coalesce(F.col("value").cast("string").cast("long"), F.lit(0))
    return sums.join(live, "key", "left").select("key", (old + F.col("amount")).cast("string").cast("binary").alias("value"))


def chunked(blobs: DataFrame, size: int, digits: int = 5) -> DataFrame:
    """(name, value) as entries ``name:00000``, ``name:00001``, ... of at most ``size`` bytes; an empty value is one chunk.
    From chunk 10^digits on the number is longer, so keys stay different, but no longer sort by number."""
    n = F.greatest(F.lit(1), F.ceil(F.length("value") / size)).cast("int")
    rows = blobs.select("name", "value", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    number = F.col("i").cast("string")
    return rows.select(F.concat("name", F.lit(":"), F.lpad(number, F.greatest(F.lit(digits), F.length(number)), F.lit("0"))).cast("binary").alias("key"), F.expr(f"substring(value, i * {size} + 1, {size})").alias("value"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(name, value) from such entries; chunks of a name meet in the order of their numbers, which stand after the last colon.
    Bytes stay as they are, in names and values; only the number is read as text."""
    number = F.substring_index(F.col("key").cast("string"), ":", -1)  # bytes before the last colon are only passed over
    name = F.expr("substring(key, 1, octet_length(key) - octet_length(_number) - 1)")
    cut = chunks.withColumn("_number", number).select(name.cast("string").alias("name"), F.col("_number").cast("int").alias("at"), "value")
    parts = F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("v"))))  # the cast keeps every byte
    return cut.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").cast("binary").alias("value"))
