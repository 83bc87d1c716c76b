"""Sharding by a Hilbert curve over metadata, cut into runs.

Size (logarithm), source and language are quantised to eight bits each; the curve through that cube keeps documents
that are near in all three dimensions near in order, so a shard covers a small box and a reader prunes shards by any
dimension. Equal texts of one source and language have equal cells and are next to each other by their hash.

The law is ``rows``: shard counts are at most one apart, whatever one source or group of copies holds, because the
curve is cut by position and never by key. Texts leave the scan as a size and a checksum; the order is one range
exchange of these narrow rows under a key that ends in the document's id, so ties cannot fill one task.

Defined results: null text has no bytes (size 16, checksum 0); null source and language are cells of their own; rows
equal in every key column are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import importable, lean, ranked, written

BITS = 8


def curve_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below 2**bits (Skilling's transform)."""
    x = [np.array(a, dtype=np.int64) for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(flip, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x = [a ^ turn for a in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | ((a >> b) & 1)
    return out


def with_curve(df: DataFrame, axes: list[str], name: str = "curve") -> DataFrame:
    """``df`` with the curve position of its integer columns ``axes``, each below 2**BITS."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = curve_index([batch.column(a).to_numpy(zero_copy_only=False) for a in axes])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, name])

    return df.mapInArrow(lean(run), df.withColumn(name, F.lit(0).cast("long")).schema)


def shards(docs: DataFrame, n: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, and the three cells) for every row."""
    top = (1 << BITS) - 1
    small = docs.select(
        "doc_id",
        F.expr("coalesce(octet_length(text), 0) + 16L").alias("size"),
        F.expr("crc32(coalesce(text, ''))").alias("text_crc32"),
        F.expr("xxhash64(coalesce(text, ''))").alias("_hash"),
        F.expr(f"cast(least({top}, floor(log2(coalesce(octet_length(text), 0) + 16) * 8)) AS int)").alias("size_cell"),
        F.expr(f"cast(pmod(xxhash64(source, 0), {top + 1}) AS int)").alias("source_cell"),
        F.expr(f"cast(pmod(xxhash64(lang, 1), {top + 1}) AS int)").alias("lang_cell"),
    )
    rows = written(with_curve(small, ["source_cell", "lang_cell", "size_cell"]))
    total = rows.count()
    each, more = divmod(total, n)  # the first ``more`` shards hold one row more
    d = ranked(rows.withColumn("_row_id", F.monotonically_increasing_id()), ["curve", "size", "_hash", "text_crc32", "doc_id", "_row_id"])
    cut = more * (each + 1)
    shard = f"CASE WHEN rank < {cut}L THEN rank DIV {each + 1}L ELSE {more}L + (rank - {cut}L) DIV {max(each, 1)}L END"
    d = d.withColumn("shard", F.expr(f"cast({shard} AS int)"))
    return d.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"CASE WHEN rank < {cut}L THEN rank % {each + 1}L ELSE (rank - {cut}L) % {max(each, 1)}L END").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "source_cell",
        "lang_cell",
        "size_cell",
    )


def boxes(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: for each shard the least and greatest cell of each dimension."""
    cells = ["source_cell", "lang_cell", "size_cell"]
    return sharded.groupBy("shard").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in cells for k, f in (("min", F.min), ("max", F.max))))
