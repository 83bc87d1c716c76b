"""Reader of single-file tables in the older block format, version 6, to bring them into this engine.

A file is a header, checksummed blocks of entries (perhaps compressed), a bloom filter, an index of blocks and a footer.
Spark reads the files as bytes from wherever it can read; each is decoded in one task and fails as a whole if any block does.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format. All numbers are big-endian, but for the length before compressed data.
HEADER_MAGIC, FOOTER_MAGIC, VERSION = 0x58444231, 0x454E4458, 6
HEADER_BYTES, FOOTER_BYTES, TRAILER_BYTES = 32, 40, 8
DELETED, COMPRESSED = 1 << 31, 1


class BadFile(ValueError):
    """A file that is not what its format demands."""


def index_of(data: bytes) -> tuple[list[tuple[int, int, int, int]], int]:
    """((offset, length, restart points, flags) of each block, entries in all)."""
    if len(data) < HEADER_BYTES + FOOTER_BYTES:
        raise BadFile("the file is too short")
    magic, version = struct.unpack_from(">IH", data)
    if magic != HEADER_MAGIC:
        raise BadFile("the file has another magic number")
    if version != VERSION:
        raise BadFile(f"the file has version {version}; {VERSION} is read")
    foot = data[-FOOTER_BYTES:]
    _, _, at, size, count, crc, end = struct.unpack(">QIQIQII", foot)
    if end != FOOTER_MAGIC or crc != zlib.crc32(foot[:32]):
        raise BadFile("the footer is damaged")
    if at + size > len(data) - FOOTER_BYTES:
        raise BadFile("the index lies outside the file")
    blocks, stop = [], at + size
    while at < stop:
        (k,) = struct.unpack_from(">H", data, at)
        if at + 18 + k > stop:
            raise BadFile("the index is cut off")
        block = struct.unpack_from(">QIHH", data, at + 2 + k)
        if block[1] < TRAILER_BYTES or block[0] + block[1] > len(data):
            raise BadFile("a block lies outside the file")
        blocks.append(block)
        at += 18 + k
    return blocks, count


def entries_of(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """All entries in order, every block checked; None is a deletion."""
    blocks, count = index_of(data)
    seen, last = 0, None
    for offset, length, restarts, flags in blocks:
        stored = data[offset : offset + length - TRAILER_BYTES]
        raw_size, crc = struct.unpack_from(">II", data, offset + length - TRAILER_BYTES)
        if zlib.crc32(stored) != crc:
            raise BadFile(f"the block at {offset} is damaged")
        if flags & COMPRESSED:
            if int.from_bytes(stored[:4], "little") != raw_size:
                raise BadFile(f"the block at {offset} has another length than it says")
            stored = pa.Codec("lz4_raw").decompress(stored[4:], raw_size).to_pybytes()
        at, stop = 0, raw_size - 4 * restarts - 2
        while at < stop:
            k, v = struct.unpack_from(">HI", stored, at)
            n = 0 if v & DELETED else v
            if at + 6 + k + n > stop:
                raise BadFile(f"an entry of the block at {offset} is cut off")
            key = stored[at + 6 : at + 6 + k]
            if last is not None and key < last:
                raise BadFile("keys are out of order")
            yield key, None if v & DELETED else stored[at + 6 + k : at + 6 + k + n]
            at, last, seen = at + 6 + k + n, key, seen + 1
    if seen != count:
        raise BadFile(f"the file has {seen} entries; its footer says {count}")


def read_blockfiles(spark: SparkSession, paths: list[str], rows: int = 10_000) -> DataFrame:
    """(key, value, seq, ord) of files: a later path is newer, ``ord`` counts within a file. Resolve, merge or build from it."""
    kind = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("ord", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                keys, values, start = [], [], 0
                for key, value in entries_of(content.as_py()):
                    keys.append(key)
                    values.append(value)
                    if len(keys) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(range(start, start + len(keys)), pa.int64())], schema=kind)
                        keys, values, start = [], [], start + rows
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(range(start, start + len(keys)), pa.int64())], schema=kind)

    out = None
    for seq, path in enumerate(paths):
        one = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "key binary, value binary, ord long")
        one = one.select("key", "value", F.lit(seq).cast("long").alias("seq"), "ord")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no files are named")
    return out
