"""Immutable, key-sorted tables: Parquet with statistics, bloom filter and page checksums, beside a small manifest.

A table's files are written aside and then moved; its manifest is created last, and without it nothing is a table, so it is
there whole or not at all. Rows are range-partitioned and sorted by key: a point look-up is pruned by file and row-group
bounds and the bloom filter, whose size follows the keys of each row group, a range reads its files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions.model import ENTRY, check_entry, entries, to_bytes, validated
from lamella.operators import resolve as R
from lamella.sources.files import Corrupt, Files, sealed, unsealed

FORMAT = 2
MANIFEST = "_table.json"
#: A row group's bloom filter is the least that fits its keys of ``BLOOM_SIZES`` sizes, each half of the one before, from this on.
MOST_BLOOM, BLOOM_SIZES = 8 << 20, 11


class Meta(NamedTuple):
    rows: int
    tombstones: int
    size: int
    least: bytes | None
    most: bytes | None

    def as_json(self) -> dict:
        return {"format": FORMAT, "rows": self.rows, "tombstones": self.tombstones, "size": self.size, "least": None if self.least is None else self.least.hex(), "most": None if self.most is None else self.most.hex()}

    @classmethod
    def of(cls, d: dict) -> Meta:
        back = lambda x: None if x is None else bytes.fromhex(x)
        return cls(d["rows"], d["tombstones"], d["size"], back(d["least"]), back(d["most"]))


def write_table(spark: SparkSession, path: str, data, strict: bool = False, compression: str = "zstd", unique: bool = False, partitions: int | None = None) -> Table:
    """Build a table at ``path`` of anything ``entries`` takes: sorted, the last of equal keys kept, by ``ord`` where it is a DataFrame
    (without ``ord`` a key that occurs twice has no last row and fails the build).

    ``strict``: the input must be in strictly ascending key order by ``ord``, as a builder fed row by row demands.
    ``unique``: a promise that no key occurs twice, tested in place; it spares the exchange that brings a key's rows together.
    Without it rows are combined before that exchange, so a key written a million times is a row for each task.
    """
    files = Files(spark, path)
    if files.exists(path):
        raise FileExistsError(path)
    if strict and isinstance(data, DataFrame) and "ord" not in data.columns:
        raise ValueError("a DataFrame in key order needs a column ord")
    df = validated(entries(spark, data))
    if strict:
        # neighbours meet by position, block by block: a block's last key goes to the next block
        w = Window.partitionBy("_block").orderBy("ord")
        blocks = df.withColumn("_block", F.expr("ord DIV 100000"))
        inside = blocks.withColumn("_before", F.lag("key").over(w)).filter(F.col("_before") >= F.col("key"))
        edges = blocks.groupBy("_block").agg(F.min_by("key", "ord").alias("first"), F.max_by("key", "ord").alias("last"))
        across = edges.alias("a").join(edges.alias("b"), F.expr("b._block = a._block + 1")).filter("b.first <= a.last")
        if not inside.isEmpty() or not across.isEmpty():
            raise ValueError("keys are not in strictly ascending order")
    if strict or unique:
        return store_sorted(spark, path, df.select("key", "value"), compression, partitions, R.unique)
    return store_sorted(spark, path, R.last_wins(df), compression, partitions)


def store_sorted(spark: SparkSession, path: str, rows: DataFrame, compression: str = "zstd", partitions: int | None = None, within=None) -> Table:
    """Write (key, value), one row for each key, as a table.

    ``within``: what makes one row of a key's rows, run after the range exchange. That already brings a key together, so
    merging ``stacked`` tables, of few rows a key, takes one exchange and no second one for grouping. The manifest's
    figures are observed while the rows are written.
    """
    files, aside = Files(spark, path), f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    spread = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    spread = within(spread) if within else spread
    seen = Observation()
    sorted_ = spread.sortWithinPartitions("key").observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.hex(F.min("key")).alias("least"), F.hex(F.max("key")).alias("most"))
    writer = sorted_.write.option("compression", compression).option("parquet.page.write-checksum.enabled", "true")
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(MOST_BLOOM)).option("parquet.bloom.filter.candidates.number#key", str(BLOOM_SIZES))
    try:
        writer.parquet(aside)
        x = seen.get
        back = lambda h: None if h is None else bytes.fromhex(h)
        meta = Meta(x["rows"], x["tombstones"], files.size(aside), back(x["least"]), back(x["most"]))
        files.rename(aside, path)
    except BaseException:
        files.remove(aside)
        raise
    if not files.create(f"{path}/{MANIFEST}", sealed(meta.as_json())):
        raise FileExistsError(path)
    return Table(spark, path)


class Builder:
    """A table fed row by row in strictly ascending key order, whatever its size: rows go to a staging folder by ``most_bytes``.

    ``with Builder(spark, path) as b: b.add("a", "1"); b.add_tombstone("b")`` finishes at the end; an exception leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd", most_bytes: int = 32 << 20) -> None:
        self.spark, self.path, self.compression, self.most_bytes = spark, path.rstrip("/"), compression, most_bytes
        self.files = Files(spark, path)
        if self.files.exists(path):
            raise FileExistsError(path)
        self.stage = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.rows: list[tuple] = []
        self.last: bytes | None = None
        self.held = self.staged = 0
        self.done = False

    def add(self, key: str | bytes, value: str | bytes | None) -> None:
        """The next entry; None is a tombstone."""
        if self.done:
            raise RuntimeError("the builder is finished")
        k, v = to_bytes(key), None if value is None else to_bytes(value)
        check_entry(k, v)
        if self.last is not None and k <= self.last:
            raise ValueError("keys are not in strictly ascending order")
        self.rows.append((bytearray(k), None if v is None else bytearray(v)))
        self.last, self.held = k, self.held + len(k) + len(v or b"") + 32
        if self.held >= self.most_bytes:
            self._spill()

    def add_tombstone(self, key: str | bytes) -> None:
        self.add(key, None)

    def add_many(self, data: Iterable) -> None:
        for k, v in data:
            self.add(k, v)

    def _spill(self) -> None:
        self.spark.createDataFrame(self.rows, ENTRY).write.parquet(f"{self.stage}/{self.staged:08d}")
        self.rows, self.held, self.staged = [], 0, self.staged + 1

    def finish(self) -> Table:
        if self.done:
            raise RuntimeError("the builder is finished")
        self.done = True
        rows = self.spark.createDataFrame(self.rows, ENTRY)
        if self.staged:
            rows = rows.union(self.spark.read.schema(ENTRY).parquet(*(f"{self.stage}/{i:08d}" for i in range(self.staged))))
        try:
            return store_sorted(self.spark, self.path, rows, self.compression, None if self.staged else 1)
        finally:
            self.files.remove(self.stage)

    def __enter__(self) -> Builder:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.done:
            self.finish()
        elif not self.done:
            self.done = True
            self.files.remove(self.stage)


class Table:
    """A table that was written; tombstones are visible in ``raw`` and in scans of it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        files = Files(spark, path)
        if not files.exists(f"{path}/{MANIFEST}"):
            raise Corrupt(f"{path} is no table: it has no {MANIFEST}")
        said = unsealed(files.read(f"{path}/{MANIFEST}"), f"{path}/{MANIFEST}")
        if said is None:
            raise Corrupt(f"{path}/{MANIFEST} is cut off")
        if said.get("format") != FORMAT:
            raise Corrupt(f"{path} has format {said.get('format')}; {FORMAT} is read")
        self.spark, self.path, self.files, self.meta = spark, path, files, Meta.of(said)

    @property
    def raw(self) -> DataFrame:
        """(key, value) with tombstones; corrupt pages fail the read."""
        return self.spark.read.schema(ENTRY).option("parquet.page.verify-checksum.enabled", "true").parquet(self.path)

    @property
    def live(self) -> DataFrame:
        return self.raw.filter(F.col("value").isNotNull())

    def __len__(self) -> int:
        """Physical entries: tombstones count."""
        return self.meta.rows

    def count_live(self) -> int:
        return self.meta.rows - self.meta.tombstones

    def get_entry(self, key: str | bytes) -> tuple[bool, bytes | None]:
        """(found, value): (False, None) absent, (True, None) deleted."""
        x = R.get_entry(self.raw, key).first()
        return x["found"], None if x["value"] is None else bytes(x["value"])

    def get(self, key: str | bytes) -> bytes | None:
        return self.get_entry(key)[1]

    def get_utf8(self, key: str | bytes) -> str | None:
        return text_or_none(self.get(key))

    def has(self, key: str | bytes) -> bool:
        return self.get(key) is not None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, other columns) with ``found`` and ``value``; only what lies in the keys' bounds is read."""
        return R.multi_get(self.live, keys)

    def multi_has(self, keys: DataFrame) -> DataFrame:
        return R.multi_has(self.live, keys)

    def scan(self, start=None, end=None, prefix=None, ordered: bool = True) -> DataFrame:
        return R.scan(self.raw, start, end, prefix, ordered)

    def seek(self, start: str | bytes) -> DataFrame:
        return self.scan(start=start)

    def range(self, start: str | bytes, end: str | bytes) -> DataFrame:
        return self.scan(start, end)

    def prefix(self, p: str | bytes) -> DataFrame:
        return self.scan(prefix=p)

    def __iter__(self):
        for r in self.scan().toLocalIterator():
            yield bytes(r["key"]), None if r["value"] is None else bytes(r["value"])

    def stats(self) -> dict:
        """Entries, tombstones, bytes on disk, and from the Parquet footers: files, row groups, raw and stored bytes and those of
        the bloom filters. Footers are read some at a time, never the rows."""
        jvm, conf = self.files.jvm, self.files.conf
        names = [n for n in self.files.names(self.path) if n.endswith(".parquet")]

        def footer(name: str) -> tuple[int, int, int, int]:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(self.files.path(f"{self.path}/{name}"), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                groups = list(reader.getFooter().getBlocks())
                return len(groups), sum(b.getTotalByteSize() for b in groups), sum(b.getCompressedSize() for b in groups), sum(max(0, c.getBloomFilterLength()) for b in groups for c in b.getColumns())
            finally:
                reader.close()

        with ThreadPoolExecutor(16) as pool:
            groups, raw, stored, bloom = map(sum, zip((0, 0, 0, 0), *pool.map(footer, names), strict=True))
        return {"entries": self.meta.rows, "tombstones": self.meta.tombstones, "size": self.files.size(self.path), "files": len(names), "row_groups": groups, "bloom_bytes": bloom, "raw_bytes": raw, "stored_bytes": stored, "ratio": stored / raw if raw else 1.0}

    def check(self) -> int:
        """Read every page against its checksum, and hold order and count against the manifest; returns the entries."""
        at = self.raw.select("key", "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        try:
            w = Window.partitionBy("_file").orderBy("_row")
            inner = at.withColumn("_before", F.lag("key").over(w)).agg(F.count_if(F.col("_before") >= F.col("key")), F.count("*"), F.sum(F.length("value")), F.count_if(F.length("key") > 65_535)).first()
            ends = at.groupBy("_file").agg(F.min("key").alias("a"), F.max("key").alias("b"))  # a row for each file
            outer = ends.withColumn("_before", F.lag("b").over(Window.orderBy("_file"))).filter("_before >= a").count()
        except Exception as e:
            raise Corrupt(f"{self.path} can't be read: {str(e)[:300]}") from e
        if inner[0] or outer:
            raise Corrupt(f"{self.path} has {inner[0] + outer} keys out of order")
        if inner[1] != self.meta.rows:
            raise Corrupt(f"{self.path} has {inner[1]} entries; its manifest says {self.meta.rows}")
        return inner[1]


def text_or_none(value: bytes | None) -> str | None:
    try:
        return None if value is None else value.decode()
    except UnicodeDecodeError:
        return None


def merge_tables(spark: SparkSession, inputs: list[str], out: str, compression: str = "zstd") -> int:
    """Merge tables into a new one: of equal keys the last input's entry stays, tombstones too. Returns the entries."""
    if out in inputs:
        raise ValueError("the output is one of the inputs")
    tables = [Table(spark, p) for p in inputs]
    if not tables:
        raise ValueError("nothing to merge")
    return len(store_sorted(spark, out, R.stacked([t.raw for t in tables]), compression, None, lambda log: R.resolve(log, keep_tombstones=True)))
