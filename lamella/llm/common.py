"""What the text operators share: scratch tables, size-checked joins, global positions.

Scratch tables are Parquet, written below ``spark.checkpoint.dir`` (the folder that a cluster's
driver and executors share), so a lost executor costs one task and never a lineage. Nothing is
written to a machine-local folder except where that setting is absent *and* the master is local.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import glob
import os
import py_compile
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blank characters that end a word.
BLANKS = " \t\n\x0b\x0c\r"
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes of an Arrow batch, or one text.
BATCH = 4 << 20
#: No join sends more rows than this to every task, whatever it is allowed; 0 makes all joins exchange (as tests do).
MOST_SENT = 1 << 62


@functools.lru_cache(maxsize=1)
def package() -> str:
    """This package as an archive, with compiled modules, for executors; on the driver's own disk, from where Spark serves it."""
    folder = tempfile.mkdtemp(prefix="lamella-")
    at, top = os.path.join(folder, "lamella.zip"), os.path.dirname(PACKAGE)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(glob.glob(f"{PACKAGE}/**/*.py", recursive=True)):
            name = os.path.relpath(path, top)
            compiled = py_compile.compile(path, os.path.join(folder, "module.pyc"), name, doraise=True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH)
            z.write(path, name)
            z.write(compiled, name + "c")
    return at


_sent: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let Python workers on any machine import this package, and bound an Arrow batch by bytes, for very long texts. The second is a
    setting of the session, ``spark.sql.execution.arrow.maxBytesPerBatch``: it is lowered to ``BATCH``, never raised."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(package())
        _sent.add(app)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH:
        spark.conf.set(name, str(BATCH))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def tidy() -> None:
    """Give what was freed back to the machine: allocators keep several times what a worker's caches take."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over Arrow batches, with memory given back between them."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in run(batches):
            size += batch.nbytes + (1 << 16)
            yield batch
            del batch
            if size > BATCH:
                tidy()
                size = 0
        tidy()

    return lean_run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only under a local master."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lamella-scratch")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a scratch table, written once and read back; removed by ``forget``, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    for made in _making:
        made.append(back)
    return back


_making: list[list[DataFrame]] = []


@contextlib.contextmanager
def making() -> Iterator[list[DataFrame]]:
    """The scratch tables that are written meanwhile."""
    made: list[DataFrame] = []
    _making.append(made)
    try:
        yield made
    finally:
        _making.remove(made)


def forget(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hash_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most_rows: int = 100_000) -> DataFrame:
    """Join a written table; it is broadcast only if a count finds at most ``most_rows`` rows of a few numbers,
    else both sides are shuffled and adaptive execution splits the hot keys. The result is the same."""
    return left.join(F.broadcast(right) if right.count() <= min(most_rows, MOST_SENT) else right, on, how)


def ranked(df: DataFrame, keys: list, name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with its global 0-based position under ``keys``, a total order, as column ``name``; with ``size``, the sum of that column
    over all rows before.

    One range exchange and sort, then one number for each partition: no row meets rows of other partitions.
    The sorted table is written, so positions do not depend on a second run of the exchange.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    spread = spread.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND((1 << 33) - 1))
    if size:
        spread = spread.mapInArrow(lean(functools.partial(_sums, size)), T.StructType([*spread.schema.fields, T.StructField("_before", T.LongType())])).drop("_row").withColumnRenamed("_before", "_row")
    sorted_ = written(spread)
    sizes = sorted_.groupBy("_part").agg((F.sum(size) if size else F.count("*")).alias("_n"))  # a row for each partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return hash_join(sorted_, starts, ["_part"], "inner").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def _sums(size: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows with the sum of ``size`` over those before."""
    done = 0
    for batch in batches:
        n = batch.column(size).to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done + np.cumsum(n) - n, pa.int64())], [*batch.schema.names, "_before"])
        done += int(n.sum())


def whole(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one v, and no v is a u. Then each star is a component."""
    nodes = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each connected component, for every node in ``edges``; nodes are anything that has an order.

    Alternating large-star and small-star contraction: rounds grow with the logarithm of the longest chain,
    every grouping is a partial ``min``, and each round is written, so hot nodes and lost executors do no harm.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        # large star: each node's larger neighbours move to its least neighbour
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # so that the join can split a hot node
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node and its smaller neighbours move to the least of them; these are few, as each is the least of a large star
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        after = written(small)
        forget(e, least)
        e = after
        if _stars(e):
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return written(nodes.union(nodes.select(F.col("label").alias("node"), "label").distinct()))
