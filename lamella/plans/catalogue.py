"""Registered key-value queries and their SQL, over key-value views of the driver's tables.

``log_of`` is a change log of ``events``: a key per user and slot, the event as its value, errors as deletions, newest id last.
``orders_kv`` is a static table of ``orders``. Results are text and numbers, so that values compare across engines.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import model as M
from lamella.functions.bounds import successor
from lamella.operators import patterns as P
from lamella.operators import resolve as R
from lamella.operators.compaction import pick_tier
from lamella.sources.table import Table, write_table

LOG_SQL = """log AS (SELECT 'user:'||lpad(user_id::VARCHAR,6,'0')||':'||lpad((event_id%7)::VARCHAR,2,'0') AS k,
  CASE WHEN event_type <> 'error' THEN event_type||'|'||props END AS v, event_id AS seq FROM events)"""
OKV_SQL = "okv AS (SELECT 'order:'||lpad(o_orderkey::VARCHAR,10,'0') AS k, o_orderstatus||'|'||o_orderpriority AS v, o_orderkey AS n FROM orders)"
LIVE_SQL = LOG_SQL + """, r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log),
  raw AS (SELECT k, v FROM r WHERE rn = 1), live AS (SELECT k, v FROM raw WHERE v IS NOT NULL)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.lpad((F.col("event_id") % 7).cast("string"), 2, "0"))
    value = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("|"), "props"))
    return e.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("ord"))


def orders_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).cast("binary").alias("key"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").cast("binary").alias("value"), F.col("o_orderkey").alias("n"))


def said(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(log_of(spark, sf_dir))


def shared_path(spark: SparkSession) -> str:
    """A fresh path for a table that a query builds: in the folder that all machines share."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "lamella-scratch")
    at = f"{where.rstrip('/')}/kv-{uuid.uuid4().hex}"
    gone_at_exit(spark, at)
    return at


def gone_at_exit(spark: SparkSession, at: str) -> None:
    """Remove what is at a path when the driver's JVM ends; Hadoop does nothing if there is nothing yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def built(spark: SparkSession, sf_dir: str) -> Table:
    return write_table(spark, shared_path(spark), orders_kv(spark, sf_dir).select("key", "value"))


def part(spark: SparkSession, sf_dir: str, test: str) -> DataFrame:
    """The raw view of the part of the log that ``test`` selects: one of several tables to merge."""
    return R.resolve(log_of(spark, sf_dir).filter(test), keep_tombstones=True)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- resolved views


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def resolve_live(spark, sf_dir):
    return said(live(spark, sf_dir))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def resolve_live_by_position(spark, sf_dir):
    return said(R.resolve_unique(log_of(spark, sf_dir)))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value, v IS NULL AS deleted FROM raw")
def resolve_raw_with_tombstones(spark, sf_dir):
    return said(R.resolve(log_of(spark, sf_dir), True)).withColumn("deleted", F.col("value").isNull())


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live WHERE k >= 'user:000020' AND k < 'user:000060'")
def filter_before_resolve_range(spark, sf_dir):
    return said(R.scan(live(spark, sf_dir), "user:000020", "user:000060"))


# -- look-ups


@query(f"WITH {OKV_SQL} SELECT k AS key, true AS found, false AS deleted, v AS value FROM okv WHERE n = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 7)")
def point_get_hit(spark, sf_dir):
    n = orders_kv(spark, sf_dir).filter("n >= 7").agg(F.min("n")).first()[0]
    return point(R.get_entry(built(spark, sf_dir).raw, f"order:{n:010d}"))


@query("SELECT 'order:x' AS key, false AS found, false AS deleted, NULL::VARCHAR AS value")
def point_get_miss(spark, sf_dir):
    return point(R.get_entry(built(spark, sf_dir).raw, "order:x"))


@query(f"WITH {LIVE_SQL} SELECT k AS key, true AS found, true AS deleted, NULL::VARCHAR AS value FROM raw WHERE v IS NULL ORDER BY k LIMIT 1")
def get_entry_deleted(spark, sf_dir):
    raw = R.resolve(log_of(spark, sf_dir), True)
    key = raw.filter("value IS NULL").agg(F.min("key")).first()[0]
    return point(R.get_entry(raw, key))


def point(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), "found", "deleted", F.col("value").cast("string").alias("value"))


KEYS_SQL = "keys AS (SELECT DISTINCT 'user:'||lpad(user_id::VARCHAR,6,'0')||':00' AS k FROM events UNION SELECT 'user:none'||r_regionkey FROM region)"


def keys_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":00")).cast("binary").alias("key"))
    return users.distinct().union(read(spark, sf_dir, "region").select(F.concat(F.lit("user:none"), "r_regionkey").cast("binary")))


@query(f"WITH {LIVE_SQL}, {KEYS_SQL} SELECT keys.k AS key, v AS value, v IS NOT NULL AS found FROM keys LEFT JOIN live USING (k)")
def multi_get(spark, sf_dir):
    d = R.multi_get(live(spark, sf_dir), keys_of(spark, sf_dir))
    return d.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "found")


@query(f"WITH {LIVE_SQL}, {KEYS_SQL} SELECT k AS key FROM keys WHERE k IN (SELECT k FROM live)")
def multi_has(spark, sf_dir):
    return R.multi_has(live(spark, sf_dir), keys_of(spark, sf_dir)).select(F.col("key").cast("string").alias("key"))


@query(f"WITH {LIVE_SQL}, {KEYS_SQL} SELECT k AS key FROM keys WHERE k NOT IN (SELECT k FROM live)")
def missing_keys(spark, sf_dir):
    return R.missing(live(spark, sf_dir), keys_of(spark, sf_dir)).select(F.col("key").cast("string").alias("key"))


# -- ordered scans of a built table


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv")
def scan_all(spark, sf_dir):
    return said(built(spark, sf_dir).scan())


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv WHERE k >= 'order:0000000900'")
def seek_from(spark, sf_dir):
    return said(built(spark, sf_dir).seek("order:0000000900"))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv WHERE k >= 'order:0000000100' AND k < 'order:0000000200'")
def range_half_open(spark, sf_dir):
    return said(built(spark, sf_dir).range("order:0000000100", "order:0000000200"))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv WHERE false")
def range_empty(spark, sf_dir):
    return said(built(spark, sf_dir).range("order:2", "order:1"))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv WHERE starts_with(k, 'order:00000001')")
def prefix_scan(spark, sf_dir):
    return said(built(spark, sf_dir).prefix("order:00000001"))


@query("SELECT upper(h) AS key FROM (VALUES ('ff'), ('ff00'), ('ffff')) t(h)")
def prefix_binary_ff(spark, sf_dir):
    raw = M.entries(spark, [(bytes.fromhex(h), b"") for h in ("", "61", "7f", "80", "fe", "ff", "ff00", "ffff")])
    assert successor(b"\xff") is None
    return R.scan(raw, prefix=b"\xff").select(F.hex("key").alias("key"))


@query("SELECT upper(h) AS key, row_number() OVER (ORDER BY n) - 1 AS place FROM (VALUES ('', 0), ('61', 1), ('6162', 2), ('62', 3), ('7f', 4), ('80', 5), ('ff00', 6)) t(h, n)")
def unsigned_byte_order(spark, sf_dir):
    from pyspark.sql import Window

    keys = M.entries(spark, [(bytes.fromhex(h), b"") for h in ("ff00", "80", "62", "", "6162", "7f", "61")])
    return keys.select(F.hex("key").alias("key"), (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("place"))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv WHERE k >= 'order:00000002' ORDER BY k LIMIT 100")
def dump_limit(spark, sf_dir):
    return said(built(spark, sf_dir).seek("order:00000002").limit(100))


@query(f"WITH {OKV_SQL} SELECT k AS key FROM okv")
def dump_keys_only(spark, sf_dir):
    """All keys: the values' column is not read."""
    return built(spark, sf_dir).scan(ordered=False).select("key").orderBy("key").select(F.col("key").cast("string").alias("key"))


# -- builds and merges


@query(f"WITH {LOG_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log) SELECT k AS key, v AS value FROM x WHERE rn = 1")
def build_dedup_last_wins(spark, sf_dir):
    rows = log_of(spark, sf_dir).select("key", "value", F.col("seq").alias("ord"))
    return said(write_table(spark, shared_path(spark), rows).raw)


def merge_sql(tests: list[str], tombstones: bool = True) -> str:
    parts = " UNION ALL ".join(f"SELECT k, v, {i} AS t, seq FROM log WHERE {t}" for i, t in enumerate(tests))
    return f"WITH {LOG_SQL}, m AS ({parts}), r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t DESC, seq DESC) rn FROM m) SELECT k AS key, v AS value FROM r WHERE rn = 1" + ("" if tombstones else " AND v IS NOT NULL")


@query(merge_sql(["seq % 2 = 1", "seq % 2 = 0"]))
def merge_two_last_wins(spark, sf_dir):
    return said(R.merge([part(spark, sf_dir, "seq % 2 = 1"), part(spark, sf_dir, "seq % 2 = 0")]))


@query(merge_sql(["seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"]))
def merge_three_with_tombstones(spark, sf_dir):
    return said(R.merge([part(spark, sf_dir, f"seq % 3 = {i}") for i in (2, 0, 1)]))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv")
def merge_disjoint(spark, sf_dir):
    o = orders_kv(spark, sf_dir)
    return said(R.merge([o.filter("n % 2 = 0"), o.filter("n % 2 = 1")]))


@query(f"WITH {OKV_SQL} SELECT k AS key, v AS value FROM okv")
def merge_with_empty(spark, sf_dir):
    o = orders_kv(spark, sf_dir)
    return said(R.merge([o, o.filter("false")]))


@query(f"WITH {OKV_SQL} SELECT k AS key, CASE WHEN n % 10 = 0 THEN 'new' ELSE v END AS value FROM okv")
def overlay_base_delta(spark, sf_dir):
    o = orders_kv(spark, sf_dir)
    return said(R.merge([o, o.filter("n % 10 = 0").withColumn("value", F.lit("new").cast("binary"))]))


@query("SELECT 'a' AS key, '3' AS value UNION ALL SELECT 'c', '1'")
def put_then_delete_then_put(spark, sf_dir):
    puts = [[("a", "1"), ("b", "1"), ("c", "1")], [("a", None), ("b", None)], [("a", "2"), ("a", "3")]]
    layers = [R.last_wins(M.entries(spark, p)) for p in puts]
    return said(R.resolve(R.stacked(layers)))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def compact_equivalence(spark, sf_dir):
    """Three layers written as tables and merged into one give the view of the whole log."""
    tests = ["seq % 3 = 0", "seq % 3 = 1", "seq % 3 = 2"]
    log = log_of(spark, sf_dir)
    layers = [write_table(spark, shared_path(spark), log.filter(t).select("key", F.struct("seq", "value").alias("x")).groupBy("key").agg(F.max_by("x", "x.seq").alias("x")).select("key", F.to_json("x", {"ignoreNullFields": "false"}).cast("binary").alias("value"))).raw for t in tests]
    rows = [x.select("key", F.from_json(F.col("value").cast("string"), "seq long, value binary").alias("x")).select("key", "x.value", "x.seq", F.lit(0).cast("long").alias("ord")) for x in layers]
    merged = R.resolve(rows[0].union(rows[1]).union(rows[2]), keep_tombstones=True)
    return said(write_table(spark, shared_path(spark), merged).live)


@query("SELECT * FROM (VALUES ('2000,1,1,1,1,1,1,1', '1,8'), ('8,4,2,1', '0,4'), ('100,10,1', 'none')) t(sizes, tier)")
def tier_pick(spark, sf_dir):
    rows = [([2000] + [1] * 7), [8, 4, 2, 1], [100, 10, 1]]
    found = [(",".join(map(str, r)), "none" if (t := pick_tier(r, 16)) is None else f"{t[0]},{t[1]}") for r in rows]
    return spark.createDataFrame(found, "sizes string, tier string")


@query(f"WITH {LOG_SQL}, r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log WHERE seq <= (SELECT max(event_id) // 2 FROM events)) SELECT k AS key, v AS value FROM r WHERE rn = 1 AND v IS NOT NULL")
def snapshot_as_of(spark, sf_dir):
    half = read(spark, sf_dir, "events").agg(F.expr("max(event_id) DIV 2")).first()[0]
    return said(R.resolve(log_of(spark, sf_dir).filter(F.col("seq") <= half)))


# -- counts and checks


@query(f"WITH {LIVE_SQL} SELECT count(*) AS n FROM raw")
def count_physical(spark, sf_dir):
    return R.resolve(log_of(spark, sf_dir), True).agg(F.count("*").alias("n"))


@query(f"WITH {LIVE_SQL} SELECT count(*) AS n FROM live")
def count_live(spark, sf_dir):
    return live(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {LIVE_SQL} SELECT count(*) AS n FROM raw WHERE v IS NULL")
def tombstone_count(spark, sf_dir):
    return R.resolve(log_of(spark, sf_dir), True).filter("value IS NULL").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT seq % 4 AS layer, count(*) AS n, count(v) AS live, min(k) AS least, max(k) AS most, sum(strlen(k)) AS key_bytes FROM log GROUP BY 1")
def layer_stats(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return log.groupBy((F.col("seq") % 4).alias("layer")).agg(F.count("*").alias("n"), F.count("value").alias("live"), F.min("key").cast("string").alias("least"), F.max("key").cast("string").alias("most"), F.sum(F.length("key")).alias("key_bytes"))


@query("SELECT count(*) AS n FROM orders")
def check_ordering(spark, sf_dir):
    """The entries of a table that passes its check: checksums, order and count."""
    return spark.createDataFrame([(built(spark, sf_dir).check(),)], "n long")


# -- values and key design


@query("SELECT doc_id, text AS value FROM documents UNION ALL SELECT -1, NULL UNION ALL SELECT -2, ''")
def utf8_valid_or_null(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    odd = spark.createDataFrame([(-1, bytearray(b"\xff\xfe")), (-2, bytearray(b""))], "doc_id long, raw binary")
    return d.union(odd).select("doc_id", M.utf8(F.col("raw")).alias("value"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_decode_field(spark, sf_dir):
    raw = read(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("value"))
    return raw.select("event_id", F.try_variant_get(M.json_of(F.col("value")), "$.k", "bigint").alias("k"))


@query("SELECT o_orderkey AS n, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def key_design_padded(spark, sf_dir):
    return placed(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), M.padded(F.col("o_orderkey"), 12).alias("key")))


@query("SELECT o_orderkey AS n, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def key_design_u64be(spark, sf_dir):
    return placed(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), M.big_endian(F.col("o_orderkey")).alias("key")))


def placed(df: DataFrame) -> DataFrame:
    """Rows numbered by key, null keys last: sorted in ranges, so no task gets them all.

    The sorted rows are written: a second run of the range exchange draws another sample and cuts the ranges elsewhere.
    """
    from pyspark.sql import Window

    at, by = F.monotonically_increasing_id(), F.col("key").asc_nulls_last()
    d = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("part", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND((1 << 33) - 1)).drop("key")
    d.write.parquet(path := shared_path(df.sparkSession))
    gone_at_exit(df.sparkSession, path)
    d = df.sparkSession.read.schema(d.schema).parquet(path)
    sizes = d.groupBy("part").agg(F.count("*").alias("c"))  # a row for each range
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    return d.join(F.broadcast(before), "part").select("n", (F.col("before") + F.col("row") + 1).alias("place"))


# -- patterns


@query(f"WITH {OKV_SQL} SELECT k AS key FROM okv WHERE n % 1000 < 300")
def ttl_purge(spark, sf_dir):
    sessions = orders_kv(spark, sf_dir).select("key", F.to_json(F.struct((F.col("n") % 1000).alias("exp"))).cast("binary").alias("value"))
    return P.expired(sessions, 300).select(F.col("key").cast("string").alias("key"))


@query("SELECT 'n:'||event_type AS key, sum(user_id)::VARCHAR AS value FROM events GROUP BY event_type")
def counter_increment(spark, sf_dir):
    changes = read(spark, sf_dir, "events").select(F.concat(F.lit("n:"), "event_type").cast("binary").alias("key"), F.col("user_id").alias("amount"), (F.col("event_id") % 2 == 0).alias("first"))
    once = P.increments(changes.filter("first"))
    return said(R.merge([once, P.increments(changes.filter("NOT first"), once)]))


@query("SELECT doc_id, text AS value, greatest(1, (strlen(text) + 255) // 256) AS chunks FROM documents WHERE text IS NOT NULL")
def chunk_reassemble(spark, sf_dir):
    blobs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.col("text").cast("binary").alias("value"))
    chunks = P.chunked(blobs, 256)
    n = chunks.groupBy(F.expr("left(cast(key AS string), 12)").alias("name")).agg(F.count("*").alias("chunks"))
    whole = P.reassembled(chunks)
    return whole.join(n, "name").select(F.col("name").cast("long").alias("doc_id"), F.col("value").cast("string").alias("value"), "chunks")


@query("SELECT conv_id, count(*) AS turns, sum(strlen(role||': '||text)) AS bytes FROM conversations GROUP BY conv_id")
def prefix_group_scan(spark, sf_dir):
    """Conversations as entries ``conv:<id>:<turn>``; every prefix at once by its key's middle part."""
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), F.lpad(F.col("conv_id").cast("string"), 10, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 5, "0")).cast("binary").alias("key"), F.concat("role", F.lit(": "), "text").cast("binary").alias("value"))
    at = F.substring(F.col("key").cast("string"), 6, 10).cast("long")
    return c.groupBy(at.alias("conv_id")).agg(F.count("*").alias("turns"), F.sum(F.length("value")).alias("bytes"))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def store_put_compact_view(spark, sf_dir):
    """The log in four layers of a store, compacted, saved and read back from the published table."""
    from lamella.operators.published import Published
    from lamella.operators.store import Options

    log = log_of(spark, sf_dir)
    cut = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 4 + 1
    inner = Published(spark, shared_path(spark), Options(compact_threshold=0))
    for i in range(4):
        inner.store.put_df(log.filter(f"seq >= {i * cut} AND seq < {(i + 1) * cut}").select("key", "value", F.col("seq").alias("ord")))
    table = inner.save()
    inner.close()
    return said(table.live)


# -- through a store: what is written by puts, deletes, flushes and merges, read back


def store_of(spark: SparkSession, threshold: int = 0):
    from lamella.operators.store import Options, Store

    return Store(spark, shared_path(spark), Options(compact_threshold=threshold))


def cuts_of(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    """The log in ``n`` batches by its order, as a store takes them."""
    log = log_of(spark, sf_dir)
    each = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // n + 1
    return [log.filter(f"seq >= {i * each} AND seq < {(i + 1) * each}").select("key", "value", F.col("seq").alias("ord")) for i in range(n)]


# the small writes that a driver makes over the log, as SQL and as calls
SMALL_SQL = "small AS (SELECT * FROM (VALUES ('user:000001:00', 'one'), ('user:000002:01', NULL), ('zz', 'last'), ('~', NULL)) t(k, v))"


def with_small(store) -> None:
    store.put([("user:000001:00", "first"), ("user:000001:00", "one"), ("zz", "last")])
    store.delete(["user:000002:01", "~"])


@query(f"WITH {LIVE_SQL}, {SMALL_SQL}, m AS (SELECT * FROM small UNION ALL SELECT * FROM raw WHERE k NOT IN (SELECT k FROM small)) SELECT k AS key, v AS value FROM m WHERE v IS NOT NULL")
def store_put_delete_flush_view(spark, sf_dir):
    """Layers of the log, small puts and deletes that were flushed, and some still in memory."""
    with store_of(spark) as s:
        for b in cuts_of(spark, sf_dir, 2):
            s.put_df(b)
        s.put([("user:000002:01", "lost"), ("zz", "early")])
        s.flush()
        with_small(s)
        return said(s.view())


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def store_background_compaction(spark, sf_dir):
    """Layers that are merged in the background while others are added."""
    with store_of(spark, 3) as s:
        for b in cuts_of(spark, sf_dir, 6):
            s.put_df(b)
        s.wait()
        return said(s.view())


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def store_compact_vacuum_view(spark, sf_dir):
    with store_of(spark) as s:
        for b in cuts_of(spark, sf_dir, 3):
            s.put_df(b)
        s.compact()
        s.vacuum()
        return said(s.view())


@query(f"WITH {LOG_SQL}, r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log WHERE seq < 2 * ((SELECT max(event_id) FROM events) // 4 + 1)) SELECT k AS key, v AS value FROM r WHERE rn = 1 AND v IS NOT NULL")
def store_as_of(spark, sf_dir):
    """The view as of the second of four layers, after all were merged."""
    with store_of(spark) as s:
        for i, b in enumerate(cuts_of(spark, sf_dir, 4)):
            s.put_df(b)
            if i == 1:
                second = s.next_seq() - 1
        s.compact()
        return said(s.as_of(second))


@query(f"WITH {LIVE_SQL}, {KEYS_SQL} SELECT keys.k AS key, v AS value, v IS NOT NULL AS found FROM keys LEFT JOIN live USING (k)")
def store_multi_get(spark, sf_dir):
    with store_of(spark) as s:
        for b in cuts_of(spark, sf_dir, 3):
            s.put_df(b)
        d = s.multi_get(keys_of(spark, sf_dir))
        return d.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "found")


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live WHERE k >= 'user:000020' AND k < 'user:000060' AND starts_with(k, 'user:00003')")
def store_range_prefix(spark, sf_dir):
    with store_of(spark) as s:
        for b in cuts_of(spark, sf_dir, 3):
            s.put_df(b)
        return said(s.scan("user:000020", "user:000060", "user:00003"))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM raw")
def merge_tables_of_log(spark, sf_dir):
    """Four tables on disk merged into one; tombstones stay."""
    from lamella.sources.table import merge_tables

    paths = []
    for b in cuts_of(spark, sf_dir, 4):
        paths.append(shared_path(spark))
        write_table(spark, paths[-1], b)
    out = shared_path(spark)
    merge_tables(spark, paths, out)
    return said(Table(spark, out).raw)


@query(f"WITH {LIVE_SQL} SELECT count(*) AS entries, count(*) FILTER (v IS NULL) AS tombstones, count(v) AS live, min(k) AS least, max(k) AS most, true AS has_bloom FROM raw")
def table_stats(spark, sf_dir):
    """What a table's manifest and footers say, against what is in it."""
    t = write_table(spark, shared_path(spark), log_of(spark, sf_dir).select("key", "value", F.col("seq").alias("ord")))
    x = t.stats()
    row = (x["entries"], x["tombstones"], t.count_live(), t.meta.least.decode(), t.meta.most.decode(), x["bloom_bytes"] > 0)
    return spark.createDataFrame([row], "entries long, tombstones long, live long, least string, most string, has_bloom boolean")


@query("SELECT 'event:'||lpad(event_id::VARCHAR, 12, '0') AS key, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events")
def build_unique_one_exchange(spark, sf_dir):
    """A table of keys that are unique by themselves."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("event:"), F.lpad(F.col("event_id").cast("string"), 12, "0")).cast("binary").alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).cast("binary").alias("value"))
    return said(write_table(spark, shared_path(spark), e, unique=True).raw)


@query("SELECT 'r:'||lpad(r_regionkey::VARCHAR, 4, '0') AS key, CASE WHEN r_regionkey <> 1 THEN r_name END AS value FROM region")
def builder_row_by_row(spark, sf_dir):
    """A table fed row by row, with a tombstone."""
    from lamella.sources.table import Builder

    b = Builder(spark, shared_path(spark), most_bytes=64)
    for r in read(spark, sf_dir, "region").orderBy("r_regionkey").toLocalIterator():
        b.add(f"r:{r['r_regionkey']:04d}", None if r["r_regionkey"] == 1 else r["r_name"])
    return said(b.finish().raw)


@query("SELECT 'set:'||r_regionkey AS key, 'text' AS kind, r_name AS value FROM region UNION ALL SELECT 'json', 'json', '{\"n\":1}' UNION ALL SELECT 'bytes', 'bytes', 'FF00'")
def facade_set_get(spark, sf_dir):
    """Text, JSON and bytes through the simple interface, after a save and a new opening."""
    from lamella.facade import Lamella

    path = shared_path(spark)
    with Lamella(spark, path, durability="fast") as db:
        db.set_many({f"set:{r['r_regionkey']}": r["r_name"] for r in read(spark, sf_dir, "region").collect()})
        db.set("json", {"n": 1})
        db.set("bytes", b"\xff\x00")
        db.set("gone", "x")
        db.delete("gone")
    db = Lamella(spark, path)
    d = db.view()
    kind = F.when(F.col("text").isNull(), "bytes").when(F.col("json").isNotNull(), "json").otherwise("text")
    return d.select(F.col("key").cast("string").alias("key"), kind.alias("kind"), F.coalesce("text", F.hex("value")).alias("value"))


@query(f"WITH {LIVE_SQL} SELECT k AS key, v AS value FROM live")
def stream_ingest(spark, sf_dir):
    """The log as a stream into a store, in order: three batches, one layer each."""
    from lamella.streaming.ingest import ingest

    source = shared_path(spark)
    for i, b in enumerate(cuts_of(spark, sf_dir, 3)):
        b.coalesce(1).write.parquet(f"{source}/part={i}")
    with store_of(spark) as s:
        for i in range(3):
            stream = spark.readStream.schema("key binary, value binary, ord long").parquet(f"{source}/part={i}")
            ingest(stream, s, shared_path(spark), f"part{i}").awaitTermination(300)
        return said(s.view())


@query(f"WITH {LOG_SQL}, c AS (SELECT k, v, seq // ((SELECT max(event_id) FROM events) // 4 + 1) AS i, row_number() OVER (PARTITION BY k, seq // ((SELECT max(event_id) FROM events) // 4 + 1) ORDER BY seq DESC) rn FROM log) SELECT (i + 1)::BIGINT AS layer, count(*) AS n, count(*) FILTER (v IS NULL) AS tombstones, min(k) AS least, max(k) AS most FROM c WHERE rn = 1 GROUP BY i")
def store_layers(spark, sf_dir):
    """What the store's manifest says of four layers."""
    with store_of(spark) as s:
        for b in cuts_of(spark, sf_dir, 4):
            s.put_df(b)
        rows = [(x["seq"], x["rows"], x["tombstones"], x["least"].decode(), x["most"].decode()) for x in s.layers()]
    return spark.createDataFrame(rows, "layer long, n long, tombstones long, least string, most string")
