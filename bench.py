"""Headline figures: prints one JSON line. BENCH_SF_DIR is the table folder, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lamella.operators import resolve as R
    from lamella.operators.published import Published
    from lamella.operators.store import Options
    from lamella.plans import catalogue as C
    from lamella.sources.table import write_table

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name: str, action, rows: int = 0, repeat: int = 2):
        best = None
        for _ in range(repeat):  # the better of two: the first compiles
            t = time.time()
            out = action()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 3)
        if rows:
            rates[name] = round(rows / best)
        return out

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    with tempfile.TemporaryDirectory() as tmp:
        n = [0]

        def fresh() -> str:
            n[0] += 1
            return f"{tmp}/t{n[0]}"

        # the published workload: 100,000 entries of 100 bytes
        entries = spark.range(100_000).select(F.format_string("key:%010d", "id").cast("binary").alias("key"), F.rpad(F.col("id").cast("string"), 100, "x").cast("binary").alias("value")).cache()
        entries.count()
        table = timed("build_100k", lambda: write_table(spark, fresh(), entries, unique=True), 100_000)
        timed("iterate_100k", lambda: sink(table.scan()), 100_000)
        timed("point_get_hit", lambda: table.get("key:0000050000"))
        timed("point_get_miss", lambda: table.get("key:x"))
        timed("range_1000", lambda: sink(table.range("key:0000050000", "key:0000051000")), 1000)
        keys = entries.select("key").sample(0.5, 7).cache()
        timed("multi_get_50k", lambda: sink(table.multi_get(keys)), keys.count())

        # the same a hundred times larger, where rates mean something: a job's fixed cost is most of the figures above
        n_large = int(os.environ.get("BENCH_LARGE", "10000000"))
        large = spark.range(n_large).select(F.format_string("key:%010d", "id").cast("binary").alias("key"), F.rpad(F.col("id").cast("string"), 100, "x").cast("binary").alias("value"))
        wide = timed("build_10m", lambda: write_table(spark, fresh(), large, unique=True), n_large, 1)
        timed("iterate_10m", lambda: sink(wide.scan(ordered=False)), n_large, 1)
        some = large.select("key").sample(0.1, 7)
        timed("multi_get_1m_of_10m", lambda: sink(wide.multi_get(some)), n_large // 10, 1)
        timed("range_100k_of_10m", lambda: sink(wide.range("key:0005000000", "key:0005100000")), 100_000, 1)
        timed("point_get_of_10m", lambda: wide.get("key:0005000000"))

        log = C.log_of(spark, sf_dir).cache()
        size = log.count()
        timed("resolve_live", lambda: sink(R.resolve(log)), size)
        timed("resolve_live_by_position", lambda: sink(R.resolve_unique(log)), size)
        orders = C.orders_kv(spark, sf_dir).cache()
        m = orders.count()
        timed("merge_two", lambda: sink(R.merge([orders, orders.filter("n % 2 = 0")])), m + m // 2)

        def layered():
            p = Published(spark, fresh(), Options(compact_threshold=0))
            for i in range(3):
                p.store.put_df(orders.filter(f"n % 3 = {i}"), unique=True)
            p.store.compact()
            p.close()

        timed("store_put_and_compact", layered, m, 1)
        for name in ("scan_all", "prefix_scan", "multi_get", "chunk_reassemble"):
            timed(name, lambda name=name: sink(C.QUERIES[name](spark, sf_dir)))
    print(json.dumps({"metric": "total of the key-value headline queries (without those on 10 million rows)", "value": round(sum(v for k, v in took.items() if "10m" not in k), 3), "unit": "sec", "queries": took, "rows_per_second": rates, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
