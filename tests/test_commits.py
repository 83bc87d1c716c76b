"""Commits, vacuum, the log, and what must fail instead of losing data."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lamella.facade import Lamella
from lamella.functions import model as M
from lamella.operators import patterns as P
from lamella.operators import resolve as R
from lamella.operators.store import Options, Store
from lamella.sources.files import Corrupt, Files, sealed, unsealed
from lamella.sources.manifest import Manifests
from lamella.sources.table import Builder, Table, write_table

QUIET = Options(compact_threshold=0)


def rows(df):
    return [(bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in df.collect()]


def add(name):
    def change(m):
        m["layers"].append(name)
        return m

    return change


def test_a_commit_between_two_listings_is_kept(spark, tmp_path):
    """Another writer commits while this one is between reading and writing, as often as it likes."""
    a, b = Manifests(spark, f"{tmp_path}/s"), Manifests(spark, f"{tmp_path}/s")
    a.commit(add("base"))
    left = [0, 1, 2]

    def slow(m):
        if left:
            b.commit(add(f"other{left.pop(0)}"))
        return add("mine")(m)

    a.commit(slow)
    assert a.newest()["layers"] == ["base", "other0", "other1", "other2", "mine"]
    listed = a.versions

    def late():  # a commit right after the listing that a commit begins with
        out = listed()
        if not late.done:
            late.done = True
            b.commit(add("late"))
        return out

    late.done = False
    a.versions = late
    a.commit(add("last"))
    assert b.newest()["layers"][-2:] == ["late", "last"] and b.newest()["parent"] == b.newest()["version"] - 1


def test_many_writers_lose_nothing(spark, tmp_path):
    Manifests(spark, f"{tmp_path}/s")

    def writer(i):
        m = Manifests(spark, f"{tmp_path}/s")
        for k in range(5):
            m.commit(add(f"{i}.{k}"))

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = Manifests(spark, f"{tmp_path}/s").newest()["layers"]
    assert sorted(found) == sorted(f"{i}.{k}" for i in range(6) for k in range(5))


def test_damaged_and_unfinished_versions(spark, tmp_path):
    m = Manifests(spark, f"{tmp_path}/s")
    m.commit(add("a"))
    m.commit(add("b"))
    newest = tmp_path / "s/manifest/0000000002.json"
    good = newest.read_bytes()
    (tmp_path / "s/manifest/0000000003.json").write_bytes(good[: len(good) // 2])  # never finished
    assert m.newest()["layers"] == ["a", "b"]
    assert m.commit(add("c"))["version"] == 4 and m.newest()["layers"] == ["a", "b", "c"]
    path = tmp_path / "s/manifest/0000000004.json"
    path.write_bytes(path.read_bytes().replace(b'"c"', b'"x"'))
    with pytest.raises(Corrupt, match="checksum"):
        m.newest()
    assert unsealed(sealed({"a": "\n"}), "x") == {"a": "\n"} and unsealed(b"", "x") is None


@pytest.mark.parametrize("scheme", ["file", "hdfs"])
def test_create_publishes_once(spark, tmp_path, scheme):
    f = Files(spark, str(tmp_path))
    f.scheme = scheme  # "hdfs": by a rename that overwrites nothing
    assert f.create(f"file://{tmp_path}/x", b"one") and not f.create(f"file://{tmp_path}/x", b"two")
    assert (tmp_path / "x").read_bytes() == b"one" and f.names(str(tmp_path)) == ["x"]


def test_flush_beside_background_merges(spark, tmp_path):
    truth = {}
    with Store(spark, f"{tmp_path}/s", Options(compact_threshold=2, flush_entries=3)) as s:
        rnd = random.Random(3)
        for i in range(12):
            batch = {f"k{rnd.randrange(9)}": f"v{i}.{j}" for j in range(3)}
            s.put(batch)
            truth |= batch
        s.wait()
        assert {k.decode(): v.decode() for k, v in s} == truth
        seqs = [x["seq"] for x in s.manifests.newest()["layers"]]
        assert seqs == sorted(seqs)


def test_vacuum_waits_for_a_merge(spark, tmp_path):
    """A merge that has written its table but not committed it yet keeps it."""
    s = Store(spark, f"{tmp_path}/s", Options(compact_threshold=0))
    for i in range(3):
        s.put_df(M.entries(spark, {"a": str(i), f"k{i}": "x"}))
    s.options = Options(compact_threshold=3)
    commit, there = s.manifests.commit, threading.Event()

    def late(change):
        there.set()
        time.sleep(1.5)
        return commit(change)

    s.manifests.commit = late
    s.compact_async()
    assert there.wait(60)
    assert s.vacuum() == 3 and s.layer_count() == 1
    assert dict(rows(s.view())) == {b"a": b"2", b"k0": b"x", b"k1": b"x", b"k2": b"x"}
    s.close()


def test_vacuum_spares_what_others_write(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        s.put_df(M.entries(spark, {"a": "1"}))
        write_table(spark, f"{tmp_path}/s/layers/elsewhere", {"b": "1"})  # another writer's, about to be committed
        assert s.vacuum(spare_seconds=3600) == 0 and len(Table(spark, f"{tmp_path}/s/layers/elsewhere")) == 1
        assert s.vacuum() == 1 and s.get("a") == b"1"


def test_as_of(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        for i in range(4):
            s.put_df(M.entries(spark, {"a": str(i), f"k{i}": "x"}))
        first = s.versions()[0]
        want = {b"a": b"1", b"k0": b"x", b"k1": b"x"}
        assert dict(rows(s.as_of(2))) == want
        s.compact()
        assert dict(rows(s.as_of(2))) == want and dict(rows(s.as_of(4)))[b"a"] == b"3"
        assert dict(rows(s.view(version=first))) == {b"a": b"0", b"k0": b"x"}
        s.vacuum()
        with pytest.raises(ValueError, match="merged"):
            s.as_of(2)
        with pytest.raises(ValueError, match="no layer"):
            s.as_of(9)
        with pytest.raises(ValueError, match="not kept"):
            s.view(version=first)
        assert dict(rows(s.as_of(4)))[b"a"] == b"3"


def test_no_last_row_without_order(spark, tmp_path):
    df = spark.createDataFrame([("k", "1"), ("k", "2"), ("a", "0")], "key string, value string")
    for f in (lambda: write_table(spark, f"{tmp_path}/t", df), lambda: write_table(spark, f"{tmp_path}/u", df, unique=True)):
        with pytest.raises(Exception, match="occurs twice"):
            f()
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="ord"):
        write_table(spark, f"{tmp_path}/v", df, strict=True)
    ordered = df.withColumn("ord", F.when(F.col("value") == "1", 5).otherwise(3))
    assert rows(write_table(spark, f"{tmp_path}/w", ordered).scan()) == [(b"a", b"0"), (b"k", b"1")]
    ties = spark.createDataFrame([("k", "1", 1), ("k", None, 1), ("k", "2", 1)], "key string, value string, ord long")
    assert rows(write_table(spark, f"{tmp_path}/x", ties).scan()) == [(b"k", b"2")]
    with Store(spark, f"{tmp_path}/s", QUIET) as s, pytest.raises(Exception, match="occurs twice"):
        s.put_df(df)


def test_numbers_that_do_not_fit(spark):
    n = spark.createDataFrame([(7,), (123456,)], "n long")
    assert [bytes(r[0]) for r in n.select(M.padded(F.col("n"), 6)).collect()] == [b"000007", b"123456"]
    for f, what in ((lambda: M.padded(F.col("n"), 5), "fit"), (lambda: M.padded(-F.col("n"), 12), "fit"), (lambda: M.big_endian(-F.col("n")), "negative")):
        with pytest.raises(Exception, match=what):
            n.select(f()).collect()


def test_very_many_chunks(spark):
    data = bytes(range(256)) * 470  # 120,320 chunks of a byte: past five digits
    blobs = spark.createDataFrame([("v", bytearray(data))], "name string, value binary")
    chunks = P.chunked(blobs, 1)
    assert chunks.select("key").distinct().count() == len(data)
    assert bytes(P.reassembled(chunks).first()["value"]) == data


def test_log_order_is_not_the_clocks(spark, tmp_path, monkeypatch):
    clock = iter(range(10**6, 0, -1))
    monkeypatch.setattr(time, "time_ns", lambda: next(clock))
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        for i in range(4):
            s.put({"k": str(i)})
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        assert s.get("k") == b"3"
        s.put({"k": "4"})
    logs = sorted((tmp_path / "s/log").iterdir())
    assert [int(p.stem) for p in logs] == [1, 2, 3, 4, 5]
    logs[3].write_bytes(logs[3].read_bytes()[:-20])
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        assert s.get("k") == b"2"  # up to the first that is not whole
        s.put({"k": "5"})
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        assert s.get("k") == b"5"


def test_balanced_writes_by_itself(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", Options(compact_threshold=0, durability="balanced", sync_seconds=0.3))
    s.put({"a": "1"})
    s.put({"b": "2"})
    assert not list((tmp_path / "s/log").iterdir())
    time.sleep(1.5)
    assert len(list((tmp_path / "s/log").iterdir())) == 1  # no call since
    s._lock_file.close()  # as if the process had died
    with Store(spark, f"{tmp_path}/s", QUIET) as t:
        assert dict(rows(t.view())) == {b"a": b"1", b"b": b"2"}


def test_builder(spark, tmp_path):
    with Builder(spark, f"{tmp_path}/t", most_bytes=200) as b:
        for i in range(50):
            b.add(f"k{i:03}", f"v{i}")
        b.add_tombstone("z")
        with pytest.raises(ValueError, match="ascending"):
            b.add("k", "1")
    t = Table(spark, f"{tmp_path}/t")
    assert len(t) == t.check() == 51 and t.get_entry("z") == (True, None) and t.get("k049") == b"v49"
    with pytest.raises(RuntimeError, match="finished"):
        b.add("zz", "1")
    with pytest.raises(KeyError), Builder(spark, f"{tmp_path}/u", most_bytes=10) as b:
        b.add("a", "1")
        raise KeyError
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert len(Builder(spark, f"{tmp_path}/e").finish()) == 0


def test_stats_say_bloom_and_it_follows_the_keys(spark, tmp_path):
    small, large = (write_table(spark, f"{tmp_path}/{n}", spark.range(n).selectExpr("cast(lpad(id, 9, '0') AS binary) AS key", "cast(null AS binary) AS value"), unique=True, partitions=1) for n in (50, 60_000))
    a, b = small.stats()["bloom_bytes"], large.stats()["bloom_bytes"]
    assert 0 < a < b and b >= 60_000 and large.stats()["tombstones"] == 60_000 and large.count_live() == 0


def test_multi_get_of_a_store(spark, tmp_path):
    """Layers outside the keys' bounds are not opened, and the keys stand below the aggregate."""
    with Store(spark, f"{tmp_path}/s", QUIET) as s:
        s.put_df(M.entries(spark, {f"a{i:03}": "1" for i in range(100)}))
        s.put_df(M.entries(spark, {f"a{i:03}": None if i % 2 else "2" for i in range(50)}))
        s.put_df(M.entries(spark, {f"x{i:03}": "3" for i in range(100)}))
        keys = spark.createDataFrame([("a001", 1), ("a010", 2), ("a070", 3), ("a0701", 4), ("a010", 5), (None, 6)], "key string, n int").select(F.col("key").cast("binary").alias("key"), "n")
        d = s.multi_get(keys)
        assert {r["n"]: (r["found"], r["value"] and bytes(r["value"])) for r in d.collect()} == {1: (False, None), 2: (True, b"2"), 3: (True, b"1"), 4: (False, None), 5: (True, b"2"), 6: (False, None)}
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 2 and plan.index("Aggregate [key") < plan.index("LeftSemi")
        assert "GreaterThanOrEqual(key" in d._jdf.queryExecution().executedPlan().toString()
        large, R.SENT_KEYS = R.SENT_KEYS, 2
        try:  # more keys than are sent: by exchange
            e = s.multi_get(keys)
            assert sorted(map(str, e.collect())) == sorted(map(str, d.collect()))
        finally:
            R.SENT_KEYS = large
        assert s.multi_get(keys.filter("false")).count() == 0 and s.multi_has(keys).count() == 3
    with Lamella(spark, f"{tmp_path}/db") as db:
        db.set_many({"a010": {"n": 1}})
        assert {r["n"]: r["found"] for r in db.multi_get(keys).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_a_build_of_unique_keys_takes_one_exchange(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"))], M.ENTRY)
    plan = R.unique(df.repartitionByRange("key")).sortWithinPartitions("key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_old_json_is_no_version(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/_table.json").write_text(json.dumps({"format": 1}))
    with pytest.raises(Corrupt, match="cut off"):
        Table(spark, f"{tmp_path}/t")
