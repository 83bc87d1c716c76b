"""The key-value engine against Python's dict and the cases that the survey lists."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lamella.cli import main
from lamella.facade import Lamella
from lamella.functions import model as M
from lamella.functions.bounds import bounds, successor, touches
from lamella.operators import patterns as P
from lamella.operators import resolve as R
from lamella.operators.compaction import pick_tier, tier_or_all
from lamella.operators.published import Published
from lamella.operators.store import Options, Store
from lamella.plans import catalogue as C
from lamella.sources.table import Corrupt, Table, merge_tables, write_table
from lamella.streaming.ingest import ingest


def rows(df):
    return [(bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in df.collect()]


def test_successor_and_bounds():
    assert [successor(x) for x in (b"", b"a", b"a\xff", b"\xff\xff")] == [None, b"b", b"b", None]
    assert bounds(prefix=b"a\xff") == (b"a\xff", b"b")
    assert bounds(prefix=b"\xff") == (b"\xff", None)
    assert bounds("b", "c", "b") == (b"b", b"c")
    assert touches(b"b", b"c", b"a", b"b") and not touches(b"b", b"c", b"c", b"d") and not touches(b"c", b"b", b"a", b"z") and not touches(None, None, None, None)


def test_tiers():
    assert pick_tier([2000] + [1] * 7, 16) == (1, 8)
    assert pick_tier([8, 4, 2, 1], 16) == (0, 4)
    assert pick_tier([100, 10, 1], 16) is None and tier_or_all([100, 10, 1], 8) == (0, 3)
    assert pick_tier([5] * 16, 16) == (0, 16) and pick_tier([1], 16) is None and pick_tier([], 16) is None


def test_resolve_equals_dict(spark):
    rnd, log, truth = random.Random(4), [], {}
    for seq in range(60):
        for o in range(rnd.randrange(1, 6)):
            k = bytes([rnd.choice([0, 97, 127, 128, 255])] * rnd.randrange(3))
            v = rnd.choice([None, b"", b"x", bytes([rnd.randrange(256)])])
            log.append((bytearray(k), None if v is None else bytearray(v), seq, o))
            truth[k] = v
    rnd.shuffle(log)
    df = spark.createDataFrame(log, M.LOG)
    live = {k: v for k, v in truth.items() if v is not None}
    for f in (R.resolve, R.resolve_unique):
        assert dict(rows(f(df))) == live and dict(rows(f(df, True))) == truth
    assert rows(R.scan(R.resolve(df))) == sorted(live.items())
    assert dict(rows(R.resolve(df.filter("false")))) == {}


def test_codecs(spark):
    cases = [b'{"a":1}', b"[1]", b"1", b"\xef\xbb\xbf{}", b"\xff", b"", b"{bad", b" {}"]
    got = M.decoded(spark.createDataFrame([(bytearray(c),) for c in cases], "value binary").withColumn("key", F.col("value"))).select("text", F.col("json").cast("string")).collect()
    assert [r[0] for r in got][4] is None and got[5][0] == ""
    assert [r[1] is not None for r in got] == [True, True, False, True, False, False, False, False]
    assert [M.decode_value(c) for c in cases] == [{"a": 1}, [1], "1", {}, b"\xff", "", "{bad", " {}"]
    assert M.encode_value({"a": "é"}) == '{"a":"é"}'.encode()
    keys = spark.range(3).select(F.element_at(F.array(*map(F.lit, (300, 50, 7))), (F.col("id") + 1).cast("int")).alias("n")).select("n", M.padded(F.col("n"), 8).alias("p"), M.big_endian(F.col("n")).alias("b"))
    assert [r["n"] for r in keys.orderBy("p").collect()] == [r["n"] for r in keys.orderBy("b").collect()] == [7, 50, 300]


@pytest.mark.parametrize("n", [0, 1000])
def test_table_round_trip(spark, tmp_path, n):
    t = write_table(spark, f"{tmp_path}/t", [(f"user:{i % 3}:{i:04}", f"v{i}") for i in range(n)])
    assert len(t) == t.check() == n and t.stats()["entries"] == n
    assert t.range("user:0:0100", "user:0:0200").count() == (33 if n else 0) and t.prefix("user:1:").count() == n // 3
    assert t.range("b", "a").count() == 0 and t.seek("zzz").count() == 0 and t.seek("").count() == n
    assert t.get("user:0:0003") == (b"v3" if n else None) and t.get("user") is None and not t.has("user:0:00031")
    assert [k for k, _ in t] == sorted(k for k, _ in t)
    with pytest.raises(FileExistsError):
        write_table(spark, f"{tmp_path}/t", [])


def test_table_edges(spark, tmp_path):
    t = write_table(spark, f"{tmp_path}/t", [("k", "old"), ("a", "1"), ("k", "new"), ("b", None), (b"\xff\x00", b"\xde\xad\xbe\xef"), ("", "empty key"), ("e", b""), ("big", b"\7" * 200_000)])
    assert t.get("k") == b"new" and t.get_entry("b") == (True, None) and t.get_entry("zz") == (False, None)
    assert t.get_utf8(b"\xff\x00") is None and t.get("") == b"empty key" and t.get("e") == b"" and len(t.get("big")) == 200_000
    assert len(t) == 7 and t.count_live() == 6 and t.prefix(b"\xff").count() == 1
    with pytest.raises(ValueError, match="key"):
        write_table(spark, f"{tmp_path}/u", [(b"\0" * 65_536, "v")])
    with pytest.raises(Exception, match="65535"):
        write_table(spark, f"{tmp_path}/u", spark.range(1).select(F.expr("cast(repeat('a', 65536) AS binary)").alias("key"), F.lit(None).cast("binary").alias("value")))
    for bad in ([("b", "1"), ("a", "2")], [("a", "1"), ("a", "2")]):
        with pytest.raises(ValueError, match="ascending"):
            write_table(spark, f"{tmp_path}/v", bad, strict=True)
    assert len(write_table(spark, f"{tmp_path}/w", [("a", "1"), ("b", "2")], strict=True)) == 2
    got = t.multi_get(M.entries(spark, [("k", b""), ("b", b""), ("no", b"")]).select("key")).collect()
    assert {bytes(r["key"]): r["found"] for r in got} == {b"k": True, b"b": False, b"no": False}


def test_corruption_is_told(spark, tmp_path):
    t = write_table(spark, f"{tmp_path}/t", [(f"key:{i:06}", random.Random(i).randbytes(200)) for i in range(500)], partitions=1)
    part = next(tmp_path.glob("t/part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[30_000] ^= 1  # in a data page; the middle of the file is the bloom filter
    part.write_bytes(data)
    for crc in tmp_path.glob("t/.part-*.crc"):
        crc.unlink()
    with pytest.raises(Corrupt):
        t.check()
    part.unlink()
    with pytest.raises(Corrupt, match="manifest|read"):
        Table(spark, f"{tmp_path}/t").check()
    with pytest.raises(Corrupt, match="no table"):
        Table(spark, f"{tmp_path}/none")
    (tmp_path / "g").mkdir()
    (tmp_path / "g/_table.json").write_text("{")
    with pytest.raises(Corrupt, match="cut off"):
        Table(spark, f"{tmp_path}/g")


def test_merge(spark, tmp_path):
    for name, data in {"a": [("a", "old-a"), ("b", "old-b"), ("c", "old-c")], "b": [("b", "new-b"), ("d", "new-d")], "c": [("a", "newest-a"), ("e", None)], "z": []}.items():
        write_table(spark, f"{tmp_path}/{name}", data)
    paths = [f"{tmp_path}/{x}" for x in "abcz"]
    assert merge_tables(spark, paths, f"{tmp_path}/out") == 5
    assert rows(Table(spark, f"{tmp_path}/out").scan()) == [(b"a", b"newest-a"), (b"b", b"new-b"), (b"c", b"old-c"), (b"d", b"new-d"), (b"e", None)]
    with pytest.raises(ValueError, match="one of the inputs"):
        merge_tables(spark, paths, paths[0])


def test_store_crud_reopen_compact(spark, tmp_path):
    path, opts = f"{tmp_path}/s", Options(compact_threshold=0, flush_entries=5)
    with Store(spark, path, opts) as s:
        s.put({"a": "1", "c": "3"})
        s.put([("b", "2"), ("a", "0"), ("a", "1-new")])
        s.delete(["c", "never"])
        with pytest.raises(RuntimeError, match="locked"):
            Store(spark, path)
    with Store(spark, path, opts) as s:  # from the log
        assert list(s) == [(b"a", b"1-new"), (b"b", b"2")] and s.memtable_len() == 4
        s.put({"d": "4"})
        assert s.layer_count() == 1 and s.memtable_len() == 0
        s.put({"b": None})
        assert s.get("b") is None and s.get_entry("b") == (True, None) and s.get_entry("x") == (False, None)
        s.put_df(M.entries(spark, {"e": "5", "a": "2"}))
        assert [k for k, _ in rows(s.range("a", "e"))] == [b"a", b"d"] and s.layer_count() == 3
        assert s.compact() == 1 and list(s) == [(b"a", b"2"), (b"d", b"4"), (b"e", b"5")]
        assert s.vacuum() >= 3 and list(s.prefix("d").collect())[0]["value"] == b"4"
    with pytest.raises(RuntimeError, match="closed"):
        s.put({"a": "1"})


def test_store_log_survives_a_torn_write(spark, tmp_path):
    path = f"{tmp_path}/s"
    with Store(spark, path) as s:
        s.put({"a": "1"})
    (tmp_path / "s/log/99999999999999999999.json").write_text("{\"rows\": [")
    with Store(spark, path) as s:
        assert s.get("a") == b"1"


def test_merge_beside_flush_keeps_order(spark, tmp_path):
    """A layer added while older ones are merged stays newer than their merge."""
    with Store(spark, f"{tmp_path}/s", Options(compact_threshold=0, flush_entries=1)) as s:
        s.put({"k": "1"})
        s.put({"k": "2"})
        old = s.manifests.newest()["layers"]
        view = s.view()  # pinned
        s.put({"k": "3"})
        assert s._merge(old) and s.layer_count() == 2 and s.get("k") == b"3"
        assert rows(view) == [(b"k", b"2")]
        assert not s._merge(old)


def test_background_compaction(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s", Options(compact_threshold=3, flush_entries=2)) as s:
        for r in range(5):
            s.put({f"r{r}:{j}": f"v{r}-{j}" for j in range(2)})
        s.wait()
        assert s.layer_count() < 5 and len(list(s)) == 10


def test_published_snapshot_isolation(spark, tmp_path):
    p = Published(spark, f"{tmp_path}/app")
    with pytest.raises(FileNotFoundError):
        p.snapshot()
    assert len(p.save()) == 0
    p.put({f"k:{i:03}": str(i) for i in range(10)})
    p.save()
    old = p.snapshot()
    p.put({"k:000": "new"})
    p.delete(["k:001"])
    p.save()
    assert old.get("k:000") == b"0" and old.count_live() == 10
    assert p.snapshot().get("k:000") == b"new" and p.snapshot().count_live() == 9
    p.export_and_close()
    assert not (tmp_path / "app.store").exists()
    q = Published(spark, f"{tmp_path}/app")  # seeded from the table alone
    assert q.get("k:000") == b"new" and q.get("k:001") is None
    q.close()


def test_facade(spark, tmp_path):
    with Lamella(spark, f"{tmp_path}/db", durability="fast") as db:
        db.set("user:1", {"name": "Ann", "n": [1, 2]})
        db.set_many({"note": "text", "ข้อมูล": "日本", "bin": b"\xff\x00", "a": "1"})
        db.delete("a")
        db.delete()
        assert db.get("user:1") == {"name": "Ann", "n": [1, 2]} and db.get("bin") == b"\xff\x00" and db.get("ข้อมูล") == "日本"
        assert db.get("a") is None and not db.has("a") and db.get_utf8("bin") is None and db.get_bytes("note") == b"text"
        assert [k for k, _ in db.prefix("user:")] == [b"user:1"] and len(list(db)) == 4 and next(db.seek("note"))[1] == "text"
        assert db.view().filter("json IS NOT NULL").count() == 1
    assert len(list(Lamella(spark, f"{tmp_path}/db"))) == 4


def test_patterns(spark):
    s = M.entries(spark, {"s:1": json.dumps({"exp": 5}), "s:2": json.dumps({"exp": 50}), "s:3": "none"})
    assert rows(P.expired(s, 10)) == [(b"s:1", None)]
    changes = spark.createDataFrame([("n", 2), ("n", 3), ("m", 1)], "k string, amount long").select(F.col("k").cast("binary").alias("key"), "amount")
    once = P.increments(changes)
    assert dict(rows(P.increments(changes, once))) == {b"n": b"10", b"m": b"2"}
    data = bytes(random.Random(1).randbytes(700))
    blobs = spark.createDataFrame([("v", bytearray(data)), ("e", bytearray(b""))], "name string, value binary")
    chunks = P.chunked(blobs, 256)
    assert chunks.count() == 4 and {r["name"]: bytes(r["value"]) for r in P.reassembled(chunks).collect()} == {"v": data, "e": b""}


def test_chunks_beyond_the_digits(spark):
    data = bytes(random.Random(2).randbytes(1234))
    chunks = P.chunked(spark.createDataFrame([("a:b", bytearray(data)), ("c", bytearray(data[:50]))], "name string, value binary"), 1, digits=2)
    assert chunks.select("key").distinct().count() == 1284
    assert {r["name"]: bytes(r["value"]) for r in P.reassembled(chunks.orderBy(F.rand(1))).collect()} == {"a:b": data, "c": data[:50]}


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        M.entries(spark, {"k": f"v{i}", f"k{i}": None if i == 1 else "x"}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with Store(spark, f"{tmp_path}/s", Options(compact_threshold=0)) as s:
        stream = spark.readStream.schema("key binary, value binary, ord long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest(stream, s, f"{tmp_path}/ck").awaitTermination(120)
        assert s.layer_count() == 3 and s.get("k0") == b"x" and s.get("k1") is None and s.has("k")
        assert not s.put_df(M.entries(spark, {"k": "again"}), "ingest:0") and s.layer_count() == 3


def test_old_batches_stay_applied(spark, tmp_path):
    with Store(spark, f"{tmp_path}/s", Options(compact_threshold=0)) as s:
        put = lambda v, *a, **k: s.put_df(M.entries(spark, {"k": v}), *a, **k)
        assert put("1", "slow:0", rising=True) and put("1", "load:7") and put("1", "load:5")

        def aged(m):  # as after very many batches of another stream and loads
            m["applied"] = [*m["applied"], *(f"x{i}" for i in range(10_001))]
            return m

        s.manifests.commit(aged)
        assert put("2", "fast:10001", rising=True) and put("3")
        assert not any((put("4", "slow:0", rising=True), put("4", "fast:17", rising=True), put("4", "load:7"), put("4", "x0")))
        assert put("5", "slow:1", rising=True) and put("6", "load:6") and s.get("k") == b"6"


def test_cli(spark, tmp_path):
    write_table(spark, f"{tmp_path}/t", [*((f"key:{i:06}", f"value-of-{i}") for i in range(120)), ("gone", None), ("long", "x" * 300)])

    def run(*argv):
        out, err = io.StringIO(), io.StringIO()
        return main(list(argv), spark, out, err), out.getvalue(), err.getvalue()

    t = f"{tmp_path}/t"
    assert run("check", t)[:2] == (0, "ok: 122 entries\n")
    assert "entries: 122" in run("stats", t)[1]
    code, out, err = run("dump", t)
    assert len(out.splitlines()) == 100 and err == "22 more\n" and "gone\t<tombstone>" in out
    assert run("dump", t, "--prefix", "key:00001", "--keys-only", "--limit", "3")[1] == "key:000010\nkey:000011\nkey:000012\n"
    assert "<300 bytes>" in run("dump", t, "--start", "long")[1]
    assert run("get", t, "key:000007")[1] == "value-of-7" and run("get", t, "gone")[0] == run("get", t, "no")[0] == 1
    assert run("get", t, "gone")[2] != run("get", t, "no")[2]
    assert run("merge", f"{tmp_path}/m", t, t, "--compress")[1] == "2 tables, 122 entries\n"
    assert run("help")[0] == 0 and run()[0] == 0 and run("frob")[0] != 0 and run("check", f"{tmp_path}/none")[0] == 1


def test_pushdown(spark, tmp_path):
    """Key bounds reach the scan of a resolved view."""
    t = write_table(spark, f"{tmp_path}/t", {f"{i:04}": "v" for i in range(100)})
    plan = R.scan(R.resolve(R.stacked([t.raw, t.raw])), prefix="00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(key") == 2 and plan.count("LessThan(key") == 2


def test_merging_takes_one_exchange(spark, tmp_path):
    a, b = (write_table(spark, f"{tmp_path}/{x}", {"k": x}) for x in "ab")
    plan = R.resolve(R.stacked([a.raw, b.raw]).repartitionByRange("key"), True).sortWithinPartitions("key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def placed_in_ranges(spark, path, query, numbers):
    """What ``query`` makes of orders with ``numbers``, beside what its SQL says, nulls last; small ranges stay apart as large ones do."""
    spark.createDataFrame([(n,) for n in numbers], "o_orderkey long").write.parquet(f"{path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(((r["place"], r["n"]) for r in query(spark, str(path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return got, list(enumerate(sorted(numbers, key=lambda n: (n is None, n or 0)), 1))


def test_padded_keys_are_placed_as_numbers(spark, tmp_path):
    numbers = [i * 7919 % 20011 for i in range(20000)] + [5, 5, None, None]
    got, want = placed_in_ranges(spark, tmp_path / "many", C.key_design_padded, numbers)
    assert got == want
    got, want = placed_in_ranges(spark, tmp_path / "none", C.key_design_padded, [])
    assert got == want == []


def test_big_endian_keys_are_placed_as_numbers(spark, tmp_path):
    numbers = [i * 7919 % 20011 << (i % 48) for i in range(20000)] + [2**63 - 1]  # beyond the digits of padded keys
    got, want = placed_in_ranges(spark, tmp_path, C.key_design_u64be, numbers)
    assert got == want
