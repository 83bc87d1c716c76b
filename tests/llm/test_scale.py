"""What holds at any size: exchanges instead of broadcasts, blocks, any number of queues, bounded batches, exact optima."""

import collections
import heapq
import os
import random
import subprocess
import sys
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import bpe, chroma, common, dart_minhash, hilbert, line_dedup, packing, quality, toxicity
from tests.llm.test_text import check_packing, docs_of, nothing, odd, odd_rows, weighted  # noqa: F401


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture
def exchanged(monkeypatch):
    """Every join exchanges both sides."""
    monkeypatch.setattr(common, "MOST_SENT", 0)


# -- joins by exchange give what broadcasts give


def test_results_without_broadcasts(spark, odd, exchanged):  # noqa: F811
    rows = [r for r in odd_rows() if r[0] not in (1, 21, None)]
    check_packing(packing.pack(docs_of(spark, rows), window=512, quantum=64).collect(), [t for _, t, _, _ in rows], 512)
    got = hilbert.shards(odd, 5).collect()
    assert len(got) == odd.count() and len({(r.shard, r.slot) for r in got}) == len(got)
    assert dart_minhash.near_dedup_stage(odd).count() + 3 == odd.count()
    assert line_dedup.line_dedup_stage(odd).count() == odd.count() - 3
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.quality_stage(odd, marks).count() < odd.count() == quality.quality(odd, marks).count()
    assert toxicity.toxicity(odd, marks).count() == odd.count()


def test_the_package_travels_whole():
    """An interpreter that has only the archive can import every module of it."""
    names = sorted({x[:-3].replace("/", ".") for x in zipfile.ZipFile(common.package()).namelist() if x.endswith(".py") and not x.endswith("__init__.py")})
    assert "lamella.llm.packing" in names and "lamella.operators.store" in names
    said = subprocess.run([sys.executable, "-c", f"import sys, importlib; sys.path.insert(0, {common.package()!r})\nfor n in {names!r}: assert 'lamella.zip' in importlib.import_module(n).__file__"], cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_batches_are_bounded_in_bytes(spark):
    """Long texts come a few at a time, a text beyond the bound alone."""
    common.importable(spark)
    long = spark.range(0, 60, 1, 1).selectExpr("repeat('a', 500000) AS text").union(spark.range(0, 2, 1, 1).selectExpr("repeat('b', 9000000) AS text"))
    sizes = [r["n"] for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) > 48_000_000 and sorted(sizes)[-3] <= 5_000_000 and max(sizes) < 10_000_000 + common.BATCH


# -- packing


def stream(totals, weights, quantum):
    """Deficit round-robin, quantum by quantum: the one that is owed half a quantum first goes out."""
    heap = [((min(quantum, t) / 2) / w, s, 0) for s, (t, w) in enumerate(zip(totals, weights, strict=True)) if t]
    heapq.heapify(heap)
    out = []
    while heap:
        _, s, j = heapq.heappop(heap)
        out.append((s, j, min(quantum, totals[s] - j * quantum)))
        at = (j + 1) * quantum
        if at < totals[s]:
            heapq.heappush(heap, ((at + min(quantum, totals[s] - at) / 2) / weights[s], s, j + 1))
    return out


def test_places_are_those_of_the_walk():
    rnd = np.random.default_rng(2)
    for weights in (None, rnd.uniform(0.1, 5, 7)):
        totals = rnd.integers(1, 9000, 7)
        w = totals.astype(float) if weights is None else weights
        walk = stream(totals.tolist(), w.tolist(), 64)
        before = np.cumsum([0, *(n for _, _, n in walk)])[:-1]
        queue, j = (np.array([x[k] for x in walk]) for k in (0, 1))
        assert packing.stream_place(queue, j, totals, w, 64).tolist() == before.tolist()


@pytest.mark.parametrize("most", [packing.MOST_QUEUES, 3])
def test_weights_hold_until_queues_run_dry(spark, most):
    """Targets far from the natural shares; the counted and the sorted way give the same pieces."""
    rnd = random.Random(4)
    docs = docs_of(spark, [(i, prose(rnd, 60), "en", f"s{i % 4}") for i in range(200)])
    weights = {"s0": 6.0, "s1": 1.0, "s2": 1.0, "s3": 0.5}
    got = packing.pack(docs, weights, window=512, quantum=64, most_queues=most).collect()
    check_packing(got, [r.text for r in docs.collect()], 512)
    by = np.zeros((1 + max(r.sequence_id for r in got), 4))
    for r in got:
        by[r.sequence_id, int(r.source[1])] += r.length
    total, share = by.sum(0), np.array(list(weights.values()))
    out = by.cumsum(0)
    for k in range(len(by)):
        live = out[k] < total - 64  # the others are exhausted, and earn no more
        if live.all():
            assert np.abs(out[k] - out[k].sum() * share / share.sum()).max() <= 128
        elif live.sum() > 1 and k and (out[k - 1] < total - 64).tolist() == live.tolist():
            assert np.abs(by[k][live] - by[k][live].sum() * share[live] / share[live].sum()).max() <= 192
    if most == 3:
        other = packing.pack(docs, weights, window=512, quantum=64).collect()
        key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.ids_crc32)
        # documents of a source keep the order of the scan either way
        assert collections.Counter(map(key, got)) == collections.Counter(map(key, other))


def test_very_many_sources(spark):
    docs = docs_of(spark, [(i, f"text number {i} here", "en", f"site{i}") for i in range(1500)])
    got = packing.pack(docs, window=256, quantum=32).collect()  # more than MOST_QUEUES
    check_packing(got, [r.text for r in docs.collect()], 256)


def test_pieces_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(packing, "BATCH", 1 << 14)
    n = 50_000
    ids = np.arange(n, dtype=np.uint16).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "a"]), pa.array(["sa", "sa"]), pa.array([0, n]), pa.array([n, n]), pa.array([ids, ids], pa.binary()), pa.array([0, 0])], ["doc_id", "source", "queue", "before", "n", "ids", "first"])
    out = [x for part in packing.slices(batch, 1 << 12) for x in packing.cut(part, np.zeros(part.num_rows, np.int64), np.array([2 * n]), np.array([1.0]), 4096, 256)]
    assert sum(sum(x.column("length").to_pylist()) for x in out) == 2 * n and max(x.nbytes for x in out) < 1 << 16
    whole = b"".join(i for x in out for d, i in zip(x.column("doc_id").to_pylist(), x.column("ids").to_pylist(), strict=True) if d == 1)
    assert (np.frombuffer(whole, "<u4") == np.arange(n) % (1 << 16)).all()


def test_encoder_keeps_a_bounded_cache(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_CHARS", 5000)
    enc = bpe.Encoder(packing.WORD_BPE, True)
    rnd = random.Random(1)
    for _ in range(20):
        enc.encode([prose(rnd, 800, 10**6)])
        assert enc.chars <= 5000 + 8 * 800 and enc.chars == sum(map(len, enc.at))


# -- near duplicates


def test_large_groups_are_cut_into_neighbours(spark):
    """A chain of texts, each near the next only, and a group around one text: in blocks, classes are those of all pairs."""
    rnd = random.Random(3)
    base = [f"c{rnd.randrange(10**6)}" for _ in range(160)]
    rows = []
    for k in range(40):  # neighbours share 95 % of their words, ends nothing
        rows.append((k, " ".join(base[3 * k :] + [f"x{j}" for j in range(3 * k)]), "en", "a"))
    star = [f"s{rnd.randrange(10**6)}" for _ in range(150)]
    for k in range(60):
        t = list(star)
        for _ in range(2):
            t[rnd.randrange(len(t))] = f"n{rnd.randrange(10**6)}"
        rows.append((1000 + k, " ".join(t), "en", "a"))
    rows += [(5000 + k, prose(rnd, 100, 10**6), "en", "a") for k in range(10)]
    rnd.shuffle(rows)
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs_of(spark, rows), block_docs=16, least_docs=4).collect()}
    sets = {i: weighted(t) for i, t, _, _ in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < 40


def test_stage_keeps_rows_without_words_and_one_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, text), (3, text), (7, None), (7, None), (8, ""), (8, ""), (None, ""), (None, None), (-1, text + " more"), (None, text), (9, "other words are here"), (9, "other words are here")]
    got = collections.Counter((r.doc_id, r.text) for r in dart_minhash.near_dedup_stage(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(7, None): 2, (8, ""): 2, (None, ""): 1, (None, None): 1, (-1, text + " more"): 1, (9, "other words are here"): 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    got = {r["node"]["a"]: r["label"]["a"] for r in common.components(spark.createDataFrame(edges, "a long, b long").select(F.struct(F.col("a")).alias("a"), F.struct(F.col("b").alias("a")).alias("b"))).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# -- shards


def test_shards_follow_the_curve(spark):
    rnd = random.Random(6)
    docs = docs_of(spark, [(i, prose(rnd, rnd.randrange(1, 300)), rnd.choice(["en", "de", None]), f"s{rnd.randrange(5)}") for i in range(400)] + [(7, "copy", "en", "s1")] * 50)
    got = sorted(hilbert.shards(docs, 13).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    for r in got:
        assert r.curve == hilbert.curve_index([np.array([r.source_cell]), np.array([r.lang_cell]), np.array([r.size_cell])])[0]
    kinds = lambda shard: sum(len({(r.source_cell, r.lang_cell) for r, s in zip(got, shard, strict=True) if s == k}) for k in range(13)) / 13
    order = [r.shard for r in got]
    assert kinds(order) < 0.5 * kinds(rnd.sample(order, len(order)))  # a shard holds few kinds, so that readers prune
    assert sum(b.n for b in hilbert.boxes(hilbert.shards(docs, 13)).collect()) == 450


# -- quality


def test_null_language_is_no_language(spark):
    rows = [(i, "en" if i % 2 else None, 1, 0 if i % 2 else 900) for i in range(2000)] + [(5000 + i, "", 0, 900) for i in range(2000)]
    m = spark.createDataFrame([(i, s, v, 0, 0, 0, False) for i, s, _, v in rows], "doc_id long, lang string, symbol_rate int, upper_rate int, dup_line_rate int, repeat_rate int, base_failed boolean")
    cuts = quality.cutoffs(m, spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, quality int"))
    assert sorted(r.stratum if r.stratum is not None else "none" for r in cuts.collect()) == ["", "en", "none"]
    assert quality.judged(m, cuts).filter("lang IS NULL AND NOT kept").count() == 0


def test_stage_measures_once(spark, odd):  # noqa: F811
    """The verdict is read from a written table: the plan that filters has no measuring in it."""
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.quality_stage(odd, marks)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "xxhash64" not in plan


# -- toxicity


def labelled(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.3
        t = [rnd.choice("abcdefghij") + rnd.choice("klmnopqr") for _ in range(12)]
        t[0] = rnd.choice(["nasty", "vile", "mean"]) if bad else rnd.choice(["kind", "calm"])
        if rnd.random() < (0.8 if bad else 0.2):
            t[1] = "muslims"
        rows.append((" ".join(t), int(bad)))
    return rows


def test_fit_reaches_the_optimum_over_all_features():
    """Against a plain dense proximal gradient over every feature, none screened."""
    rows = [(*toxicity.features(t), y) for t, y in labelled(150)]
    l1 = 0.02
    got = toxicity.fit(rows, fairness=2.0, l1=l1, steps=20_000, first=5)
    names = sorted({int(k) for r in rows for k in r[0]})
    at = {k: i for i, k in enumerate(names)}
    dense = lambda x: np.isin(names, x).astype(float)
    x, y = np.array([dense(r[0]) for r in rows]), np.array([r[2] for r in rows], float)
    d = np.array([dense(r[0]) - dense(r[1]) for r in rows if r[1] is not None])

    def value(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + l1 * np.abs(w).sum() + 2.0 * ((d @ w) ** 2).sum() / len(y)

    w, b = np.zeros(len(names)), 0.0
    step = 1 / (np.linalg.norm(np.c_[x, np.ones(len(y))], 2) ** 2 / (4 * len(y)) + 2 * 2.0 * np.linalg.norm(d, 2) ** 2 / len(y))
    for _ in range(60_000):
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - step * (x.T @ r / len(y) + 2 * 2.0 * d.T @ (d @ w) / len(y))
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0), b - step * r.mean()
    mine = np.zeros(len(names))
    for k, v in got.weights.items():
        mine[at[k]] = v
    assert got.pairs == len(d) > 20 and value(mine, got.bias) <= value(w, b) + 1e-4


def test_the_counterfactual_term_acts_in_the_query(spark, monkeypatch):
    """The registered path: without the term a neutral mention is scored by its group."""
    rows = labelled(1500, 5)
    docs = docs_of(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(rows)] + [(10_000, "muslims met calm people", "en", "a"), (10_001, "christians met calm people", "en", "a")])
    marks = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")

    def gap():
        s = [r.score for r in toxicity.toxicity(docs, marks).filter("doc_id >= 10000").orderBy("doc_id").collect()]
        return abs(s[0] - s[1])

    fair = gap()
    monkeypatch.setattr(toxicity, "fit", lambda rows, f=toxicity.fit: f(rows, fairness=0.0))
    assert fair < 0.5 * gap()


def test_sample_is_bounded_in_bytes(spark):
    docs = docs_of(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(labelled(300))] + [(900, " ".join(f"word{k}" for k in range(20_000)), "en", "a")])
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(301)], "doc_id long, quality int, toxic int")
    whole = toxicity.sample(docs, marks)
    some = toxicity.sample(docs, marks, most_bytes=sum(len(r[0]) for r in whole) * 8 // 3)
    assert len(whole) == 300 and 40 < len(some) < 200


def test_scores_are_those_of_the_features():
    rows = [(*toxicity.features(t), y) for t, y in labelled(300)]
    found = toxicity.fit(rows, l1=1e-3)
    odds = toxicity.Scorer(found.weights, found.bias, keep=7)
    for t, _ in [*labelled(40, 9), ("", 0), ("stemone stemtwo stemthree, stemone", 0)]:
        assert odds(t) == pytest.approx(found.bias + sum(found.weights.get(int(k), 0) for k in toxicity.features(t)[0]))
    assert len(toxicity.features("achlicha achlichb")[0]) > len(set(toxicity.features("achlicha")[0]) | set(toxicity.features("achlichb")[0]))


# -- audio


def test_silence_is_no_evidence(spark):
    g = np.random.default_rng(5)
    tunes = [np.concatenate([g.uniform(-0.5, 0.5, 40), np.full(60, np.nan), g.uniform(-0.5, 0.5, 40)]).tolist() for _ in range(6)]
    tunes[5] = tunes[0][:90] + g.uniform(-0.5, 0.5, 30).tolist()
    rows = [(i, [None if x != x else float(x) for x in t]) for i, t in enumerate(tunes)]
    prints = chroma.fingerprints(chroma.rendered(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v"), "k").cache()
    own = {r["k"]: np.array(r["items"], np.int32) for r in prints.collect()}
    assert (own[1] == chroma.SILENT).sum() > 30
    _, matches = chroma.search(prints, "k", "k % 2 = 0")
    got = {(r.query_class, r.class_id): (r.offset, r.hits, r.overlap, r.bit_errors) for r in matches.collect()}
    assert got == {(i, j): x for i in own if i % 2 == 0 for j in own if j != i and (x := chroma.align(own[i], own[j]))}
    assert set(got) == {(0, 5)} and all(chroma.align(own[i], own[j]) is None for i in range(1, 5) for j in range(1, 5) if i != j)


def test_blocks_of_short_recordings_cost_less_than_their_plain_correlation():
    g = np.random.default_rng(5)
    a, b = ([g.integers(-(1 << 31), 1 << 31, 48).astype(np.int32) for _ in range(256)] for _ in range(2))
    b[7], b[9] = a[3].copy(), np.concatenate([a[200][20:], a[201][:20]])

    def plain():
        x, y = (chroma.spectrum(rows, 96, 0, 32) for rows in (a, b))
        return np.fft.irfft(x @ y.conj().swapaxes(1, 2), 96, axis=0)

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    found = sorted(chroma.near(a, b))
    assert found == [(3, 7, 0), (200, 9, 20), (201, 9, -28)]
    assert min(seconds(lambda: list(chroma.near(a, b))) for _ in range(5)) < 0.75 * min(seconds(plain) for _ in range(5))


def test_near_finds_every_offset_at_any_length(monkeypatch):
    g = np.random.default_rng(6)
    for longest in (3, 9, 60, 300):
        a = [g.integers(-(1 << 31), 1 << 31, g.integers(1, longest + 1)).astype(np.int32) for _ in range(12)] + [np.full(longest, 7, np.int32)]
        b = [x[: max(1, len(x) - i % 3)] ^ np.int32(1 << i) for i, x in enumerate(a)] + [x[len(x) // 2 :] for x in a]
        want = {(i, j, o) for i, x in enumerate(a) for j, y in enumerate(b) for o in range(1 - len(y), len(x)) if (c := chroma.compared(x, y, o))[2] <= chroma.allowed(c[1])}
        for short in (chroma.SHORT, 0, 1 << 20):
            monkeypatch.setattr(chroma, "SHORT", short)
            found = list(chroma.near(a, b))
            assert len(found) == len(set(found)) and set(found) == want
        monkeypatch.undo()
