"""The pipeline against the same stages by brute force, and the registered queries."""

import collections
import random

import corpus_pipeline
from lamella.llm.queries import ORACLES, QUERIES
from tests.llm.test_text import PASSAGE, check_packing, counts, repeated_lines, secrets_of, weighted


def plain(rows):
    """Texts that reach the packing stage."""
    rows = [r for r in rows if not counts(r[1])[-1]]
    gone = repeated_lines([r[:2] for r in rows], 50)
    left = []
    for i, t in rows:
        drop, lines, n, keep = set(gone[i, t]), t.split("\n"), 0, []
        for x in lines:
            if x.strip():
                if n not in drop:
                    keep.append(x)
                n += 1
            else:
                keep.append(x)
        if n > len(drop):
            left.append((i, "\n".join(keep)))
    sets, up = [weighted(t) for _, t in left], list(range(len(left)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                up[find(a)] = find(b)
    first = {}
    for k, (i, t) in enumerate(left):
        g = find(k)
        if g not in first or i < first[g][0]:
            first[g] = (i, t)
    out = []
    for i, t in sorted(first.values()):
        parts, done = [], 0
        for _, s, e in secrets_of(t):
            if s >= done:
                parts += [t[done:s], "[SECRET]"]
            done = max(done, e)
        out.append((i, "".join([*parts, t[done:]])))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bcdfghk" for b in "aeiou" for c in "lmnr"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, "\n".join(prose(rnd.randrange(8, 40)) for _ in range(4))) for i in range(40)]
    rows += [(50 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(60 + k, rows[k][1].replace("\n", " ").replace(" ", "  ", 1) + " more") for k in range(10, 15)]  # near copies in other lines
    rows += [(70 + k, PASSAGE + "\n" + prose(30)) for k in range(3)]  # a shared passage
    rows += [(80, prose(20) + ' token = "abcdef0123456789abcdef01"'), (81, "x " * 60), (82, "few words"), (83, None), (84, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = plain(rows)
    assert len(want) < 50 and any("[SECRET]" in t for _, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = check_packing(got, [t for _, t in want], 4096)
    assert collections.Counter(docs.keys()) == collections.Counter(i for i, _ in want)


def test_stage_names_and_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "secret scans", "packing"]
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)
