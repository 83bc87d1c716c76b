"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification.

A document is a weighted set: its five-word shingles, each weighted by how often it stands in the text; similarity is the
weighted Jaccard index (sum of minima over sum of maxima). Two documents are linked at ``threshold`` or more, and a class
is a connected component of links.

DartMinHash: every element owns the plane of weight x rank. Its weight axis is cut into regions [0,1), [1,2), [2,4), ...;
in each, hashing throws a Poisson stream of darts ordered by rank, each with a place on the weight axis and a coordinate
of the signature. A set catches the darts below its elements' weights; darts are drawn in order of rank up to a bound of
(k ln k + 4k) / total weight, so the work is about one draw per element and k ln k + 4k darts, whatever k is. Each
coordinate keeps its earliest dart. A set with an empty coordinate goes on with twice the bound. Two sets agree on a
coordinate with probability equal to their similarity.

Joining: ``BANDS`` bands of ``ROWS`` coordinates; at similarity 0.8 two texts share no band with probability below 1e-4.
Equal sets fold into one node first, known by 128 bits. Every bucket links its members to its least member only (never all
pairs); components of these candidates come from star contraction. A component's texts then meet once, and all links in it
are found *exactly* by an inverted index of shingles, the leader's comparisons not being taken as proof of anything. A larger
component is cut into blocks of neighbours (texts with the same leader are in one block or in adjoining ones), each pair of
blocks that share a band is a task of its own, and verified links of blocks are contracted again: no task grows with a group.
Blocks of a component of n texts have n / 8, at least ``LEAST_DOCS`` and at most ``BLOCK_DOCS`` texts, and ``BLOCK`` characters.

Defined results: a text without words (null, empty, blank) is in a class of its own; one of fewer than five words is one
shingle; equal texts are in one class; a class is named by its least id; null ids join classes but name one only if all
its ids are null; a very long text is signed and compared whole, as a block of its own if need be; repeated rows are returned
each; an empty table gives an empty result; other columns are ignored. ``near_dedup_stage`` says what it keeps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.bpe import texts_of
from lamella.llm.common import components, hash_join, importable, lean, ranked, tidy, written

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
#: Characters of text in a block of a task, documents, and documents below which a block is not cut for its number.
BLOCK, BLOCK_DOCS, LEAST_DOCS = 6_000_000, 4096, 256
#: Rows of two ids and two keys that a join may send to every task.
SENT = 500_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


_words: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, each different word hashed once while it stays in the worker's cache."""
    if len(_words) > 400_000:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of each different shingle; words are what lies between white space."""
    words = text.split()
    if not words:
        return np.zeros(0, U), np.zeros(0)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    out = np.full(n, U(len(words) if len(words) < width else 0x9E3779B97F4A7C15))
    for i in range(min(width, len(h))):
        out = mix(out ^ h[i : i + n]) + U(i + 1)
    return np.unique(out, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, as a hash."""
    # regions of the weight axis below each element's weight: [0,1), [1,2), [2,4), ...
    n = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    region = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
    width, limit = np.where(region == 0, 1.0, low), np.repeat(weights, n)
    own = mix(np.repeat(elements, n) + region.astype(U) * U(0x9E3779B97F4A7C15))
    bound = (k * math.log(k) + 4 * k) / weights.sum()
    while True:
        dart, best = np.zeros(k, U), np.full(k, np.inf)
        for who, at, rank in _darts(own, limit, width, low, bound, k):
            order = np.argsort(-rank, kind="stable")  # the earliest is written last
            who, at, rank = who[order], at[order], rank[order]
            first, last = np.full(k, np.inf), np.zeros(k, U)
            first[at], last[at] = rank, who
            best, dart = np.minimum(best, first), np.where(first < best, last, dart)
        if np.isfinite(best).all():
            return dart
        bound *= 2


def _darts(own: np.ndarray, limit: np.ndarray, width: np.ndarray, low: np.ndarray, bound: float, k: int) -> Iterator[tuple]:
    """(hash, coordinate, rank) of the darts up to rank ``bound`` that lie below the weights, some draws at a time."""
    rank, step = np.zeros(len(own)), 0
    while len(own):
        need = float(((bound - rank) * width).max())
        draws = max(2, min(int(need + 3 * math.sqrt(need)) + 1, 200_000 // len(own)))
        h = mix(own[:, None] + np.arange(step + 1, step + draws + 1).astype(U)[None, :] * U(0xD1342543DE82EF95))
        when = rank[:, None] + np.cumsum(-np.log(unit(h)), axis=1) / width[:, None]  # a Poisson stream: exponential gaps
        i, j = np.nonzero(when <= bound)
        h, at = h[i, j], when[i, j]
        hit = low[i] + unit(mix(h + U(1))) * width[i] <= limit[i]
        yield mix(h + U(2))[hit], (mix(h + U(3))[hit] % U(k)).astype(np.int64), at[hit]
        more = when[:, -1] <= bound
        own, limit, width, low, rank = own[more], limit[more], width[more], low[more], when[more, -1]
        step += draws


def bands(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    """A hash of each band of the signature, with the band's number in it."""
    s = sig[: n * rows].reshape(n, rows)
    out = mix(np.arange(1, n + 1).astype(U) * U(0x9E3779B97F4A7C15))
    for i in range(rows):
        out = mix(out ^ s[:, i])
    return out.view(np.int64)


def signed(docs: DataFrame, text: str = "text", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, h1, h2, chars, bands): the text's and the set's 128-bit keys and its bands; the set's are null without words."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, tuple] = {}  # copies that come in one task are signed once
        for batch in batches:
            out = []
            for key, t in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True), texts_of(batch.column(text)), strict=True):
                if key not in done:
                    e, w = shingles(t)
                    if len(done) > 20_000:
                        done.clear()
                    if len(e):
                        d = hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).digest()
                        done[key] = (*(int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8)), len(t), bands(signature(e, w.astype(float), n_bands * rows), n_bands, rows))
                    else:
                        done[key] = (None, None, 0, [])
                out.append(done[key])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "h1", "h2", "chars", "bands"])

    return with_key(docs, text).mapInArrow(lean(run), "doc_id long, k1 long, k2 long, h1 long, h2 long, chars long, bands array<long>")


def with_key(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key_of(text), text)


def key_of(text: str) -> list[Column]:
    """A text's 128-bit key; null has one of its own."""
    return [F.xxhash64(F.lit(3), text).alias("k1"), F.xxhash64(F.lit(4), F.reverse(text), F.lit(5)).alias("k2")]


class Sets:
    """Equivalence classes of 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
        return a != b


def links(left: list[str], right: list[str] | None, threshold: float = THRESHOLD, width: int = WIDTH) -> Iterator[tuple[int, int]]:
    """All pairs at or above ``threshold`` that join two classes not joined before, between ``left`` and ``right`` or
    within ``left``: exact, by counting each text's shared shingles with all others through an inverted index."""
    a = [shingles(t, width) for t in left]
    b = a if right is None else [shingles(t, width) for t in right]
    # copies of a shingle are elements of their own, so weighted minima are plain intersections
    spread = lambda s: mix(np.repeat(s[0], s[1]) + (np.arange(s[1].sum()) - np.repeat(np.cumsum(s[1]) - s[1], s[1])).astype(U) * U(0xD1342543DE82EF95)) if len(s[0]) else s[0]
    ea = [spread(s) for s in a]
    eb = ea if right is None else [spread(s) for s in b]
    if not ea or not eb:
        return
    size = np.array([len(x) for x in eb])
    flat, owner = np.concatenate(eb), np.repeat(np.arange(len(eb)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    classes = Sets(len(ea) + (0 if right is None else len(eb)))
    base = 0 if right is None else len(ea)
    for i, e in enumerate(ea):
        lo, hi = np.searchsorted(flat, e, "left"), np.searchsorted(flat, e, "right")
        n = hi - lo
        post = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        shared = np.bincount(post, minlength=len(eb))
        near = np.flatnonzero(shared >= threshold * (len(e) + size - shared) - 1e-9)
        for j in near.tolist():
            if (right is not None or j < i) and size[j] and classes.join(i, base + j):
                yield i, j


def blocks_of(members: DataFrame, block: int, block_docs: int, least_docs: int) -> DataFrame:
    """``members`` (group, node, lead, chars, ...) with their block ``b`` in the group and the group's number of ``blocks``."""
    count = f"greatest(1, ceil(sum(chars) / {block}D), ceil(count(*) / greatest({least_docs}, least({block_docs}, count(*) / 8))))"
    sizes = members.groupBy("group").agg(F.expr(f"cast({count} AS int)").alias("blocks"), F.count("*").alias("_n"))
    d = written(members.join(sizes, "group"))
    one = d.filter("blocks = 1").select(*members.columns, "blocks", F.lit(0).alias("b"))
    large = d.filter("blocks > 1")
    if large.isEmpty():
        return one
    # neighbours by leader; a group's rows are consecutive, so their number in it is theirs less the least
    at = written(ranked(large, ["group", "lead", "node"], "_at"))
    first = at.groupBy("group").agg(F.min("_at").alias("_first"))
    cut = at.join(first, "group").withColumn("b", F.expr("cast((_at - _first) * blocks DIV _n AS int)"))
    return one.unionByName(cut.select(*one.columns))


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_docs: int = BLOCK_DOCS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, k1, k2, h1, h2, class_id, lead1, lead2) for every row of ``docs``; the last two are the key of the set
    that names the class."""
    importable(docs.sparkSession)
    own = written(signed(docs, text, n_bands, rows))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    nodes = own.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(least.alias("x"), F.first("chars").alias("chars"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.struct("h1", "h2").alias("node"), "x.doc_id", "x.k1", "x.k2", "chars", "bands"))
    cells = nodes.select("node", F.explode("bands").alias("band"))
    # written, so that both sides of the join are plain exchanges, whose hot partitions can be split; and by exchange at every size
    buckets = written(cells.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("band", "lead"))
    met = written(cells.join(buckets.hint("merge"), "band"))
    near = components(met.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    leads = met.groupBy("node").agg(F.min("lead").alias("lead"))
    members = nodes.drop("bands").join(near.withColumnRenamed("label", "group"), "node").join(leads, "node")
    members = written(blocks_of(members, block, block_docs, least_docs))
    # pairs of blocks that share a band; one for all but the largest groups
    cut = members.filter("blocks > 1").select("group", "b", "node")
    shared = met.join(cut, "node").groupBy("group", "band").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    pairs = shared.select("group", F.explode("bs").alias("i"), "bs").select("group", "i", F.explode(F.expr("filter(bs, x -> x >= i)")).alias("j"))
    pairs = pairs.distinct().select("group", F.explode(F.expr("if(i = j, array(struct(i AS b, i, j)), array(struct(i AS b, i, j), struct(j AS b, i, j)))")).alias("x")).select("group", "x.*")
    rest = ["group", "blocks", "i", "j", "b", "node", "doc_id", "k1", "k2"]
    tasks = members.filter("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).select(*rest).union(members.filter("blocks > 1").join(pairs, ["group", "b"]).select(*rest))
    # the text of a set is that of the row that names it
    known = lambda d: d.withColumn("_none", F.col("doc_id").isNull()).withColumn("_id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    at = ["_none", "_id", "k1", "k2"]
    texts = hash_join(known(with_key(docs, text)), known(members).select(*at).distinct(), at, "left_semi", SENT).groupBy(*at).agg(F.first(text).alias("_text"))
    met = known(tasks).join(texts, at).withColumn("doc_id", F.expr("if(_none, null, _id)")).drop("_none", "_id", "k1", "k2").repartition("group", "i", "j").groupBy("group", "i", "j")
    found = written(met.applyInArrow(lambda t: verified(t, threshold), "blocks int, node struct<h1:long,h2:long>, doc_id long, root struct<h1:long,h2:long>, root_id long"))
    small = found.filter("blocks = 1").select("node", F.col("root_id").alias("class_id"), "root")
    large = found.filter("blocks > 1")
    if not large.isEmpty():
        label = components(large.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        one = large.select("node", "doc_id").distinct().join(label, "node")
        lead = one.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")).select("label", F.col("x.doc_id").alias("class_id"), F.col("x.node").alias("root"))
        small = small.union(one.join(lead, "label").select("node", "class_id", "root"))
    named = nodes.select("node", F.col("doc_id").alias("_own")).join(small, "node", "left")
    named = written(named.select("node.h1", "node.h2", F.expr("if(root IS NULL, _own, class_id)").alias("class_id"), F.coalesce("root.h1", "node.h1").alias("lead1"), F.coalesce("root.h2", "node.h2").alias("lead2")))
    d = own.drop("bands", "chars").join(named.hint("merge"), ["h1", "h2"], "left")
    return d.select("doc_id", "k1", "k2", "h1", "h2", F.expr("if(h1 IS NULL, doc_id, class_id)").alias("class_id"), "lead1", "lead2")


def verified(task: pa.Table, threshold: float) -> pa.Table:
    """For each document of a block (or of two) the least member of its class among them."""
    rows = sorted(task.to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["node"]["h1"], r["node"]["h2"]))
    sets = Sets(len(rows))
    if rows[0]["i"] == rows[0]["j"]:
        for a, b in links([r["_text"] or "" for r in rows], None, threshold):
            sets.join(a, b)
    else:
        at = [[k for k, r in enumerate(rows) if r["b"] == rows[0][side]] for side in ("i", "j")]
        for a, b in links(*([rows[k]["_text"] or "" for k in x] for x in at), threshold):
            sets.join(at[0][a], at[1][b])
    roots = [rows[sets.find(k)] for k in range(len(rows))]
    key = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
    out = pa.table({"blocks": pa.array([r["blocks"] for r in rows], pa.int32()), "node": pa.array([r["node"] for r in rows], key), "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "root": pa.array([r["node"] for r in roots], key), "root_id": pa.array([r["doc_id"] for r in roots], pa.int64())})
    if len(rows) > 100:
        tidy()
    return out


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, its least id; all rows of documents without words stay, however often they come.
    Of rows equal in id and text one stays, whichever; a null id is an id of its own."""
    found = classes(docs)
    at = ["_none", "_id", "k1", "k2"]
    found = found.select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "k1", "k2", "h1", "h2", "doc_id", "class_id", "lead1", "lead2").filter("h1 IS NOT NULL")
    rows = written(found.groupBy(*at).agg(F.count("*").alias("n"), F.max(F.expr("doc_id <=> class_id AND h1 = lead1 AND h2 = lead2")).alias("leads"), F.first("lead1").alias("lead1"), F.first("lead2").alias("lead2")))
    # texts of one set may be several, of one id too: the least key stays
    keep = rows.filter("leads").groupBy("lead1", "lead2").agg(F.min(F.struct(*at)).alias("x")).select("x.*")
    marked = written(rows.join(keep.withColumn("_kept", F.lit(True)), at, "left").select(*at, "n", F.expr("_kept IS NOT NULL").alias("_kept")))
    d = docs.select(F.struct("*").alias("_row"), F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), *key_of("text"))
    left = hash_join(d, marked.filter("NOT _kept").select(*at), at, "left_anti", SENT)
    twice = marked.filter("_kept AND n > 1").select(*at)
    if twice.isEmpty():
        return left.select("_row.*")
    # rows that come several times: only those are exchanged to leave one of each
    twice = written(twice)
    again = hash_join(left, twice, at, "left_semi", SENT).dropDuplicates(at)
    return hash_join(left, twice, at, "left_anti", SENT).select("_row.*").union(again.select("_row.*"))
