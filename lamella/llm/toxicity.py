"""Toxicity: a counterfactually regularised classifier.

A text's features are the words it contains, their pieces of six characters, and how many different words begin with the same
four or six characters (at least 2, 4 or 8 of them), all known by 64-bit hashes. Weights minimise logistic loss on labelled texts,
plus an L1 term, plus ``fairness`` times the squared change of score when the identity terms of a text are swapped for others of
their kind. A feature that no learned text has can have no weight, so a mention that only some texts' label goes with cannot carry
one, and neutral mentions score as without it. (Terms of a kind that all go with the label alike can: swapping does not tell.) The terms are ``identity``:
by default a list in English, German, Spanish and French. A text without one of them has no counterfactual; where no labelled
text has one, what is fitted is a plain logistic classifier with the L1 term, and ``Fit.pairs`` says so.

Fitting takes a bounded sample: at most about ``most_rows`` labelled texts, and fewer if their features are more than
``most_bytes``, by a hash of their id (all of them while there are fewer), whose features, not texts, come to the driver. All
features of the sample take part: the problem is solved on the features that can have a weight, and those are found by the
optimality conditions, which are tested on every feature until none is violated. A feature of at most ``l1`` times the sample's
rows meets them at weight 0 whatever the rest does, unless a counterfactual changes it. Scoring is one narrow pass over whole
texts: no exchange, and what each task carries is the weights.

Defined results: null and empty texts have no features and score the base rate; very long texts count whole; a null label is left
out and a document labelled twice counts as toxic if one label says so; a document that comes several times under one id is
learned from each time; repeated rows score alike; without both labels to learn from every score is the smoothed base rate; an
empty table gives an empty result; other columns, whatever their names, are no input.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.bpe import texts_of
from lamella.llm.common import forget, hash_join, importable, lean, written

PIECE, STEMS, LEVELS = 6, (4, 6), (2, 4, 8)
MOST_ROWS, MOST_BYTES = 12_000, 64 << 20
FAIRNESS, L1, STEPS = 10.0, 2e-4, 400
# Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("african", "european", "mexican", "chinese", "indian", "american", "turkish", "polish"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    # German; forms of the same ending are of one kind
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("weiblich", "männlich", "divers"),
    ("weibliche", "männliche"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("schwarze", "weiße", "asiatische", "arabische", "afrikanische", "europäische", "türkische", "polnische"),
    ("türken", "polen", "araber", "afrikaner", "europäer", "chinesen", "inder", "amerikaner"),
    ("ausländer", "einwanderer", "flüchtlinge", "bürger"),
    ("taub", "behindert", "autistisch"),
    ("behinderte", "gehörlose", "blinde", "autisten"),
    ("alte", "junge"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("femenino", "masculino"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("negros", "blancos", "asiáticos", "latinos", "indígenas", "árabes"),
    ("negro", "blanco", "asiático", "árabe"),
    ("africanos", "europeos", "mexicanos", "chinos", "indios", "americanos", "turcos", "gitanos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("inmigrante", "refugiado", "ciudadano", "extranjero"),
    ("sordos", "ciegos", "discapacitados", "autistas"),
    ("viejos", "jóvenes", "ancianos"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("féminin", "masculin"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "arabes", "autochtones"),
    ("noir", "blanc", "asiatique", "arabe"),
    ("africains", "européens", "mexicains", "chinois", "indiens", "américains", "turcs", "polonais"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("immigré", "réfugié", "citoyen", "étranger"),
    ("sourds", "aveugles", "handicapés", "autistes"),
    ("vieux", "jeunes", "âgés"),
)
WORD = re.compile(r"\w+")


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def words_of(token: str) -> list[str]:
    return WORD.findall(token)


def plain_features(word: str) -> Iterator[int]:
    """A word and, of longer ones, its pieces."""
    yield _hash(word)
    for i in range(len(word) - PIECE + 1):
        yield _hash("#" + word[i : i + PIECE])


def stems(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) > k]


def stem_features(counts: Iterable[tuple[str, int]]) -> Iterator[int]:
    """Of (stem, number of different words): each level that is reached."""
    return (_hash(f"^{stem}^{n}") for stem, k in counts for n in LEVELS if k >= n)


@functools.lru_cache(maxsize=100_000)
def _word(word: str) -> tuple[int, ...]:
    return tuple(plain_features(word))


def swapper(identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Callable[[str], str]:
    """A token with its identity terms swapped; a term of two kinds is swapped in the first."""
    swap = {w: kind[(i + 1) % len(kind)] for kind in reversed(identity) for i, w in enumerate(kind)}
    return functools.lru_cache(maxsize=50_000)(lambda token: WORD.sub(lambda m: swap.get(m[0], m[0]), token))


swapped = swapper()


def _features(tokens: set[str]) -> np.ndarray:
    words = set(itertools.chain.from_iterable(map(words_of, tokens)))
    own = set(itertools.chain.from_iterable(map(_word, words)))
    own.update(stem_features(Counter(itertools.chain.from_iterable(map(stems, words))).items()))
    return np.array(sorted(own), dtype=np.int64)


def features(text: str, swapped: Callable[[str], str] = swapped) -> tuple[np.ndarray, np.ndarray | None]:
    """(features of the text, those of its counterfactual or None if it names no group)."""
    tokens = set(text.lower().split())
    other = {swapped(t) for t in tokens}
    return _features(tokens), None if other == tokens else _features(other)


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.ids = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def only(self, columns: np.ndarray) -> Rows:
        """The same rows with some of the columns, renumbered."""
        where = np.full(self.width, -1, np.int32)
        where[columns] = np.arange(len(columns), dtype=np.int32)
        out = Rows([], len(columns))
        ids = where[self.ids]
        out.ids, out.row, out.n = ids[ids >= 0], self.row[ids >= 0], self.n
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.ids], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=r[self.row], minlength=self.width)


class Fit(NamedTuple):
    weights: dict[int, float]
    bias: float
    #: counterfactual pairs that took part, and features that could have a weight
    pairs: int
    features: int


class Problem:
    """The objective over all features of the sample."""

    def __init__(self, own: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, fairness: float) -> None:
        self.y, self.n, self.fairness = y, len(y), fairness
        width = 1 + max([-1, *(int(r.max()) for r in own if len(r)), *(int(r.max()) for p in pairs for r in p if len(r))])
        self.x, self.a, self.b = Rows(own, width), Rows([p[0] for p in pairs], width), Rows([p[1] for p in pairs], width)
        self.width = width

    def only(self, columns: np.ndarray) -> Problem:
        out = object.__new__(Problem)
        out.y, out.n, out.fairness, out.width = self.y, self.n, self.fairness, len(columns)
        out.x, out.a, out.b = self.x.only(columns), self.a.only(columns), self.b.only(columns)
        return out

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the smooth part, at weights and the bias behind them."""
        r = 1 / (1 + np.exp(-(self.x.dot(w[:-1]) + w[-1]))) - self.y
        g = np.append(self.x.back(r), r.sum()) / self.n
        if self.a.n:
            d = self.a.dot(w[:-1]) - self.b.dot(w[:-1])
            g[:-1] += 2 * self.fairness * (self.a.back(d) - self.b.back(d)) / self.n
        return g

    def step(self) -> float:
        """A step that cannot overshoot, from power iteration on the quadratic bound."""
        v, length = np.ones(self.width + 1), 1.0
        for _ in range(20):
            u = self.x.dot(v[:-1]) + v[-1]
            g = np.append(self.x.back(u), u.sum()) / (4 * self.n)
            if self.a.n:
                d = self.a.dot(v[:-1]) - self.b.dot(v[:-1])
                g[:-1] += 2 * self.fairness * (self.a.back(d) - self.b.back(d)) / self.n
            length = np.linalg.norm(g)
            v = g / max(length, 1e-12)
        return 1 / (1.1 * length)

    def solved(self, w: np.ndarray, l1: float, steps: int, close: float = 1e-4) -> np.ndarray:
        """Accelerated proximal gradient from ``w``, restarted where it turns back, until no coordinate moves by ``close``."""
        eta, look, t = self.step(), w, 1.0
        for _ in range(steps):
            nxt = look - eta * self.gradient(look)
            nxt[:-1] = np.sign(nxt[:-1]) * np.maximum(np.abs(nxt[:-1]) - eta * l1, 0)
            t2 = 1.0 if (look - nxt) @ (nxt - w) > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
            look = nxt + (t - 1) / t2 * (nxt - w) if t2 > 1 else nxt
            moved, w, t = np.abs(nxt - w).max(), nxt, t2
            if moved < close:
                break
        return w


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray | None, int]], fairness: float = FAIRNESS, l1: float = L1, steps: int = STEPS, first: int = 4096) -> Fit:
    """The classifier from (features, counterfactual features or None, label), which are gone through twice and in one order.
    ``first``: how many features are tried at first."""
    slots = 1 << 22
    counts, labels, changed = np.zeros(slots, np.uint16), [], [np.zeros(0, np.int64)]
    for r in rows:
        at = np.unique(r[0] % slots)
        counts[at] += counts[at] < 60_000
        labels.append(r[2])
        if r[1] is not None:
            changed.append(np.setxor1d(r[0], r[1]))
    y = np.array(labels, dtype=float)
    positive, n = y.sum(), len(y)
    if not n:
        return Fit({}, -0.01, 0, 0)
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not positive or positive == n:
        return Fit({}, min(bias, -0.01) if not positive else bias, 0, 0)
    # a feature of so few texts that its gradient cannot reach l1 has weight 0: they go by upper bounds of their counts, before the
    # others are gathered, as the driver has little memory
    changed = np.unique(np.concatenate(changed))
    kept = lambda f: f[(counts[f % slots] > int(l1 * n)) | np.isin(f, changed)]
    own, swaps = [], []
    for r in rows:
        own.append(kept(r[0]))
        if r[1] is not None:  # what both have cancels out
            swaps.append((np.setdiff1d(r[0], r[1]), np.setdiff1d(r[1], r[0])))
    names = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))  # what no learned text has gets no weight
    at = lambda f: (k := np.searchsorted(names, f))[names[np.minimum(k, len(names) - 1)] == f].astype(np.int32) if len(names) else np.zeros(0, np.int32)
    pairs = [(at(a), at(b)) for a, b in swaps]
    for i, r in enumerate(own):
        own[i] = at(r)
    whole = Problem(own, pairs, y, fairness)
    del own
    w = np.append(np.zeros(whole.width), bias)
    active = np.sort(np.argsort(-np.abs(whole.gradient(w)[:-1]), kind="stable")[:first])
    while len(active):
        part = whole.only(active).solved(np.append(w[active], w[-1]), l1, steps)
        w = np.zeros(whole.width + 1)
        w[active], w[-1] = part[:-1], part[-1]
        worse = np.setdiff1d(np.flatnonzero(np.abs(whole.gradient(w)[:-1]) > 1.01 * l1), active)
        if not len(worse):
            break
        active = np.union1d(active, worse)
    return Fit({int(names[k]): float(w[k]) for k in np.flatnonzero(w[:-1])}, float(w[-1]), len(pairs), len(names))


class Sample:
    """Features and labels of the learned documents, in the order of their ids: read from a scratch table each time."""

    def __init__(self, table: DataFrame, rows: DataFrame) -> None:
        self.table, self.rows, self.n = table, rows.orderBy("doc_id", "own"), rows.count()

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
        array = lambda x: None if x is None else np.frombuffer(x, np.int64)
        for r in self.rows.toLocalIterator():  # a partition at a time
            yield array(r["own"]), array(r["other"]), r["toxic"]


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, identity: tuple[tuple[str, ...], ...] = IDENTITY, most_bytes: int = MOST_BYTES) -> Sample:
    """Features and label of at most about ``most_rows`` labelled documents and ``most_bytes`` of features."""
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IN (0, 1)")
    n = one.count()
    part = F.expr("pmod(xxhash64(doc_id, 11), 1000000)")
    if n > most_rows:
        one = one.filter(part < 1_000_000 * most_rows // n)
    picked = hash_join(docs.select("doc_id", "text"), one, ["doc_id"], "inner", 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(identity)
        for batch in batches:
            found = [features(t, swap) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([None if b is None else b.tobytes() for _, b in found], pa.binary())], ["doc_id", "toxic", "own", "other"])

    found = written(picked.mapInArrow(lean(run), "doc_id long, toxic int, own binary, other binary"))
    size = found.agg(F.sum(F.expr("octet_length(own) + coalesce(octet_length(other), 0)"))).first()[0] or 0
    return Sample(found, found if size <= most_bytes else found.filter(F.expr("pmod(xxhash64(doc_id, 12), 1000000)") < 1_000_000 * most_bytes // size))


class Scorer:
    """Log odds of texts; what a token, a piece or a stem brings is looked up once while it stays in a worker's caches."""

    def __init__(self, weights: dict[int, float], bias: float, keep: int = 200_000) -> None:
        self.weights, self.bias, self.keep = weights, bias, keep
        self.known: dict[str, tuple | None] = {}
        self.piece = functools.lru_cache(maxsize=keep)(lambda p: k if (k := _hash("#" + p)) in weights else None)
        self.stem = functools.lru_cache(maxsize=keep)(lambda s: any(k in weights for k in stem_features([(s, LEVELS[-1])])))

    def token(self, token: str) -> tuple | None:
        """(features that have a weight, (word, its stems that could have one)s); None if there are none."""
        own, stemmed = set(), []
        for w in words_of(token):
            if (k := _hash(w)) in self.weights:
                own.add(k)
            if len(w) >= PIECE:
                own.update(map(self.piece, [w[i : i + PIECE] for i in range(len(w) - PIECE + 1)]))
            if some := tuple(filter(self.stem, stems(w))):
                stemmed.append((w, some))
        own.discard(None)
        return (tuple(own), tuple(stemmed)) if own or stemmed else None

    def __call__(self, text: str) -> float:
        tokens = set(text.lower().split())
        if len(self.known) > self.keep:
            self.known.clear()
        for t in tokens.difference(self.known):
            self.known[t] = self.token(t)
        there, counted = set(), {}
        for own, stemmed in filter(None, map(self.known.__getitem__, tokens)):
            there.update(own)
            counted.update(stemmed)
        if counted:
            there.update(k for k in stem_features(Counter(itertools.chain.from_iterable(counted.values())).items()) if k in self.weights)
        return self.bias + sum(self.weights[k] for k in sorted(there))


def scored(docs: DataFrame, weights: dict[int, float], bias: float, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``score``."""
    importable(docs.sparkSession)
    docs = docs.drop("score")
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Scorer(weights, bias)
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(np.array([odds(t) for t in texts_of(batch.column(text))], dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64())], [*names, "score"])

    return docs.mapInArrow(lean(run), docs.drop(text).withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only labels of rows that are not held out are learned from.
    ``identity``: kinds of lower-case words, each swapped for the next of its kind; give those of the table's languages."""
    importable(docs.sparkSession)
    learn = labels.filter(~held_out(F.col("doc_id")))
    rows = sample(docs, learn, most_rows, identity)
    found = fit(rows)
    forget(rows.table)
    d = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), found.weights, found.bias)
    return d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))
