"""Media columns: chroma audio fingerprints and the alignment of recordings.

A recording is a binary column of 16-bit little-endian mono samples. Frames of ``FRAME`` samples give the energy of twelve
pitch classes; over the frames' integral image sixteen area filters (differences of neighbouring rectangles in time and pitch)
are read at every frame, each quantised to two bits of Gray code and packed into one 32-bit item.

Two recordings match at an offset if at most ``most_errors`` of the bits of their overlap differ and chance does not explain
it: ``hits`` items are equal there, or the differing bits are at most ``allowed`` for an overlap of that length, with or
without an equal item. Where both are silent the overlap does not count, neither its items as equal nor its length. So an overlap
with more than ``most_errors`` of its bits changed is never a match, however long; one of fewer than about 256 items with more
than ``allowed`` is one only with ``hits`` equal items. Of several such offsets the one with most equal items is told, then the
nearest, then the greater. Recordings with equal fingerprints fold into one class first, so copies are never expanded into pairs;
the search takes a stated query set against all classes.

Fingerprints are one narrow pass. Offsets with ``hits`` equal items come from an inverted list (position and class only),
counted with partial aggregation. The differing bits of every query and class at every offset are read from the correlation
of their bits, in blocks of classes against blocks of queries, to ``SHORT`` by products of matrices: exact, and its cost is the
product of queries and classes.

Defined results: a null, empty or short recording has no items and matches nothing; fewer than four items are told from chance
by no number of differing bits and match only their copies, by class; rests and stretches of silence differ from sound like any
other item, but equal ones are no evidence; a very long recording is a block of its own; null ids take no part in the search but
are returned as members; repeated rows are members of one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import importable, lean, written

RATE, FRAME, HOP = 4000, 1024, 512
#: (shape, first pitch class, pitch classes, frames): four widths, three heights and five shapes in turn.
HEIGHTS, WIDTHS = (12, 6, 4), (4, 8, 12, 16)
FILTERS = [(i % 5, (5 * i) % (13 - HEIGHTS[i % 3]), HEIGHTS[i % 3], WIDTHS[i // 4]) for i in range(16)]
SPAN = max(WIDTHS)
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
HITS, MOST_ERRORS = 8, 0.35
#: In different recordings (the melodies of sf0.1, overlaps of 4 to 48 items) the differing share of k items' bits has mean CHANCE
#: and deviation SPREAD / sqrt(k + MORE). SIGMAS below the mean, about 4 in 10^11 alignments are chance; from 256 items on that is 0.35.
CHANCE, SPREAD, MORE, SIGMAS = 0.424, 0.183, 4.6, 6.5
#: Rows of a block, and numbers of a correlation that is held at once.
BLOCK, HELD = 256, 1 << 23
#: Up to this length transforms are products of matrices, over about as many numbers at once as a core's cache takes.
SHORT, CACHED = 512, 1 << 18


@functools.lru_cache(maxsize=2)
def pitch_classes(rate: int) -> np.ndarray:
    """Matrix from the bins of a frame's spectrum to pitch classes, from 100 Hz to half the rate."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    heard = np.flatnonzero((f >= 100) & (f < rate / 2))
    out[heard, np.round(12 * np.log2(f[heard] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame of unit length (silence: zeros)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2 @ pitch_classes(rate)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return energy / np.where(norm == 0, 1, norm)


def items(frames: np.ndarray) -> np.ndarray:
    """The packed integers: one for each frame from which the widest filter fits."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    x = np.arange(n)
    area = lambda a, b, lo, hi: image[x + b, hi] - image[x + a, hi] - image[x + b, lo] + image[x + a, lo]
    out = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if shape == 0:  # lower against upper pitches
            one = area(0, w, y, y + h // 2)
        elif shape == 1:  # earlier against later
            one = area(0, w // 2, y, y + h)
        elif shape == 2:  # both in turn
            one = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif shape == 3:  # middle pitches against outer ones
            one = area(0, w, y + h // 4, y + h - h // 4)
        else:  # the middle of the time against its ends
            one = area(w // 4, w - w // 4, y, y + h)
        value = np.log((1 + one) / (1 + whole - one))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(CUTS, value)]
    return out.view(np.int32)


#: The item of silence: it tells nothing, so it never counts as an equal item.
SILENT = int(items(np.zeros((SPAN, 12)))[0])


def allowed(k: np.ndarray, most_errors: float = MOST_ERRORS) -> np.ndarray:
    """Most differing bits of ``k`` aligned items that chance does not explain; negative where there is no such number."""
    share = np.minimum(most_errors, CHANCE - SIGMAS * SPREAD / np.sqrt(k + MORE))
    return np.where(k < 1, -1, np.floor(share * 32 * k)).astype(np.int64)


def compared(a: np.ndarray, b: np.ndarray, o: int) -> tuple[int, int, int, int]:
    """(equal items, overlap, differing bits, items of the overlap that are not silent in both) at an offset."""
    x, y = a[max(o, 0) :], b[max(-o, 0) :]
    k = min(len(x), len(y))
    differ = x[:k] ^ y[:k]
    heard = (differ != 0) | (x[:k] != SILENT)
    return int((heard & (differ == 0)).sum()), k, int(np.bitwise_count(differ.view(np.uint32)).sum()), int(heard.sum())


def align(a: np.ndarray, b: np.ndarray, hits: int = HITS, most_errors: float = MOST_ERRORS) -> tuple[int, int, int, int] | None:
    """(offset, equal items there, overlap, differing bits) of the best offset, tried one by one; None if no offset matches."""
    best = None
    for o in range(1 - len(b), len(a)):
        same, k, errors, heard = compared(a, b, o)
        if errors <= allowed(heard, most_errors) or (same >= hits and errors <= heard * 32 * most_errors):
            best = max(best or (-1,), (same, -abs(o), o, k, errors))
    return best and (best[2], best[0], *best[3:])


def smooth(n: int) -> int:
    """The least length from ``n`` on that has no prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def spectrum(rows: list[np.ndarray], n: int, first: int, bits: int) -> np.ndarray:
    """Frequencies x rows x bits: transforms of the rows' bits as -1 and 1, zeros behind their ends."""
    out = np.zeros((n, len(rows), bits), np.float32)
    for i, x in enumerate(rows):
        out[: len(x), i] = ((x.view(np.uint32)[:, None] >> np.arange(first, first + bits, dtype=np.uint32)) & 1).astype(np.float32) * 2 - 1
    return np.fft.rfft(out, axis=0)


@functools.lru_cache(maxsize=8)
def waves(n: int, offsets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines over sines of ``n`` samples, a row for each frequency, and the ways back from either to the first offsets."""
    f = np.arange(n // 2 + 1)
    turn = 2 * np.pi * (np.outer(f, np.arange(n)) % n) / n
    share = np.where(2 * f % n == 0, 1, 2)[:, None] / n
    even, odd = (np.ascontiguousarray((x * share)[:, :offsets].T, np.float32) for x in (np.cos(turn), np.sin(turn)))
    return np.concatenate([np.cos(turn), np.sin(turn)]).astype(np.float32), even, odd


@functools.lru_cache(maxsize=8)
def short_spectrum(data: bytes, sizes: tuple[int, ...], n: int, offsets: int, columns: bool) -> np.ndarray:
    """Frequencies x rows x 96: cosine, sine and negative cosine parts of the rows' bits as -1 and 1, zeros behind their ends;
    as ``columns`` frequencies x 64 x rows, without the last. A block meets several others in turn, so the last ones are kept."""
    heard = np.arange(max(sizes)) < np.array(sizes)[:, None]
    rows = np.zeros(heard.shape, "<u4")
    rows[heard] = np.frombuffer(data, "<u4")
    bits = np.unpackbits(np.ascontiguousarray(rows.T).view(np.uint8), axis=1, bitorder="little").reshape(*rows.T.shape, 32).astype(np.float32) * 2 - 1
    bits[~heard.T] = 0
    cos, sin = (waves(n, offsets)[0][:, : len(bits)] @ bits.reshape(len(bits), -1)).reshape(2, -1, len(sizes), 32)
    return np.ascontiguousarray(np.concatenate([cos, sin], axis=2).swapaxes(1, 2)) if columns else np.concatenate([cos, sin, -cos], axis=2)


def near_short(a: list[np.ndarray], b: list[np.ndarray], least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``near`` for short rows: the correlation at an offset is an even part and an odd one, at the opposite offset their difference."""
    la, lb = (np.array([len(x) for x in rows]) for rows in (a, b))
    first = int(np.argmax(np.isfinite(least)))  # offsets of a shorter overlap match nowhere, so these may fold onto each other
    n, offsets = int(la.max() + lb.max()) - first, int(max(la.max(), lb.max())) - first + 1
    x, y = (short_spectrum(b"".join(r.tobytes() for r in rows), tuple(map(len, rows)), n, offsets, columns) for rows, columns in ((a, False), (b, True)))
    _, even_back, odd_back = waves(n, offsets)
    o = np.arange(offsets)[:, None]
    one = lambda x: x[:1] if (x == x[0]).all() else x  # noqa: E731  rows of one length share their overlaps
    step = min(len(a), max(1, CACHED // (len(x) * len(b))))
    room = [np.empty(k * step * len(b), np.float32) for k in (max(len(x), offsets), offsets, offsets)]
    for i in range(0, len(a), step):
        part, size = x[:, i : i + step], one(la[i : i + step])
        held, even, odd = (r[: len(r) // step * part.shape[1]].reshape(-1, part.shape[1] * len(b)) for r in room)
        for bits, back, out in ((part[..., :64], even_back, even), (part[..., 32:], odd_back, odd)):
            np.matmul(bits, y, out=held[: len(x)].reshape(len(x), -1, len(b)))
            np.matmul(back, held[: len(x)], out=out)
        for sign, join in ((1, np.add), (-1, np.subtract)):
            overlap = np.minimum((size - np.maximum(sign * o, 0))[:, :, None], (one(lb) - np.maximum(-sign * o, 0))[:, None, :])
            found = join(even, odd, out=held[:offsets]).reshape(offsets, -1, len(b)) >= least[np.maximum(overlap, 0)]
            at, u, v = np.unravel_index(np.flatnonzero(found), found.shape)
            yield from ((j, k, sign * d) for j, k, d in zip((u + i).tolist(), v.tolist(), at.tolist(), strict=True) if d or sign > 0)


def near(a: list[np.ndarray], b: list[np.ndarray], most_errors: float = MOST_ERRORS) -> Iterator[tuple[int, int, int]]:
    """(row of a, row of b, offset) wherever the differing bits are at most ``allowed``, and few more for rounding.
    The correlation at an offset is the number of equal bits less that of differing ones."""
    la, lb = (np.array([len(x) for x in rows]) for rows in (a, b))
    k = np.arange(min(la.max(), lb.max()) + 1)
    most = allowed(k, most_errors)
    least = np.where(most < 0, np.inf, 32 * k - 2 * most - 1 - 1e-4 * k).astype(np.float32)
    if not np.isfinite(least).any():
        return
    n = smooth(int(la.max() + lb.max()) - 1)
    if n <= SHORT:
        yield from near_short(a, b, least)
        return
    nb = max(1, min(len(b), HELD // n))
    na = max(1, HELD // (n * nb))
    bits = max(1, min(32, HELD // (n * max(nb, min(na, len(a))))))
    o = np.arange(n)
    o = np.where(o < la.max(), o, o - n)
    one = lambda x: x[:1] if (x == x[0]).all() else x  # noqa: E731  rows of one length share their overlaps
    for i, j in itertools.product(range(0, len(a), na), range(0, len(b), nb)):
        x, y = a[i : i + na], b[j : j + nb]
        product = sum(spectrum(x, n, p, min(bits, 32 - p)) @ spectrum(y, n, p, min(bits, 32 - p)).conj().swapaxes(1, 2) for p in range(0, 32, bits))
        overlap = np.minimum((one(la[i : i + na]) - np.maximum(o, 0)[:, None])[:, :, None], (one(lb[j : j + nb]) - np.maximum(-o, 0)[:, None])[:, None, :])
        at, u, v = np.nonzero(np.fft.irfft(product, n, axis=0) >= least[np.maximum(overlap, 0)])
        yield from zip((u + i).tolist(), (v + j).tolist(), o[at].tolist(), strict=True)


def fingerprints(media: DataFrame, key: str, audio: str = "audio", rate: int = RATE) -> DataFrame:
    """(key, items): the packed integers of every recording."""
    importable(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [items(chroma(np.frombuffer(x[: len(x) // 2 * 2], "<i2"), rate)) if x else [] for x in batch.column(audio).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.list_(pa.int32()))], [key, "items"])

    return media.select(F.col(key).cast("long").alias(key), audio).mapInArrow(lean(run), f"{key} long, items array<int>")


def rendered(table: DataFrame, key: str, numbers: str, audio: str = "audio") -> DataFrame:
    """A recording for each row of a table of number lists: number v sounds as a note of ``HOP`` samples, three octaves
    from 220 Hz over the range -0.5 to 0.5, with the first overtone. Null lists give null, null numbers a rest."""
    importable(table.sparkSession)

    def sound(values: list) -> bytes:
        v = np.array([np.nan if x is None else x for x in values], dtype=float)
        rest = np.isnan(v)
        hertz = 220 * 2 ** (np.round((np.clip(np.where(rest, 0, v), -0.5, 0.5) + 0.5) * 36) / 12)
        phase = np.cumsum(np.repeat(2 * np.pi * hertz / RATE, HOP))
        return np.round(np.repeat(np.where(rest, 0, 1), HOP) * (9000 * np.sin(phase) + 4000 * np.sin(2 * phase))).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = [None if x is None else sound(x) for x in part.column(numbers).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.binary())], [key, audio])

    return table.select(F.col(key).cast("long").alias(key), numbers).mapInArrow(lean(run), f"{key} long, {audio} binary")


def blocks(live: DataFrame, name: str) -> DataFrame:
    """Blocks of neighbouring rows of like length: (ids, sizes, items) with ``name`` before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = batch.column("class_id").to_numpy(), batch.column("items")
            sizes = items.value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")
            while len(order):
                longest = int(sizes[order[-1]])
                take, order = np.split(order[::-1], [min(BLOCK, max(1, math.isqrt(HELD // (2 * longest))))])
                order = order[::-1]
                data = items.take(pa.array(take)).flatten().to_numpy().astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids[take]], pa.list_(pa.int64())), pa.array([sizes[take]], pa.list_(pa.int32())), pa.array([data], pa.large_binary()).cast(pa.binary())], [f"{name}_ids", f"{name}_sizes", f"{name}_items"])

    return live.select("class_id", "items").mapInArrow(lean(run), f"{name}_ids array<long>, {name}_sizes array<int>, {name}_items binary")


FOUND = "query_class long, class_id long, hits long, near int, offset int, overlap int, bit_errors int"


def scanned(live: DataFrame, most_errors: float = MOST_ERRORS) -> DataFrame:
    """The best offset within ``allowed`` of every query and other class that have one."""
    asked, others = written(blocks(live.filter("asked"), "q")), written(blocks(live, "c"))
    tasks = max(1, min(others.count(), 8 * live.sparkSession.sparkContext.defaultParallelism))

    def rows_of(row: dict, name: str) -> list[np.ndarray]:
        return np.split(np.frombuffer(row[f"{name}_items"], "<i4"), np.cumsum(row[f"{name}_sizes"])[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            a, b, best = rows_of(row, "q"), rows_of(row, "c"), {}
            for i, j, o in near(a, b, most_errors):
                if row["q_ids"][i] != row["c_ids"][j]:
                    same, k, errors, heard = compared(a[i], b[j], o)
                    if errors <= allowed(heard, most_errors):
                        best[i, j] = max(best.get((i, j), (-1,)), (same, -abs(o), o, k, errors))
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (row["q_ids"][i], row["c_ids"][j], *x), strict=True)) for (i, j), x in best.items()], kinds)

    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in FOUND.split(", ")])
    return others.repartition(tasks).crossJoin(asked).mapInArrow(lean(run), FOUND)


def search(prints: DataFrame, key: str, is_query: str, hits: int = HITS, most_errors: float = MOST_ERRORS) -> tuple[DataFrame, DataFrame]:
    """(members, matches) of fingerprints: members is (key, class_id, n_items) for every row, matches is (query_class, class_id,
    offset, hits, overlap, bit_errors) for each class with a query in it against all other classes, as ``align`` has it."""
    own = written(prints.withColumn("_h1", F.xxhash64("items")).withColumn("_h2", F.xxhash64(F.lit(5), "items")))
    kinds = written(own.groupBy("_h1", "_h2").agg(F.min(key).alias("class_id"), F.first("items").alias("items"), F.max(F.expr(f"coalesce({is_query}, false)")).alias("asked")))
    members = own.select(key, "_h1", "_h2", F.size("items").alias("n_items")).join(kinds.select("_h1", "_h2", "class_id"), ["_h1", "_h2"]).select(key, F.expr(f"if(n_items = 0, {key}, class_id)").alias("class_id"), "n_items")
    live = kinds.filter("class_id IS NOT NULL AND size(items) > 0")
    flat = live.select("class_id", "asked", F.posexplode("items").alias("pos", "item")).filter(F.col("item") != SILENT)
    asked = flat.filter("asked").select(F.col("class_id").alias("query_class"), F.col("pos").alias("_q"), "item")
    met = asked.join(flat.select("class_id", "pos", "item"), "item").filter("query_class <> class_id")
    counts = met.groupBy("query_class", "class_id", F.expr("_q - pos").alias("offset")).agg(F.count("*").alias("hits")).filter(F.col("hits") >= hits)
    met_at = counts.groupBy("query_class", "class_id").agg(F.collect_list(F.struct("hits", F.expr("-abs(offset)").alias("near"), "offset")).alias("x"))
    side = lambda name, out: live.select(F.col("class_id").alias(name), F.col("items").alias(out))
    d = met_at.join(side("query_class", "_a"), "query_class").join(side("class_id", "_b"), "class_id")
    d = d.withColumn("x", F.expr("transform(x, t -> struct(t.hits AS hits, t.near AS near, t.offset AS offset, cast(least(size(_a) - greatest(t.offset, 0), size(_b) - greatest(-t.offset, 0)) AS int) AS overlap))"))
    # a negative int has its 32 high bits counted too, unless they are cut off
    pair = "_a[i + greatest(t.offset, 0)] {} _b[i + greatest(-t.offset, 0)]"
    d = d.withColumn("x", F.expr(f"transform(x, t -> struct(t.hits AS hits, t.near AS near, t.offset AS offset, t.overlap AS overlap, aggregate(sequence(0, t.overlap - 1), 0, (s, i) -> s + bit_count(({pair.format('^')}) & 4294967295L)) AS bit_errors, size(filter(sequence(0, t.overlap - 1), i -> NOT ({pair.format('=')} AND _a[i + greatest(t.offset, 0)] = {SILENT}))) AS heard))"))
    equal = d.select("query_class", "class_id", F.inline(F.expr(f"filter(x, t -> t.bit_errors <= t.heard * 32 * {most_errors!r}D)"))).drop("heard")
    best = equal.union(scanned(live, most_errors)).groupBy("query_class", "class_id").agg(F.max(F.struct("hits", "near", "offset", "overlap", "bit_errors")).alias("x"))
    return members, best.select("query_class", "class_id", "x.offset", "x.hits", "x.overlap", "x.bit_errors")
