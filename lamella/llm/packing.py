"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed number of tokens.

Each source is a queue of its documents' tokens, served in quanta of ``quantum`` tokens. A source's deficit at virtual time v is
what its weight has earned it by then, w * v, less what it has been given; the next quantum goes to the source that is owed half
a quantum first, so quantum j of a source goes out at v = (tokens before it + half its length) / w. That is deficit round-robin
with its rounds made infinitely short, and since the law needs no state, deficits carry over from window to window and across
partitions by themselves: at every moment each source has within about a quantum of its share. A
queue that is exhausted earns no more, and the others share its part by their weights. Windows are consecutive cuts of the
outgoing stream, so every window but the last is full and documents are cut freely.

How it scales: texts are encoded once, in a narrow pass that numbers each source's tokens within its task. The sums of
tasks by source (a row each) give every task's place in its queue, and the place of any quantum in the stream is a sum
over sources of a count that the due time alone decides. So no queue is sorted, gathered or walked; a source with a
third of all rows is spread over all tasks like the others. Beyond ``most_queues`` sources that sum is too long for every quantum:
then the quanta (a few numbers each, no ids) are sorted by their time in one range exchange, and their places are joined to the
tokens. The order is the same. Tasks' places are sent to every task while they are at most ``MOST_PLACES`` bytes together, else
joined by an exchange.

Defined results: null text is empty, so its document is the closing id alone; a null source is a queue of its own (its weight's
name is the empty string, as is that of an empty source); very long texts are cut like others, and pieces leave a task some MB at
a time; repeated rows are packed each; documents of equal length and source keep the order of the scan; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm import common
from lamella.llm.bpe import encoder, texts_of
from lamella.llm.common import BATCH, importable, lean, ranked, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WINDOW, QUANTUM, CLOSING = 4096, 256, 2
#: Sources whose quanta are counted one by one, and bytes of tasks' places that every task gets.
MOST_QUEUES, MOST_PLACES = 1024, 256 << 20
PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("source", T.StringType()), T.StructField("ids", T.BinaryType())])


def due(j: np.ndarray, total: np.ndarray, weight: np.ndarray, quantum: int) -> np.ndarray:
    """Virtual time of quantum ``j``: its middle token over the weight; the last quantum may be short."""
    return (j * quantum + np.minimum(quantum, total - j * quantum) / 2) / weight


def stream_place(queue: np.ndarray, j: np.ndarray, totals: np.ndarray, weights: np.ndarray, quantum: int) -> np.ndarray:
    """Tokens that go out before quantum ``j`` of ``queue``: over all queues, those in quanta due earlier
    (at equal times, of a queue with a lower number)."""
    out = np.zeros(len(j), dtype=np.int64)
    when = due(j, totals[queue], weights[queue], quantum)
    for s in range(len(totals)):
        total, weight = totals[s], weights[s]
        most = -(-int(total) // quantum)
        n = np.clip(np.floor(when * weight / quantum), 0, most).astype(np.int64)
        while True:  # the estimate is right but for a step
            t = due(n, total, weight, quantum)
            up = (n < most) & ((t < when) | ((t == when) & (s < queue)))
            t = due(n - 1, total, weight, quantum)
            down = ~up & (n > 0) & ~((t < when) | ((t == when) & (s < queue)))
            if not (up.any() or down.any()):
                break
            n += up.astype(np.int64) - down
        out += np.minimum(n * quantum, total)
    return out


def pieces(first: np.ndarray, n: np.ndarray, queue: np.ndarray, totals: np.ndarray, weights: np.ndarray, window: int, quantum: int) -> tuple[np.ndarray, ...]:
    """Cut documents (first token in the queue, tokens, queue) at quanta and windows:
    (document, start in it, length, window, offset) of each piece, by document."""
    j0, j1 = first // quantum, (first + n - 1) // quantum
    k = j1 - j0 + 1
    doc = np.repeat(np.arange(len(n)), k)
    j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + j0[doc]
    a, b = np.maximum(first[doc], j * quantum), np.minimum((first + n)[doc], (j + 1) * quantum)
    keys, back = np.unique(np.column_stack([queue[doc], j]), axis=0, return_inverse=True)
    at = stream_place(keys[:, 0], keys[:, 1], totals, weights, quantum)[back.reshape(-1)] + (a - j * quantum)
    over = np.maximum(0, at % window + (b - a) - window)  # tokens past the window's end
    cut = over > 0
    doc2, start, length, at = np.concatenate([doc, doc[cut]]), np.concatenate([a, (b - over)[cut]]) - first[np.concatenate([doc, doc[cut]])], np.concatenate([b - a - over, over[cut]]), np.concatenate([at, (at + (b - a) - over)[cut]])
    order = np.argsort(doc2, kind="stable")
    return doc2[order], start[order], length[order], at[order] // window, at[order] % window


CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("queue", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``CODED``: each document's ids (16 or 32 bits each) and its place among the tokens of its queue in its task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.expr("coalesce(concat('s', source), '')").alias("queue"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, True), TaskContext.get().partitionId(), {}
        kind = np.uint16 if enc.own.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            values, counts = enc.encode(texts_of(batch.column("text")))
            n, before, ids, at, values = counts + 1, [], [], 0, values.astype(kind)
            for queue, k in zip(batch.column("queue").to_pylist(), counts.tolist(), strict=True):
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + k + 1
                ids.append(np.append(values[at : at + k], kind(CLOSING)).tobytes())
                at += k
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("queue"), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], CODED.names)

    return rows.mapInArrow(lean(encode), CODED)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose ids are about ``most_bytes``, or one document."""
    size = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes)))
        yield batch.slice(at, end - at)
        at = end


def cut(batch: pa.RecordBatch, number: np.ndarray, totals: np.ndarray, weights: np.ndarray, window: int, quantum: int) -> Iterator[pa.RecordBatch]:
    """The pieces of some documents, at most about ``BATCH`` bytes of ids at a time. ``number``: their queues."""
    col = {c: batch.column(c) for c in batch.schema.names}
    n = col["n"].to_numpy()
    doc, start, length, seq, offset = pieces(col["first"].to_numpy() + col["before"].to_numpy(), n, number, totals, weights, window, quantum)
    whole = lambda x: pa.array(x, pa.int64())
    ends = np.cumsum(length * 4)
    lo, last, wide = 0, -1, np.zeros(0, "<u4")
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH)))
        ids = []
        for d, s, m in zip(doc[lo:hi].tolist(), start[lo:hi].tolist(), length[lo:hi].tolist(), strict=True):
            if d != last:
                raw, last = col["ids"][d].as_buffer(), d
                wide = np.frombuffer(raw, np.uint16 if raw.size == 2 * n[d] else np.uint32)
            ids.append(wide[s : s + m].astype("<u4").tobytes())
        take = pa.array(doc[lo:hi])
        yield pa.RecordBatch.from_arrays([col["doc_id"].take(take), whole(start[lo:hi]), whole(length[lo:hi]), whole([zlib.crc32(x) for x in ids]), whole(n[doc[lo:hi]]), whole(seq[lo:hi]), whole(offset[lo:hi]), col["source"].take(take), pa.array(ids, pa.binary())], PIECES.names)
        lo = hi


def pack(docs: DataFrame, weights: dict[str, float] | None = None, path: str = WORD_BPE, window: int = WINDOW, quantum: int = QUANTUM, most_queues: int = MOST_QUEUES) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and the piece's ids
    (little-endian, four bytes each). ``weights``: a positive target share for each source; without them a source's
    share of all tokens, so that the mixture holds to the end."""
    importable(docs.sparkSession)
    if quantum > window:
        raise ValueError("a quantum must fit in a window")
    tokens = written(encoded(docs, path))
    sums = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))  # a row for each queue and task
    firsts = sums.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("first"))
    queues = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    some = queues.orderBy("queue").limit(most_queues + 1).collect()  # at most ``most_queues`` and one
    if len(some) > most_queues:
        return sorted_out(tokens, firsts, queues, weights, window, quantum)
    number = {r["queue"]: i for i, r in enumerate(some)}
    totals = np.array([r["n"] for r in some], dtype=np.int64)
    share = np.array([float(weights[r["queue"][1:]]) for r in some]) if weights else totals.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH // 4):
                yield from cut(part, np.array([number[q] for q in part.column("queue").to_pylist()], np.int64), totals, share, window, quantum)

    # a task's places as one row: where each of its queues begins
    places = written(firsts.groupBy("part").agg(F.collect_list(F.struct("queue", "first")).alias("x")).select("part", F.map_from_entries("x").alias("_firsts")))
    size = places.agg(F.coalesce(F.sum(F.expr("aggregate(map_keys(_firsts), 64L, (s, q) -> s + octet_length(q) + 24)")), F.lit(0))).first()[0]
    side = F.broadcast(places) if size <= min(MOST_PLACES, common.MOST_SENT) else places
    placed = tokens.join(side, "part").withColumn("first", F.expr("_firsts[queue]")).drop("_firsts")
    return placed.mapInArrow(lean(run), PIECES)


def sorted_out(tokens: DataFrame, firsts: DataFrame, queues: DataFrame, weights: dict[str, float] | None, window: int, quantum: int) -> DataFrame:
    """``pack`` for any number of queues: the quanta of all are sorted by their time, and each document's rows get those of its quanta."""
    spark = tokens.sparkSession
    if weights:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
        queues = written(queues.withColumn("name", F.expr("substring(queue, 2)")).join(given, "name", "left"))
        if lacks := queues.filter("weight IS NULL").select("name").take(1):
            raise KeyError(lacks[0]["name"])
    else:
        queues = queues.withColumn("weight", F.col("n").cast("double"))
    block = 10_000  # quanta of a queue that one row becomes: a queue with most tokens is cut into many rows first
    rows = queues.withColumn("b", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {block * quantum}L)"))).repartition("queue", "b")
    rows = rows.withColumn("j", F.explode(F.expr(f"sequence(b * {block}L, least((b + 1) * {block}L, (n - 1) DIV {quantum}L + 1) - 1)")))
    rows = rows.withColumn("size", F.expr(f"least({quantum}L, n - j * {quantum}L)"))
    quanta = rows.select("queue", "j", "size", F.expr(f"(j * {quantum}L + size / 2D) / weight").alias("due"))
    places = ranked(quanta, ["due", "queue", "j"], "place", "size").select("queue", F.col("j").alias("_j"), "place")
    d = tokens.join(firsts, ["queue", "part"]).withColumn("_a", F.col("first") + F.col("before"))
    # a document's ids travel once, in one row for each quantum that it touches, cut there
    d = d.withColumn("_w", F.expr("octet_length(ids) DIV n")).withColumn("_j", F.explode(F.expr(f"sequence(_a DIV {quantum}L, (_a + n - 1) DIV {quantum}L)")))
    d = d.withColumn("_start", F.expr(f"greatest(0L, _j * {quantum}L - _a)")).withColumn("_n", F.expr(f"least(n, (_j + 1) * {quantum}L - _a) - _start"))
    d = d.select("doc_id", "source", "queue", "_j", F.col("n").alias("doc_tokens"), "_start", "_n", F.expr(f"greatest(0L, _a - _j * {quantum}L)").alias("_in"), F.expr("substring(ids, cast(_start * _w AS int) + 1, cast(_n * _w AS int))").alias("ids"))
    d = d.join(places, ["queue", "_j"]).withColumn("_at", F.expr("place + _in")).drop("queue", "_j", "place", "_in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, done = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * r["_n"] else np.uint32).astype("<u4"), 0
                while done < r["_n"]:
                    m = min(r["_n"] - done, window - (r["_at"] + done) % window)
                    raw = ids[done : done + m].tobytes()
                    rows.append((r["doc_id"], r["_start"] + done, m, zlib.crc32(raw), r["doc_tokens"], (r["_at"] + done) // window, (r["_at"] + done) % window, r["source"], raw))
                    done += m
            for i in range(0, len(rows), 1000):
                cols = list(zip(*rows[i : i + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.binary())], PIECES.names)

    return d.mapInArrow(lean(run), PIECES)
