"""Line dedup: repeated runs of lines by a suffix array over line ids, in DataFrame functions only.

A line (with at least one word) of a document is deleted if it lies in a run of lines of ``min_words`` words or more
that also stands earlier: in a document with a lower id, or higher up in the same one. The first copy stays. Shorter runs
stay everywhere, so a repeated title, list item or licence line of under 50 words is left alone, unless it stands in a longer run.

1. Each text becomes its sequence of line ids (64-bit hashes). Equal texts (by 128 bits) fold into one sequence, whose
   first copy has the lowest id; all lines of later copies are deleted if they have ``min_words`` words together.
2. Only lines that occur twice can repeat. A stretch of such lines is kept if it has ``min_words`` words; the rest of
   the corpus leaves here, and with it nearly every frequent short line.
3. Suffix array by distributed prefix doubling: ranks of suffixes by their first line, then by pairs of ranks 2^k lines
   apart, to the depth that a window of ``min_words`` words can have. A round sorts the *different* pairs only (range
   exchange, global position), so a pair that occurs a million times is one row of the sort.
4. LCP intervals: suffixes whose longest common prefix is at least d lines are those of equal rank at depth d (for d
   between 2^k and 2^(k+1): of equal ranks of both 2^k-line halves, which overlap). For each suffix the interval of its
   least window of ``min_words`` words, and likewise for windows that end at a line; the first member of an interval is
   the first copy, all others are later ones. Windows from the front and from the back together cover each maximal
   repeated run exactly, so their union is what is deleted.

Every grouping is a partial ``min`` or ``count``; joins on frequent keys are sort-merge joins whose hot partitions adaptive
execution splits; nothing is partitioned by a line, a passage or a source. A document's lines meet in one row. Each
round is a written table.

Defined results: null text stays null and takes no part; a very long text is one row, in the exchanges too; lines without a word are never deleted; a line's white space
counts; null ids come before all others; rows equal in id and text are one document and are treated alike; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import ranked, written

MIN_WORDS = 50
BLANK = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
WS = r"[ \\t\\x0B\\f\\r]+"
KEY = ("_h1", "_h2")
ADDED = ("clean_text", "n_lines", "removed")


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the 128-bit key of each text."""
    return docs.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(0), text))


def sequences(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each different text: its key, first id, copies' last id, words, and its lines with words (id, words)."""
    lines = f"filter(transform(split(`{text}`, '\\n'), l -> struct(btrim(l, {BLANK}) AS t, l)), x -> x.t <> '')"
    d = keyed(docs.filter(F.col(text).isNotNull()), F.col(text)).withColumn("_lines", F.expr(lines))
    d = d.select(*KEY, F.col("doc_id").alias("_id"), F.expr(f"transform(_lines, x -> struct(xxhash64(x.l) AS line, size(split(x.t, '{WS}')) AS words))").alias("lines"))
    return d.groupBy(*KEY).agg(F.min(F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id").alias("id"))).alias("first"), F.max(F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id").alias("id"))).alias("last"), F.first("lines").alias("lines")).withColumn(
        "n_words", F.expr("aggregate(lines, 0L, (a, x) -> a + x.words)")
    )


def stretches(seqs: DataFrame, min_words: int) -> DataFrame:
    """(key, first, run_no, run): the stretches of repeated lines with ``min_words`` words, an array of lines each.
    A line's ``n`` counts its document's lines that have words."""
    flat = seqs.filter(F.col("n_words") >= min_words).select(*KEY, F.col("first").alias("_first"), F.posexplode("lines").alias("n", "x")).select(*KEY, "_first", "n", "x.line", "x.words")
    flat = written(flat)
    # written, so that both sides of the join are plain exchanges, whose hot partitions can be split
    often = written(flat.groupBy("line").agg(F.count("*").alias("c")).filter("c > 1").select("line"))
    again = written(flat.join(often, "line"))
    rows = again.groupBy(*KEY).agg(F.min("_first").alias("_first"), F.sort_array(F.collect_list(F.struct("n", "line", "words"))).alias("x"))
    # cut each document's repeated lines where the numbering jumps
    rows = rows.withColumn("starts", F.expr("filter(sequence(0, size(x) - 1), i -> i = 0 OR x[i].n <> get(x, i - 1).n + 1)"))
    cut = rows.select(*KEY, "_first", "x", F.expr("inline(transform(starts, (s, k) -> struct(s AS s, coalesce(get(starts, k + 1), size(x)) AS e)))"))
    cut = cut.withColumn("run", F.expr("slice(x, s + 1, e - s)")).filter(F.expr(f"aggregate(run, 0L, (a, l) -> a + l.words) >= {min_words}"))
    return cut.select(*KEY, "_first", F.col("s").alias("run_no"), "run")


def doubled(runs: DataFrame, depth: int) -> DataFrame:
    """``runs`` with ``ranks``: for each level k an array of every suffix's rank by its first 2^k lines.

    Suffixes that end sooner have null, which sorts first. Levels go up while 2^(k+1) is at most ``depth``.
    """
    runs = runs.withColumn("ranks", F.expr("cast(array() AS array<array<bigint>>)"))
    k, level = 0, "transform(run, l -> l.line)"
    pair = "struct({} AS a, cast(null AS bigint) AS b)"
    while True:
        # this round's pairs of each suffix: (rank by the first half, rank of the second half)
        if k == 0:
            pairs = f"transform({level}, v -> {pair.format('v')})"
        else:
            half = 1 << (k - 1)
            pairs = f"transform(ranks[{k - 1}], (v, i) -> struct(v AS a, get(ranks[{k - 1}], i + {half}) AS b))"
        at = written(runs.select(*KEY, "run_no", F.posexplode(F.expr(pairs)).alias("n", "p")).select(*KEY, "run_no", "n", "p.a", F.coalesce("p.b", F.lit(-1)).alias("b")))
        order = ranked(at.select("a", "b").distinct(), ["a", "b"])
        named = at.join(order, ["a", "b"]).repartition(*KEY, "run_no")
        level_k = named.groupBy(*KEY, "run_no").agg(F.sort_array(F.collect_list(F.struct("n", "rank"))).alias("r")).select(*KEY, "run_no", F.expr("transform(r, x -> x.rank)").alias("_level"))
        runs = written(runs.join(level_k, [*KEY, "run_no"]).withColumn("ranks", F.expr("concat(ranks, array(_level))")).drop("_level"))
        k += 1
        if 1 << k > depth:
            return runs


def later_copies(runs: DataFrame, min_words: int) -> DataFrame:
    """(key, removed): the numbers of lines, by sequence, that lie in a later copy of a run of ``min_words`` words."""
    # a window holds at least min_words words and as few lines as it can, so at most min_words lines
    grow = f"struct(0 AS w, 0 AS n), (a, l) -> if(a.w >= {min_words}, a, struct(a.w + l.words AS w, a.n + 1 AS n)), a -> if(a.w >= {min_words}, a.n, 0)"
    ahead = f"transform(run, (x, i) -> struct(i AS s, aggregate(slice(run, i + 1, {min_words}), {grow}) AS n))"
    back = f"transform(run, (x, i) -> aggregate(reverse(slice(run, greatest(1, i + 2 - {min_words}), least(i + 1, {min_words}))), {grow}))"
    windows = f"array_distinct(filter(concat({ahead}, transform({back}, (n, i) -> struct(i + 1 - n AS s, n AS n))), w -> w.n > 0))"
    found = written(runs.withColumn("windows", F.expr(windows)))
    depth = found.agg(F.max(F.expr("array_max(transform(windows, w -> w.n))"))).first()[0]
    if depth is None:
        return runs.sparkSession.createDataFrame([], "_h1 bigint, _h2 bigint, removed array<int>")
    ranks = doubled(found, depth)
    # the LCP interval of a window of n lines: equal ranks by its first and by its last 2^k lines, 2^k <= n < 2^(k+1)
    level = "cast(floor(log2(w.n)) AS int)"
    named = f"transform(windows, w -> struct(run[w.s].n AS at, w.n AS n, ranks[{level}][w.s] AS r1, ranks[{level}][w.s + w.n - shiftleft(1, {level})] AS r2))"
    members = written(ranks.select(*KEY, "_first", F.explode(F.expr(named)).alias("w")).select(F.struct("_first", *KEY, "w.at").alias("pos"), "w.n", "w.r1", "w.r2"))
    firsts = written(members.groupBy("n", "r1", "r2").agg(F.min("pos").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    later = members.join(firsts, ["n", "r1", "r2"]).filter("pos > first").select("pos._h1", "pos._h2", F.struct("pos.at", "n").alias("w")).repartition(*KEY)
    return later.groupBy(*KEY).agg(F.collect_list("w").alias("w")).select(*KEY, F.expr("array_sort(array_distinct(flatten(transform(w, x -> sequence(x.at, x.at + x.n - 1)))))").alias("removed"))


def line_dedup(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` (with words) and ``removed`` (numbers of the deleted ones among them)."""
    seqs = written(sequences(docs.select("doc_id", text), text))
    removed = later_copies(stretches(seqs, min_words), min_words)
    effect = seqs.filter(F.col("n_words") >= min_words).select(*KEY, "first", "last").join(removed, [*KEY], "left")
    effect = written(effect.filter("removed IS NOT NULL OR first <> last").select(*KEY, F.col("first").alias("_first"), F.col("removed").alias("_removed")))
    # a row travels as one struct, so that no name of the input meets one of ours; and always by sorted exchange: texts
    # may not fit beside a table of effects, and one plan serves every size
    t = F.col("_row").getField(text)
    d = keyed(docs.select(F.struct("*").alias("_row")), t).join(effect.hint("merge"), [*KEY], "left").withColumn("_l", F.split(t, "\n"))
    d = d.withColumn("_at", F.expr(f"filter(sequence(0, size(_l) - 1), i -> btrim(_l[i], {BLANK}) <> '')")).withColumn("n_lines", F.expr("coalesce(if(_l IS NULL, 0, size(_at)), 0)"))
    copy = "_first IS NOT NULL AND _first <> struct(_row.doc_id IS NOT NULL AS some, _row.doc_id AS id)"
    d = d.withColumn("removed", F.expr(f"CASE WHEN n_lines = 0 THEN cast(array() AS array<int>) WHEN {copy} THEN sequence(0, n_lines - 1) ELSE coalesce(_removed, cast(array() AS array<int>)) END"))
    d = d.withColumn("_stay", F.expr("CASE WHEN size(removed) > 0 THEN array_except(sequence(0, size(_l) - 1), transform(removed, n -> _at[n])) END"))
    d = d.withColumn("clean_text", F.when(F.size("removed") == 0, t).otherwise(F.expr("array_join(transform(_stay, i -> _l[i]), '\n')")))
    return d.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def line_dedup_stage(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with deduplicated text and its ``n_chars``; a document whose every line with words went is dropped."""
    # a partition's number keeps the optimiser from copying what the flag is made of into the filter
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*(rest or ["doc_id"])).alias("_doc"))
    d = line_dedup(rows, "text", min_words).withColumn("_some", F.expr("(n_lines = 0 OR size(removed) < n_lines) AND spark_partition_id() >= 0")).filter("_some")
    new = {"text": F.col("clean_text"), "n_chars": F.expr("CASE WHEN size(removed) > 0 THEN cast(length(clean_text) AS bigint) ELSE _doc.n_chars END") if "n_chars" in docs.columns else None}
    return d.select(*(new[c].alias(c) if c in new else F.col("doc_id") if c == "doc_id" else F.col("_doc").getField(c).alias(c) for c in docs.columns))
