"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Four rates are read from each text, per mille: symbols, upper-case letters, duplicate lines and words in
repeated five-word windows. For each stratum (the document's language) and rate, labelled documents decide
the cutoff: cutoffs are tested from the mildest to the harshest (fixed-sequence testing), each by the exact
binomial test of "this rule rejects more than ``alpha / rates`` of good documents". Levels are Bonferroni
corrected over strata and rates, so with probability 1 - ``delta`` every certified cutoff holds at once, and
by the union bound the rules together reject at most ``alpha`` of each stratum's good documents. Of the
certified cutoffs the one is taken that rejects most bad labelled documents, with a good one lost counted
ten times. A stratum with too few good labels has no cutoff and rejects nothing.

Defined results: null text counts as empty (no words, so ``base_failed``); null language is a stratum of its
own, as is the empty one; a very long text is measured whole; of cutoffs that gain equally (ties) the milder one is taken; a document labelled twice counts once, with its lowest quality; null labels are left out; repeated rows
are judged alike, each row returned; an empty table gives an empty result; without labels only the base rules
reject; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import hash_join, written

RATES = ("symbol_rate", "upper_rate", "dup_line_rate", "repeat_rate")
ALPHA, DELTA, COST = 0.05, 0.05, 10
#: [^\x20\x09-\x0D]+ are words; this is the other side of that class, for split and trim.
WS = r"\\x20\\x09-\\x0D"
BLANK = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the four rates.

    A scan with no exchange. Windows of five words are compared by a 64-bit hash within one text; texts without
    a repeat leave after one ``array_distinct``, the rest sort their windows, so cost is n log n in the words.
    """
    t = f"coalesce(`{text}`, '')"
    d = docs.withColumn("_text", F.expr(t)).withColumn("_trim", F.expr(f"btrim(_text, {BLANK})"))
    d = d.withColumn("_words", F.expr(f"CASE WHEN _trim = '' THEN cast(array() AS array<string>) ELSE split(_trim, '[{WS}]+') END"))
    d = d.withColumn("_lines", F.expr(f"filter(split(_text, '\\n'), l -> btrim(l, {BLANK}) <> '')"))
    d = d.withColumn("n_words", F.expr("cast(size(_words) AS bigint)"))
    d = d.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
    d = d.withColumn("_wins", F.expr("CASE WHEN n_words > 4 THEN transform(sequence(0, cast(n_words - 5 AS int)), i -> xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2], _hashes[i + 3], _hashes[i + 4])) END"))
    d = d.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_wins)) < size(_wins) THEN sort_array(transform(_wins, (h, i) -> struct(h, i))) END"))
    d = d.withColumn("_repeats", F.expr("sort_array(transform(filter(_sorted, (s, k) -> s.h = get(_sorted, k - 1).h OR s.h = get(_sorted, k + 1).h), s -> s.i))"))
    d = d.withColumn("n_repeat_words", F.expr("cast(coalesce(aggregate(_repeats, struct(0 AS n, -5 AS last), (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last), a -> a.n), 0) AS bigint)"))
    d = d.withColumn("word_chars", F.expr("cast(length(array_join(_words, '')) AS bigint)"))
    d = d.withColumn("n_symbols", F.expr("cast(regexp_count(_text, '[#*$%&|<>]') AS bigint)"))
    d = d.withColumn("_upper", F.expr("cast(regexp_count(_text, '[A-Z]') AS bigint)"))
    d = d.withColumn("_n_lines", F.expr("cast(size(_lines) AS bigint)")).withColumn("n_dup_lines", F.expr("_n_lines - size(array_distinct(_lines))"))
    per_mille = {"symbol_rate": ("n_symbols", "word_chars"), "upper_rate": ("_upper", "word_chars"), "dup_line_rate": ("n_dup_lines", "_n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
    for name, (part, of) in per_mille.items():
        d = d.withColumn(name, F.expr(f"cast(least(1000, 1000 * {part} DIV greatest({of}, 1)) AS int)"))
    d = d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return d.drop("_text", "_trim", "_words", "_hashes", "_lines", "_wins", "_sorted", "_repeats", "_upper", "_n_lines")


def coded(stratum: str) -> Column:
    """A stratum's name as a key of joins, where null is a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit(""))


def cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff per rate or null; a null stratum is one): certified by ``labels`` (doc_id, quality) joined to ``measures``.

    Counts are histograms of at most 1001 values for each stratum and rate; only those reach the tests.
    """
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality IN (0, 1)")
    seen = measures.select("doc_id", F.col(stratum).alias("stratum"), *RATES).join(one, "doc_id")
    long = seen.select("stratum", "quality", F.expr(f"stack({len(RATES)}, {', '.join(f'{chr(39)}{r}{chr(39)}, {r}' for r in RATES)}) AS (rate, value)"))
    hist = long.groupBy("stratum", "rate", "value").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # a row per stratum and rate: [good with value v, bad with value v] for v of 0..1000
    counts = hist.groupBy("stratum", "rate").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.map_from_entries(F.collect_list(F.struct("value", F.struct("good", "bad")))).alias("at"))
    tests = written(counts)
    n_tests = tests.count()
    if not n_tests:
        return tests.sparkSession.createDataFrame([], "stratum string, " + ", ".join(f"{r} int" for r in RATES))
    risk, level = alpha / len(RATES), delta / n_tests
    # the largest number of good rejections whose exact lower tail under ``risk`` is at most ``level``; -1: none
    most = f"""aggregate(sequence(0L, cast(floor(n_good * {risk}D) AS bigint)), struct(n_good * ln(1 - {risk}D) AS logp, 0D AS tail, -1L AS k),
        (a, k) -> struct(a.logp + CASE WHEN n_good > k THEN ln((n_good - k) / cast(k + 1 AS double)) + ln({risk}D / (1 - {risk}D)) ELSE 0D END AS logp,
                         a.tail + exp(a.logp) AS tail, CASE WHEN a.tail + exp(a.logp) <= {level}D THEN k ELSE a.k END AS k), a -> a.k)"""
    # from value > 999 down to value > 0: rejected so far, and the best certified gain; ties keep the milder cutoff
    best = f"""aggregate(sequence(999, 0), struct(0L AS g, 0L AS b, cast(0 AS decimal(38,0)) AS gain, cast(null AS int) AS cut),
        (a, t) -> CASE WHEN a.g + coalesce(at[t + 1].good, 0L) > most THEN struct(most + 1 AS g, a.b AS b, a.gain AS gain, a.cut AS cut)
            ELSE struct(a.g + coalesce(at[t + 1].good, 0L) AS g, a.b + coalesce(at[t + 1].bad, 0L) AS b,
                greatest(a.gain, cast(cast(n_good AS decimal(19,0)) * (a.b + coalesce(at[t + 1].bad, 0L)) - cast({COST} * n_bad AS decimal(19,0)) * (a.g + coalesce(at[t + 1].good, 0L)) AS decimal(38,0))) AS gain,
                CASE WHEN cast(cast(n_good AS decimal(19,0)) * (a.b + coalesce(at[t + 1].bad, 0L)) - cast({COST} * n_bad AS decimal(19,0)) * (a.g + coalesce(at[t + 1].good, 0L)) AS decimal(38,0)) > a.gain THEN t ELSE a.cut END AS cut) END, a -> a.cut)"""
    found = tests.withColumn("most", F.expr(most)).withColumn("cut", F.expr(best))
    return found.groupBy("stratum").agg(*(F.max(F.when(F.col("rate") == r, F.col("cut"))).alias(r) for r in RATES))


def judged(measures: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measures`` with ``kept``: false if ``base_failed`` or a rate lies above its stratum's certified cutoff."""
    table = written(cuts.select(coded("stratum").alias("_stratum"), *(F.col(r).alias(f"_cut_{r}") for r in RATES)))
    above = " OR ".join(f"coalesce({r} > _cut_{r}, false)" for r in RATES)
    d = hash_join(measures.withColumn("_stratum", coded(stratum)), table, ["_stratum"], most_rows=10_000)
    # a partition's number keeps the optimiser from copying the measures, lambda by lambda, into a filter on the verdict
    return d.withColumn("kept", F.expr(f"NOT (base_failed OR {above}) AND spark_partition_id() >= 0")).drop("_stratum", *(f"_cut_{r}" for r in RATES))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the counts, the rates, base_failed and kept."""
    m = written(measured(docs.select("doc_id", "lang", "text")).drop("text"))
    return judged(m, cutoffs(m, labels)).drop("lang")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; columns and order of columns stay."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "lang", "text")  # so that no name of the input meets one of ours
    m = written(measured(rows).drop("text"))  # with the rows, so that nothing is measured twice; cutoffs read the narrow columns
    return judged(m, cutoffs(m.drop("_row"), labels)).filter("kept").select("_row.*")
