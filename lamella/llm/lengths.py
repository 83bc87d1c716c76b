"""Exact length histogram: documents by encoded length, with suffix sums.

A row for each length L that occurs: how many documents have it, and what lies at or above it. With these,
every question about a context limit is one look-up: documents longer than a limit, tokens kept if texts are
truncated there (``truncated_tokens`` = tokens of shorter documents + L times the documents of L or more), and
any exact quantile. Lengths between two rows follow linearly from the row above.

Texts are encoded in a narrow pass; the histogram is a partial count. Suffix sums go over blocks of lengths and
then within each block, so no task gets more than 4096 rows or a row per block.

Defined results: null text counts as empty, of length 0; a very long text is encoded whole and is a length like others; documents of
one length (ties) share a row; repeated rows count each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.bpe import BYTE_BPE, token_counts
from lamella.llm.common import written

BLOCK = 4096


def histogram(docs: DataFrame, text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(length, n_docs, docs_at_least, tokens_at_least, truncated_tokens, quantile): one row for each length."""
    counts = token_counts(docs.select(text), text, path, "length")
    return suffix_sums(written(counts.groupBy("length").agg(F.count("*").alias("n_docs"))))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """From (length, n_docs). ``quantile``: the share of documents that are not longer."""
    c = counts.withColumn("_block", F.expr(f"length DIV {BLOCK}")).withColumn("_tokens", F.expr("length * n_docs"))
    sums = c.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 4096 lengths
    blocks = sums.select("_block", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"))
    total = sums.agg(F.sum("_d").alias("_all"), F.sum("_t").alias("_all_tokens"))
    within = Window.partitionBy("_block").orderBy(F.desc("length"))
    d = c.join(blocks, "_block").crossJoin(F.broadcast(total))  # one row of totals
    return d.select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("_d_above")).alias("docs_at_least"),
        (F.sum("_tokens").over(within) + F.col("_t_above")).alias("tokens_at_least"),
        "_all",
        "_all_tokens",
    ).select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        F.expr("_all_tokens - tokens_at_least + length * docs_at_least").alias("truncated_tokens"),
        F.expr("cast(_all - docs_at_least + n_docs AS double) / _all").alias("quantile"),
    )


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, tokens, truncated_tokens) for any context limits, from the histogram alone."""
    one = hist.select(F.explode(F.array(*map(F.lit, limits))).alias("limit"), "length", "n_docs")
    return one.groupBy("limit").agg(
        F.sum(F.expr("if(length > limit, n_docs, 0)")).alias("docs_longer"),
        F.sum(F.expr("length * n_docs")).alias("tokens"),
        F.sum(F.expr("least(length, limit) * n_docs")).alias("truncated_tokens"),
    )
