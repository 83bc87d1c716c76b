"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that is written
and read again before the next. All but the last return the columns of ``documents``.

Defined results, by stage, each as its operator's module has it: a null, empty or blank text has fewer than ten words and goes
with the quality rules; a stage given such texts all the same (line dedup, near-dedup, secret scans) keeps them as they are, and
packing gives them the closing id. Very long texts go through whole. Equal texts fold in line dedup: the one of the lowest id stays
if they have 50 words, and near-dedup keeps one of the shorter ones. Rows equal in every column are one document there and one of
them stays; the quality rules keep or drop them together. Ties go to the lowest id, null ids last in near-dedup and first in line
dedup. Empty tables give empty tables of the same columns. More columns than those of ``documents``, whatever their names, come
through all stages but packing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm.common import forget, making, written
from lamella.llm.dart_minhash import near_dedup_stage
from lamella.llm.line_dedup import line_dedup_stage
from lamella.llm.packing import pack
from lamella.llm.quality import quality_stage
from lamella.llm.queries import table
from lamella.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_stage(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document left without a line goes with them."""
    return line_dedup_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup_stage(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: a row for each piece of a document, with its ids."""
    return pack(docs)


#: Scratch tables of each stage's last run by place and folder: the next stage removes them, as its documents were written and read again.
_left: dict[tuple[int, str], list[DataFrame]] = {}


def _stage(place: int, f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old = _left.pop((place - 1, sf_dir), [])
        if old and not any(t.scratch.rsplit("/", 1)[1] in name for t in old for name in docs.inputFiles()):
            forget(*old)
        with making() as made:
            out = f(spark, docs, sf_dir)
        _left[place, sf_dir] = made
        return out

    return run_stage


STAGES = [(name, _stage(i, f)) for i, (name, f) in enumerate([("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("packing", packing)])]

#: Automata, signatures and encoders have no SQL form; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
