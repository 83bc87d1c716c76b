"""The registered queries of the text operators: each reads its whole table and derives the digest its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import importable
from lamella.llm.bpe import encode
from lamella.llm.chroma import fingerprints, rendered, search
from lamella.llm.dart_minhash import classes
from lamella.llm.hilbert import shards
from lamella.llm.lengths import histogram
from lamella.llm.line_dedup import line_dedup
from lamella.llm.packing import pack
from lamella.llm.quality import ALPHA, COST, DELTA, RATES, quality
from lamella.llm.secret_scan import digest, scan
from lamella.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), 40)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.expr("cast(size(ids) AS bigint)").alias("n_tokens"),
        F.expr("sha2(array_join(cast(ids AS array<string>), ' '), 256)").alias("ids_sha256"),
        F.expr("sha2(decoded, 256)").alias("decoded_sha256"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a short melody; its fingerprint's class for all rows, and the matches of those whose id 20 divides."""
    media = rendered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    members, matches = search(fingerprints(media, "vec_id"), "vec_id", "vec_id % 20 = 0")
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    rows = members.select(F.lit("member").alias("kind"), "vec_id", "class_id", F.col("n_items").cast("long").alias("n_items"), *none("offset", "hits", "overlap", "bit_errors"))
    return rows.union(matches.select(F.lit("match"), "query_class", "class_id", *none("n_items"), *(F.col(c).cast("long") for c in ("offset", "hits", "overlap", "bit_errors"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.expr("size(removed)").alias("n_removed"), F.expr("array_join(cast(removed AS array<string>), ',')").alias("removed"), F.expr("crc32(clean_text)").alias("clean_crc32"), F.expr("cast(length(clean_text) AS bigint)").alias("clean_chars"))


WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('='||lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, CASE WHEN trim(t, {WS}) = '' THEN [] ELSE string_split_regex(trim(t, {WS}), '[\x20\x09-\x0D]+') END AS ws,
        list_filter(string_split(t, chr(10)), lambda l: trim(l, {WS}) <> '') AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest(range(5)) AS o FROM win JOIN rep USING (rid, g)) GROUP BY rid),
c AS (SELECT w.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, strlen_sum AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, length(array_to_string(ws, ''))::BIGINT AS strlen_sum FROM w) w LEFT JOIN cov USING (rid)),
m AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        [least(1000, 1000 * n_symbols // greatest(word_chars, 1)), least(1000, 1000 * upper // greatest(word_chars, 1)),
         least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)), least(1000, 1000 * n_repeat_words // greatest(n_words, 1))] AS rates FROM c),
lab AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id HAVING min(quality) IN (0, 1)),
long AS (SELECT stratum, q, k, rates[k] AS v FROM (SELECT stratum, q, rates, unnest([1, 2, 3, 4]) AS k FROM m JOIN lab USING (doc_id))),
size AS (SELECT stratum, k, count(*) FILTER (q = 1) AS ng, count(*) FILTER (q = 0) AS nb FROM long GROUP BY stratum, k),
terms AS (SELECT stratum, k, ng, unnest(range(0, floor(ng * {ALPHA / len(RATES)})::BIGINT + 1)) AS x FROM size),
tails AS (SELECT stratum, k, x, sum(exp(lgamma(ng + 1) - lgamma(x + 1) - lgamma(ng - x + 1) + x * ln({ALPHA / len(RATES)}) + (ng - x) * ln(1 - {ALPHA / len(RATES)}))) OVER (PARTITION BY stratum, k ORDER BY x) AS tail FROM terms WHERE x <= ng),
most AS (SELECT size.*, coalesce((SELECT max(x) FROM tails WHERE tails.stratum = size.stratum AND tails.k = size.k AND tail <= {DELTA} / (SELECT count(*) FROM size)), -1) AS most FROM size),
cut AS (SELECT most.stratum, most.k, t, count(*) FILTER (q = 1 AND v > t) AS g, count(*) FILTER (q = 0 AND v > t) AS b, any_value(ng) AS ng, any_value(nb) AS nb, any_value(most) AS most
        FROM most JOIN long USING (stratum, k), range(0, 1000) r(t) GROUP BY most.stratum, most.k, t),
best AS (SELECT stratum, k, arg_max(t, (ng::HUGEINT * b - {COST} * nb::HUGEINT * g) * 1000 + t) AS t FROM cut WHERE g <= most AND ng::HUGEINT * b - {COST} * nb::HUGEINT * g > 0 GROUP BY stratum, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.stratum = m.stratum AND m.rates[best.k] > best.t) AS kept FROM m
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secrets": op6_secrets,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_chroma": op8_chroma,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES: dict[str, str] = {"op9_quality": OP9_SQL}
