"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import decontaminate, katz, knn_quality, line_dedup, mixing, quality_rules, simhash, token_counts, token_output, url_filter
from cataloom.llm.common import scratch_path, table

COUNT_MODEL, OUTPUT_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.host_quality(table(spark, sf_dir, "documents"))
    rate = F.greatest(*[F.col(f"{rule}_rate") for rule in quality_rules.HostRules().failures()])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected", F.round(rate, 6).alias("host_rate"))


def _arrivals(docs: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All rows as two batches that come one after the other, by a hash; rows of one id, null ones too, come together."""
    first = F.xxhash64(column) < 0
    return docs.where(first), docs.where(~first)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches through one cache: the second finds the texts of the first there."""
    cache = token_counts.DigestCache(spark, scratch_path(spark, "token-cache"))
    found = [token_counts.token_counts(part, cache, public_tokenizers.path(COUNT_MODEL)) for part in _arrivals(table(spark, sf_dir, "documents"))]
    return found[0].unionByName(found[1]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, of which the second is taken out and put in again, so that filters are probed, emptied and filled."""
    docs = table(spark, sf_dir, "documents")
    first, second = _arrivals(docs)
    index = line_dedup.LineIndex(spark, scratch_path(spark, "lines"))
    index.insert(first)
    index.insert(second)
    index.delete(second.select("doc_id"))
    index.insert(second)
    return line_dedup.cleaned(docs, index, digest=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.seed_table(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, katz.train(docs, scratch_path(spark, "katz")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), "place")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(OUTPUT_MODEL))
    return token_output.token_digest(spark, folder)


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn_quality.score(docs, knn_quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_line_dedup, op4_simhash, op5_decontamination, op6_url_filter, op7_katz, op8_mixing, op9_token_output, op10_knn_quality)}


_RULES = quality_rules.HostRules()

OP1_SQL = rf"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS g FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c >= 2),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n, count(*) AS all_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, w.host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(all_lines, 0) AS n_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < {_RULES.min_words} AS few, 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS rep,
  100 * n_symbols > {_RULES.max_symbols_percent} * n_words AS sym, 100 * n_dup_lines > {_RULES.max_dup_lines_percent} * n_lines AS dup FROM s),
h AS (SELECT host, r, count(*)::DOUBLE AS n, count(*) FILTER (b)::DOUBLE AS x FROM
  (SELECT host, unnest(['few', 'rep', 'sym', 'dup']) AS r, unnest([few, rep, sym, dup]) AS b FROM f) GROUP BY host, r),
m AS (SELECT r, sum(n) AS docs, count(*) - 1 AS free, sum(n * n) AS sq, sum(x) / sum(n) AS m FROM h GROUP BY r),
v AS (SELECT r, sum(n * (x / n - m) ** 2) AS v FROM h JOIN m USING (r) GROUP BY r),
k AS (SELECT r, m, CASE WHEN m * (1 - m) * (docs - sq / docs - free) > 0 THEN (v - m * (1 - m) * free) / (m * (1 - m) * (docs - sq / docs - free)) ELSE 0 END AS rho FROM m JOIN v USING (r)),
a AS (SELECT r, m, 1 / least(greatest(rho, 1e-6), 0.999) - 1 AS weight FROM k),
p1 AS (SELECT host, m, n + weight AS w, (x + m * weight) / (n + weight) AS p FROM h JOIN a USING (r)),
bad AS (SELECT host, max(p) AS rate, max(p - {_RULES.tail} * sqrt(p * (1 - p) / (w + 1)) - m) > {_RULES.max_excess} AS bad FROM p1 GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed, NOT (few OR rep) AND NOT bad AS kept, bad AS host_rejected, round(rate, 6) AS host_rate
FROM f JOIN bad ON f.host IS NOT DISTINCT FROM bad.host"""

OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.i, k.line, d.key IS NOT NULL AND k.doc_id <> d.low AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: XXH64 (4), tokenizers (2, 9), edit search (5), fitted models (6, 7, 10), hash draws (8)."""
    return {"op1_quality_rules": OP1_SQL, "op3_line_dedup": OP3_SQL}
