"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, line_dedup, mixing, packing, quality, sharding, simhash, toxicity, warc
from ..session import spread
from ._common import pick


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, **wanted: str) -> DataFrame:
    """The documents, over all cores."""
    return spread(pick(_table(spark, sf_dir, "documents"), **wanted))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = sharding.histogram_sort(docs, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text")
    return simhash.near_duplicates(docs, words=3, distance=2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text", source="source")
    out, _ = quality.verdicts(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text")
    out = line_dedup.line_dedup(docs, report=True)
    return out.select("doc_id", "removed_runs", "removed_chars", F.length("text").cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text")
    return packing.pack(docs, window=2048)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(_table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    read = warc.read_records(warc.archive_pages(pages), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    return mixing.mixture(docs, max_repeats=mixing.MAX_REPEATS, block_tokens=mixing.BLOCK_TOKENS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(pick(_table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding"), every=50, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, doc_id="doc_id", text="text").withColumn("held_out", langid.held_out(F.col("doc_id"), 3, 1))
    labels = pick(_table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic")
    model = toxicity.train(toxicity.labelled_rows(docs.where(~F.col("held_out")), labels), docs)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op6_packing": op6_packing,
    "op9_warc": op9_warc,
    "op1_mixing": op1_mixing,
    "op8_language_id": op8_language_id,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op2_toxicity": op2_toxicity,
    "op5_sharding": op5_sharding,
}

_OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), one_word AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), win AS (
  SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS k FROM one_word
  WINDOW p AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win WHERE k IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS j FROM again) GROUP BY rid
), line AS (
  SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), worded AS (
  SELECT rid, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM line
), normal AS (
  SELECT rid, host, text, line, len(lw) AS n,
         translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM worded WHERE len(lw) > 0
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM normal GROUP BY rid
), hosts AS (
  SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host
), template AS (
  SELECT l.host, l.k FROM (SELECT host, k, count(DISTINCT text) AS n FROM normal GROUP BY host, k) l
  JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  WHERE l.n > {min_docs} AND l.n > {host_share}::DOUBLE * h.texts
), removed AS (
  SELECT rid, sum(n)::BIGINT AS n FROM normal l JOIN template t ON l.k = t.k AND l.host IS NOT DISTINCT FROM t.host GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN removed USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < {keep_share}::DOUBLE * n_words) AS kept,
       removed_words
FROM m
""".format(min_docs=quality.MIN_DOCS, host_share=quality.HOST_SHARE, keep_share=quality.KEEP_SHARE)

_OP9_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), m AS (
  SELECT *, strlen(html) AS bytes, sha256(html) AS digest FROM p
), t AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS top FROM m
), r AS (
  SELECT *, bytes >= 100 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM t
)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to, url
FROM r
"""

# The exponent that bisection finds has a closed form for a limit on repeats.
_OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), s AS (
  SELECT source, sum(tokens)::BIGINT AS n FROM d GROUP BY source
), e AS (
  SELECT max(n) AS top, min(n) AS low, sum(n) AS total,
         CASE WHEN max(n)::DOUBLE / min(n) <= {limit} THEN 0.0::DOUBLE ELSE 1 - ln({limit}::DOUBLE) / ln(max(n)::DOUBLE / min(n)) END AS a
  FROM s WHERE n > 0
), w AS (
  SELECT source, n, pow(n::DOUBLE / total, a) / sum(pow(n::DOUBLE / total, a)) OVER () AS w FROM s, e WHERE n > 0
), b AS (
  SELECT source, n, w, greatest(n, floor(w * (max(n / w) OVER ()) + 0.5)::BIGINT) AS budget, greatest(1, floor(w * {block} + 0.5)::BIGINT) AS quota FROM w
), t AS (
  SELECT source, n, budget // n AS passes, budget % n AS rest, quota FROM b
  UNION ALL SELECT source, 0, 1, 0, 1 FROM s WHERE n = 0
), each AS (
  SELECT d.*, t.n, t.passes, t.rest, t.quota, unnest(generate_series(0::BIGINT, t.passes - CASE WHEN t.rest > 0 THEN 0 ELSE 1 END)) AS pass
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || pass) AS key FROM each
), a AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY key, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM k
), u AS (
  SELECT *, (pass * n + ahead) // quota AS block FROM a WHERE pass < passes OR ahead < rest
)
SELECT doc_id, source, pass, tokens, block::BIGINT AS block,
       (row_number() OVER (PARTITION BY block ORDER BY md5(key || ':' || block), tokens) - 1)::BIGINT AS slot
FROM u
""".format(limit=mixing.MAX_REPEATS, block=mixing.BLOCK_TOKENS)

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _OP1_SQL,
    "op9_warc": _OP9_SQL,
    "op7_quality_rules": _OP7_SQL,
}
