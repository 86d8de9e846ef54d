"""The registered queries of the training-data operators, and the SQL that repeats them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import avi_media, byte_bpe, chat_template, kdtree_topk, mixing, ngram_join, phrase_dedup, suffix_dedup, token_counts, toxicity
from taxaflow.llm.common import table

EXTRA_TURN = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TURN).alias("text"))
    return chat_template.format_conversations(rows.unionByName(extra))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.media_digests(table(spark, sf_dir, "documents"))


def op9_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_token_counts, op3_toxicity, op4_suffix_dedup, op5_byte_bpe, op6_phrase_dedup, op7_ngram_join, op8_avi_media, op9_kdtree_topk, op10_mixing)}

WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op4_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
g AS (SELECT r, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM g JOIN m USING (k) WHERE least < doc_id),
run AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM hit) GROUP BY r, n),
gap AS (SELECT r, a, b, COALESCE(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM run),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) || substr(max(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)""",
    "op6_phrase_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i FROM g JOIN m USING (k) WHERE least < doc_id) CROSS JOIN range(0, 13) t(j)),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op7_ngram_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS (SELECT DISTINCT r, k FROM (SELECT r, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS node FROM s GROUP BY r),
known AS (SELECT node, min(doc_id) AS least, max(n) AS n, min(r) AS r FROM n JOIN d USING (r) WHERE doc_id IS NOT NULL GROUP BY node),
both_ AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM known x JOIN s p ON p.r = x.r JOIN s q ON q.k = p.k JOIN known y ON y.r = q.r WHERE x.node <> y.node AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN known x ON x.node = a JOIN known y ON y.node = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT node AS a, node AS b FROM known UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
part AS (SELECT reach.a AS node, min(least) AS component_id FROM reach JOIN known ON known.node = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN COALESCE(component_id, doc_id) END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN part USING (node)""",
    "op9_kdtree_topk": """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20""",
}
