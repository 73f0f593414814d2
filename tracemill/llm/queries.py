"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, embedding_dedup, language_id, mixing, secrets, simhash, token_counts, topk, toxicity, url_filter
from .common import id_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, query_modulus=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_fold("doc_id", 3) == 1
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~held_out))
    found = toxicity.assess(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    later = id_fold("doc_id", 2) == 1
    # Two arrivals: blobs that the first brought aren't scanned again with the second.
    found, _ = secrets.scan_in_turn([docs.where(~later), docs.where(later)])
    spans = secrets.listed(F.col("spans"))
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_language_id,
    op2_embedding_near_dedup,
    op3_url_filter,
    op4_byte_bpe,
    op5_mixing,
    op6_exact_topk,
    op7_toxicity,
    op8_simhash_near_dedup,
    op9_secret_scan,
    op10_token_counts,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": _op5(), "op6_exact_topk": OP6, "op9_secret_scan": _op9()}


def _op5() -> str:
    """Raking as a chain of common table expressions, all rounds; the operator ends when nothing moves."""
    margins, steps, last = mixing.MARGINS, [], "cell"
    for i in range(mixing.ROUNDS):
        for m in margins:
            name = f"r{i}_{m}"
            steps.append(
                f"{name} AS (SELECT c.* EXCLUDE (s) REPLACE (CASE WHEN s > 0 THEN raked * coalesce(t.target, 0) / s ELSE 0 END AS raked) "
                f"FROM (SELECT *, sum(raked) OVER (PARTITION BY {m}) AS s FROM {last}) c LEFT JOIN target_{m} t ON c.{m} = t.{m})"
            )
            last = name
    targets = ", ".join(
        f"target_{m} AS (SELECT {m}, pow(w, {mixing.TEMPER}) / sum(pow(w, {mixing.TEMPER})) OVER () AS target "
        f"FROM (SELECT {m}, sum(weight) AS w FROM cell GROUP BY {m}) x WHERE w > 0)"
        for m in margins
    )
    return f"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), row AS (
  SELECT *, CASE WHEN tokens < {mixing.SHORT} THEN 'note' WHEN tokens < {mixing.LONG} THEN 'article' ELSE 'essay' END AS topic FROM doc
), cell AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS weight,
    CAST(sum(tokens) AS DOUBLE) / sum(CAST(sum(tokens) AS DOUBLE)) OVER () AS raked
  FROM row GROUP BY source, lang, topic
), {targets}, {", ".join(steps)}, ratio AS (
  SELECT *, CASE WHEN weight > 0 THEN raked / weight ELSE 0 END AS ratio FROM {last}
), chance AS (SELECT source, lang, topic, ratio / max(ratio) OVER () AS probability FROM ratio)
SELECT doc_id, r.source, r.lang, r.topic, tokens, round(probability, 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / CAST({16**12} AS DOUBLE) < probability AS kept
FROM row r LEFT JOIN chance c ON r.source = c.source AND r.lang = c.lang AND r.topic = c.topic
"""


def _op9() -> str:
    parts, out = [], []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"m{i} AS (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS own, regexp_extract_all(t, '{p}', {r.group}) AS part, "
            f"string_split_regex(t, '{p}') AS gap FROM doc), "
            f"f{i} AS (SELECT doc_id, {i} AS kind_at, '{r.kind}' AS kind, length(part[i]) AS n, "
            "list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(own[1:i - 1], lambda x: length(x))), 0) AS start, length(own[i]) AS size "
            f"FROM (SELECT *, unnest(generate_series(1, len(own))) AS i FROM m{i}) x)"
        )
        out.append(f"SELECT doc_id, kind_at, kind, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM f{i} WHERE n >= {r.least}")
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)},
found AS ({" UNION ALL ".join(out)}),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_at) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""


OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
