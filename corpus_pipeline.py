"""A training corpus from raw documents: five stages, each by an operator of tracemill.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import byte_bpe, language_id, mixing, secrets, simhash
from tracemill.llm.common import checkpointed, id_fold, inner_prefix
from tracemill.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or null, go. A null lang becomes the one found.

    Null ids and repeated rows stay. Without any labelled text nothing can be told, and all go.
    """
    ship(spark)
    model = language_id.train(docs.where(id_fold("doc_id", 4) != 2))
    inner = inner_prefix(docs)
    found, told = language_id.identify(docs, model, prefix=inner), F.col(inner + "lang_pred")
    lang = F.coalesce("lang", told).alias("lang")
    return found.where(told != language_id.UNKNOWN).select(*(lang if c == "lang" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Ties, repeated rows and rows without a doc_id or text: see simhash_verified.keep_one.
    """
    ship(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by its kind in brackets; rows with null or repeated ids get the findings of their own text."""
    findings, _ = secrets.scan(docs)
    return secrets.redact(docs, findings)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that rake source, language and topic to tempered shares.

    Null margins are values of their own; empty texts weigh nothing and have the probability of their
    cell; repeated rows, and rows without an id, are kept or dropped alike.
    """
    return mixing.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document: token ids packed as little-endian unsigned 32-bit integers; none for null and empty texts."""
    ship(spark)
    found = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Language ID, SimHash and BPE have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written to a checkpoint for the next."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
