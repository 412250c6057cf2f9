"""Training-corpus pipeline: five stages over ``documents``, each on what the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkplume.llm import bpe, minhash, pii, quality
from sparkplume.llm import decontaminate as D
from sparkplume.llm.language import held_out
from sparkplume.session import materialize

QUALITY_LIMIT = 0.7
NEAR_LIMIT = (80, 100)  # of the stage; op2 has its own
TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorisation machine scores below the limit.

    Null and empty texts are scored as empty ones; ids play no part, so null and repeated ones are judged row by row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.train(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return quality.accepted(docs, machine, QUALITY_LIMIT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words are linked with nothing and stay, and so do rows with a null id. Of rows that repeat an id one stays.
    """
    return minhash.deduplicated(docs, NEAR_LIMIT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; ids play no part. An empty benchmark drops nothing.
    """
    return D.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; every document stays, whatever its id, and a null text stays null."""
    return pii.redacted(docs, pii.train(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: (doc_id, lang, source, n_tokens, ids); a null or empty text has none, every row stays."""
    return bpe.tokenized(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_redaction", redact_personal_data),
    ("bpe_encoding", tokenize),
]

ORACLE_SQL = None  # the stages learn and hash; they are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
