"""Corpus pipeline: quality rules, near-dedup, personal data, mixing, encoding.

Every stage reads the Parquet table its predecessor wrote (``run`` writes it to the
shared folder) and returns the columns of ``documents``, but for the last, which
returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import minmax_dedup, pii_boost, piece_codec, quality_mcd, source_mixing
from rowloom.llm._shared import discard, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the remaining tokens that the mixture takes, each document once at most.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_mcd.keep_good(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minmax_dedup.drop_near_duplicates(docs.select(COLUMNS), width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    return pii_boost.redact(docs.select(COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of sources by target weights."""
    docs = docs.select(COLUMNS)
    return source_mixing.Mixture(docs, share=MIX_SHARE, max_epochs=MIX_EPOCHS).documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact."""
    return piece_codec.encode_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Covariance estimates, min-hashing and boosted trees are beyond SQL; tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
            if last is not None:
                discard(last)
            last = docs
    return docs
