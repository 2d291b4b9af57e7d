"""A corpus in four stages: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Every stage works on all that the one before it kept.

Nulls: a null text is empty in every stage; a row with a null doc_id is kept where no other stands for its text. Repeated rows
and ties are decided as each stage's module states. Extra columns are kept until the packing, whatever their names. Texts of
any length are used whole. Empty tables give no rows; without labels the classifier rejects by its untrained score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import exact_dedup, near_copies, packing, quality
from vigilake.llm.common import materialize, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id."""
    return near_copies.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", different), ("packing", packed)]
#: No stage but the second can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
