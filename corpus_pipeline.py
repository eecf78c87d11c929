"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Quality classifier, exact dedup, near dedup, mixing to target weights, packing. Every stage takes (spark, docs, sf_dir);
all but the last return the columns of ``documents``.

Cases: documents with a null or blank text are rejected by the first stage; a null language is judged by the threshold
of all, a null source is a source of its own, null keys are kept; texts of any length are read whole; of equal texts
the longest original stays, then the smallest key, and of near copies the one with the smallest key; repeated rows are
copies like any others; further columns of any name come along untouched; an empty table gives an empty result at every
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscope.llm import exactdedup, mixing, neardedup, packing, quality, tokens
from veilscope.llm.shared import fresh_path, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is below their language's threshold."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    ship(spark)
    return exactdedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies."""
    ship(spark)
    return neardedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, cut where a run of blocks begins or ends."""
    ship(spark)
    return mixing.mixed_documents(docs, count="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    ship(spark)
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the language model nor the sketches; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = fresh_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
