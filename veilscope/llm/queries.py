"""Queries of this subpackage: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chatquotes, exactdedup, htmltext, media, mixing, neardedup, packing, quality, tokenfile, tokens, toxicity
from .shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(_read(spark, sf_dir, "documents"))


def op1_chatquotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatquotes.threaded(_read(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(_read(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op10_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.dedup(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_chatquotes": op1_chatquotes,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_exactdedup": op4_exactdedup,
    "op5_toxicity": op5_toxicity,
    "op6_htmltext": op6_htmltext,
    "op7_packing": op7_packing,
    "op8_media": op8_media,
    "op9_tokenfile": op9_tokenfile,
    "op10_neardedup": op10_neardedup,
}

ORACLES: dict[str, str] = {
    "op1_chatquotes": chatquotes.THREADS_SQL,
    "op3_mixing": mixing.MIX_SQL,
    "op4_exactdedup": exactdedup.DEDUP_SQL,
}
