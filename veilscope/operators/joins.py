"""Joins of the engine: benchmark build, enrichment, resume, look-ups with fall-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def enrich(df: DataFrame, dimension: DataFrame, key: str, value: str, order: str, default: str = "OTHER") -> DataFrame:
    """``df`` with the last value of its key, or the default."""
    return df.join(latest(dimension.select(key, value, order), [key], order).drop(order), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that aren't done yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, source: DataFrame, keys: list[list[str]], value: str, order: str) -> DataFrame:
    """``df`` with ``value`` from the first list of keys that finds a row; of a key's rows the last by ``order`` counts
    (ties: the greatest value)."""
    out, found = df, []
    for i, columns in enumerate(keys):
        side = source.groupBy(*(F.col(c).alias(f"_{i}_{c}") for c in columns)).agg(F.max(F.struct(order, value))[value].alias(f"_value{i}"))
        on = [F.col(c) == F.col(f"_{i}_{c}") for c in columns]
        out = out.join(side, on, "left").drop(*(f"_{i}_{c}" for c in columns))
        found.append(f"_value{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def benchmark_rows(labels: DataFrame, examples: DataFrame, keys: list[str], found: Column, image: Column, box: Column) -> DataFrame:
    """Label rows with their examples and an ``outcome``: kept, or why not. Rows without an example are left out."""
    joined = labels.join(examples, keys)
    return joined.withColumn("outcome", F.when(~image, "no_image").when(~found, "no_span").when(~box, "no_box").otherwise("kept"))


def summary(rows: DataFrame) -> DataFrame:
    """Counters of a benchmark build, in one pass."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return rows.agg(F.count(F.lit(1)).alias("total_seen"), count("kept").alias("total_kept"), count("no_span").alias("skipped_no_span"), count("no_image").alias("skipped_no_image"), count("no_box").alias("skipped_no_bbox"))


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    """How many rows of each type a benchmark build has kept."""
    return rows.where("outcome = 'kept'").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
