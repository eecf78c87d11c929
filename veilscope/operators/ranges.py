"""Ranges of about equal numbers of rows, so that no window holds a whole table in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 128
#: About so many rows, of all groups together, fix the ranges; a group with few of them is small.
SAMPLE = 65_536


def beside(df: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the columns of ``side``, a row for each group at most; null keys are groups too."""
    if not keys:
        return df.crossJoin(F.broadcast(side))  # one row
    same = reduce(lambda a, b: a & b, (F.col(f"_all.{k}").eqNullSafe(F.col(f"_group.{k}")) for k in keys))
    return df.alias("_all").join(side.alias("_group"), same, "left").select("_all.*", *(f"_group.{c}" for c in side.columns if c not in keys))


def ranged(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """``df`` with ``_range``, from 0 on in the order of a column of numbers without nulls, within each group of ``keys``.

    The limits are quantiles of a sample by a hash of the number: they are the same in every run, so tasks that are
    repeated after a loss agree with the others. Rows of one number lie in one range."""
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    drawn = beside(df.select(*keys, order), size).where(F.pmod(F.xxhash64(order), F.greatest(F.lit(1), F.ceil(F.col("_size") / SAMPLE))) == 0)
    limits = drawn.groupBy(*keys).agg(F.percentile(order, [i / RANGES for i in range(1, RANGES)]).alias("_limits"))
    below = F.size(F.filter(F.coalesce("_limits", F.array().cast("array<double>")), lambda x: x < F.col(order)))
    return beside(df, limits, *keys).withColumn("_range", below).drop("_limits")
