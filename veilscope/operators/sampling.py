"""Stratified samples with a deterministic order: MD5 of seed and key in place of a shuffle.

All forms rank within strata by window functions, in parts of a stratum first, of each of which no more rows than the
sample has go on; so a large stratum is never sorted in one task, and nothing is collected. The number of strata is small
by nature (field types); quotas come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts in which a stratum is ranked first.
PARTS = 64


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _quotas(df: DataFrame, stratum: str, n: int, remainder: bool) -> DataFrame:
    """``_quota`` of each stratum: n over the number of strata, the first ones in order take the remainder."""
    strata = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    ranked = strata.withColumn("_place", F.row_number().over(Window.orderBy(stratum)) - 1).withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy()))
    extra = F.when(F.col("_place") < n % F.col("_strata"), 1).otherwise(0) if remainder else F.lit(0)
    return ranked.withColumn("_quota", F.floor(F.lit(n) / F.col("_strata")) + extra).select(stratum, "_quota")


def _leading(df: DataFrame, stratum: str, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each stratum with their ``_rank``."""
    rank = lambda *group: F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    some = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_rank", rank(stratum, "_part")).where(F.col("_rank") <= n).drop("_part")
    return some.withColumn("_rank", rank(stratum)).where(F.col("_rank") <= n)


def quota(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, an equal share for each stratum; a short stratum is not made up for."""
    first = _leading(df, stratum, key, [shuffle_key(F.col(key), seed), F.col(key)], n)
    return first.join(_quotas(df, stratum, n, True), stratum).where("_rank <= _quota").drop("_rank", "_quota")


def backfilled(df: DataFrame, stratum: str, key: str, n: int, seed: int | None = 42, remainder: bool = True) -> DataFrame:
    """As ``quota``, and what short strata lack is filled from the rows left over, in key order of the shuffle.

    Without a seed the order is that of the key itself; without ``remainder`` every stratum has the same quota."""
    order = [shuffle_key(F.col(key), seed), F.col(key)] if seed is not None else [F.col(key)]
    # A stratum's quota is n at most, and n rows at most fill up for others.
    ranked = _leading(df, stratum, key, order, 2 * n).join(_quotas(df, stratum, n, remainder), stratum)
    first = ranked.where("_rank <= _quota").drop("_rank", "_quota")
    spare = ranked.where("_rank > _quota").drop("_quota", "_rank").orderBy(*order).limit(n).withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # n rows at most
    taken = first.agg(F.count(F.lit(1)).alias("_taken"))
    return first.unionByName(spare.crossJoin(F.broadcast(taken)).where(F.col("_place") <= n - F.col("_taken")).drop("_place", "_taken"))  # one row


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in shuffled order, all if there are fewer."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def at_most(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at most of each stratum."""
    return _leading(df, stratum, key, [shuffle_key(F.col(key), seed), F.col(key)], n).drop("_rank")
