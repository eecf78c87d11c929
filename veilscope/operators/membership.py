"""Membership-inference statistics: tie-aware AUC, Welch's t, summaries and histograms.

Scores are counted by value before they are ranked, and ranked within ranges of them, so no window holds all scores of a
group even where every row has its own.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import exact_mean
from .ranges import ranged

LEAST = 10


def _mean(c: Column) -> Column:
    return exact_mean(c, 5)


def finite(c: Column) -> Column:
    """The number, or null for null, NaN and infinities."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def auc(df: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties counting half; null with one class only."""
    counted = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    before = lambda order, *group: F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged(counted, score, *keys).withColumn("_won", F.col("_p") * (before(score, *keys, "_range") + F.col("_n") / 2))
    parts = won.groupBy(*keys, "_range").agg(F.sum("_won").alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    total = parts.withColumn("_won", F.col("_won") + F.col("_p") * before("_range", *keys)).groupBy(*keys).agg(F.sum("_won").alias("_won"), F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    return total.select(*keys, F.when((F.col("_ps") > 0) & (F.col("_ns") > 0), F.col("_won") / (F.col("_ps") * F.col("_ns"))).alias("auc"))


def welch(df: DataFrame, value: str, first: Column, *keys: str) -> DataFrame:
    """Welch's t and its degrees of freedom for two classes; null without variance."""
    side = lambda f, mine, name: f(F.when(mine, F.col(value))).alias(name)
    parts = df.groupBy(*keys).agg(*(side(f, mine, f"{n}{i}") for i, mine in ((1, first), (2, ~first)) for f, n in ((F.avg, "_m"), (F.var_samp, "_v"), (F.count, "_n"))))
    a, b = F.try_divide("_v1", "_n1"), F.try_divide("_v2", "_n2")
    spread = F.when(a + b > 0, a + b)
    return parts.select(*keys, ((F.col("_m1") - F.col("_m2")) / F.sqrt(spread)).alias("t_stat"), F.try_divide(spread * spread, a * a / (F.col("_n1") - 1) + b * b / (F.col("_n2") - 1)).alias("df"))


def two_sided_p(t: float | None, df: float | None) -> float | None:
    """Student's two-sided p, by the continued fraction of the incomplete beta function."""
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return None
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + step * d) or tiny)
                c = (1 + step / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-13:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def with_p(df: DataFrame, t: str = "t_stat", freedom: str = "df") -> DataFrame:
    """``p_value`` beside t and its degrees of freedom; the table has one row for each group."""
    @F.pandas_udf(T.DoubleType())
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(ts, dfs, strict=True)], dtype="float64")

    return df.withColumn("p_value", p(t, freedom))


def summary(df: DataFrame, *keys: str, seen: str = "split = 'seen'") -> DataFrame:
    """Means, sample deviations and counts by class over rows whose confidence and loss are finite, and both AUCs (the
    loss counts reversed). Where fewer than LEAST rows are finite, the AUCs are 0.5 and means and deviations 0."""
    rows = df.withColumn("confidence", finite(F.col("confidence"))).withColumn("loss", finite(F.col("loss"))).where("confidence IS NOT NULL AND loss IS NOT NULL")
    mine = F.expr(seen)
    side = lambda f, cond, c, name: f(F.when(cond, F.col(c))).alias(name)
    stats = rows.groupBy(*keys).agg(
        side(_mean, mine, "confidence", "mean_seen_conf"), side(F.stddev_samp, mine, "confidence", "std_seen_conf"), side(_mean, ~mine, "confidence", "mean_unseen_conf"), side(F.stddev_samp, ~mine, "confidence", "std_unseen_conf"),
        side(_mean, mine, "loss", "mean_seen_loss"), side(_mean, ~mine, "loss", "mean_unseen_loss"), F.count_if(mine).alias("n_seen"), F.count_if(~mine).alias("n_unseen"),
    )
    enough = F.col("n_seen") + F.col("n_unseen") >= LEAST
    by_loss = auc(rows.withColumn("loss", -F.col("loss")), "loss", mine, *keys).withColumnRenamed("auc", "auc_loss")
    joined = stats.join(auc(rows, "confidence", mine, *keys).withColumnRenamed("auc", "auc_confidence"), list(keys)).join(by_loss, list(keys))
    defaults = {c: 0.5 if c.startswith("auc") else 0.0 for c in joined.columns if c not in (*keys, "n_seen", "n_unseen")}
    return joined.withColumns({c: F.when(enough, F.col(c)).otherwise(default) for c, default in defaults.items()})


def histogram(df: DataFrame, value: str, *keys: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from each group's least to its greatest value; the last bin is closed on both sides."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(value).isNotNull()).join(limits, list(keys)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
