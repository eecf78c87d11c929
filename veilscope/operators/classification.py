"""Evaluation of a classifier against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_gold(gold: DataFrame, predicted: DataFrame, keys: list[str], unmatched: str | None = None, order: str = "predicted") -> DataFrame:
    """Every gold row with its prediction by the first key that finds one; unmatched rows have the prediction
    ``unmatched``, null by default. Of several predictions of a key the last by ``order`` counts."""
    out = gold
    for i, key in enumerate(keys):
        one = predicted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.max(F.struct(F.col(order).alias("order"), "predicted"))["predicted"].alias(f"_p{i}"))
        out = out.join(one, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out.withColumn("predicted", F.coalesce(*(F.col(f"_p{i}") for i in range(len(keys))), F.lit(unmatched))).drop(*(f"_p{i}" for i in range(len(keys))))


def report(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each label, and their plain and weighted means; 0 where undefined.

    One pass counts (gold, predicted); everything else works on these counts."""
    counts = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named")))).alias("x"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    labels = sides.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.named").alias("named"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = labels.select("label", ratio(F.col("hit"), F.col("named")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), "support")
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    plain = rows.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in scores), F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores), F.sum("support").alias("support"))
    columns = ["label", *scores, "support"]
    return rows.select(columns).unionByName(plain.select(columns)).unionByName(weighted.select(columns))


def crosstab(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts by both labels with margins ``All``, in one pass."""
    cube = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).cube(gold, predicted).agg(F.grouping(gold).alias("_g"), F.grouping(predicted).alias("_p"), F.count(F.lit(1)).alias("n"))
    name = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c))
    return cube.select(name(gold, "_g").alias(gold), name(predicted, "_p").alias(predicted), "n")
