"""The dimension of redaction scenarios, the parser of scenario names, the taxonomy join, and positional indices."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .ranges import ranged

GRID = "scenario_id string, ocr_strategy string, image_strategy string, context_window int, blur_sigma double"


def grid(spark: SparkSession) -> DataFrame:
    """All scenarios: the original, and every redaction of words or picture with every context."""
    rows = [("original", "none", "none", 0, None)]
    for k, ocr, (image, blur) in product(fixed.CONTEXT_WINDOWS, fixed.OCR_STRATEGIES, fixed.IMAGE_VARIANTS):
        if (ocr, image) != ("none", "none"):
            rows.append((f"ocr_{ocr}__img_{image}{f'_{blur:g}' if blur else ''}__k_{k}", ocr, image, k, blur))
    return spark.createDataFrame(rows, GRID)


def sigma(scenario: Column) -> Column:
    """The blur's strength in a scenario's name."""
    return F.regexp_extract(scenario, r"blur_(\d+)", 1).try_cast("int")


def parse(name: Column) -> Column:
    """(image_id, ocr_id, context_window, error) of a name: a known id, ids joined by ``+`` (the last of a kind counts),
    or the long form."""
    n = F.regexp_replace(name, r"\s+", "")
    parts = F.filter(F.split(n, r"\+"), lambda p: p != "")
    last = lambda ids: F.coalesce(F.try_element_at(F.filter(parts, lambda p: p.isin(*ids)), F.lit(-1)), F.lit("original"))
    known = F.forall(parts, lambda p: p.isin(*fixed.IMAGE_IDS, *fixed.OCR_IDS)) & (F.size(parts) > 0)
    window = lambda c: F.coalesce(F.regexp_extract(c, r"_k_?(\d+)$", 1).try_cast("int"), F.lit(0))
    long = r"^ocr_(none|drop|mask)__img_(none|black|white|blur(?:_\d+)?)__k_(\d+)$"
    ocr, image = F.regexp_extract(n, long, 1), F.regexp_extract(n, long, 2)
    row = lambda i, o, k, e: F.struct(i.alias("image_id"), o.alias("ocr_id"), k.alias("context_window"), F.lit(e).cast("string").alias("error"))
    by_parts = row(last(fixed.IMAGE_IDS), last(fixed.OCR_IDS), window(last(fixed.OCR_IDS)), None)
    by_long = row(F.when(image == "none", "original").otherwise(F.concat(F.lit("img_"), image)), F.when(ocr == "none", "ocr_none").otherwise(F.concat(F.lit("ocr_"), ocr, F.lit("_k"), F.regexp_extract(n, long, 3))), window(n), None)
    none = F.lit(None).cast("string")
    return F.when(known, by_parts).when(n.rlike(long), by_long).otherwise(row(none, none, F.lit(None).cast("int"), "unsupported"))


def with_taxonomy(df: DataFrame, kind: str = "field_type") -> DataFrame:
    """Coarse type (null outside the benchmark), sensitivity and group of each row's type."""
    rows = [(k, *v) for k, v in fixed.TAXONOMY.items()]
    dimension = df.sparkSession.createDataFrame(rows, f"{kind} string, coarse string, sensitivity string, field_group string")
    out = df.join(F.broadcast(dimension), kind, "left")  # the taxonomy, seventeen rows
    return out.withColumn("sensitivity", F.coalesce("sensitivity", F.lit(fixed.DEFAULT_SENSITIVITY))).withColumn("field_group", F.coalesce("field_group", F.lit(fixed.DEFAULT_GROUP)))


def row_index(df: DataFrame, order: str) -> DataFrame:
    """Positions from 0 in the order of a column of numbers, without one window over all rows: positions within ranges
    of the column, plus the sizes of the ranges before."""
    cut = ranged(df, order)
    before = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1)
    return ranked.join(F.broadcast(before), "_range").withColumn("row_index", F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_n", "_before")  # a row for each range
