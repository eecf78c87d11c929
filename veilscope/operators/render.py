"""Pictures of scenarios: expanded spans, their boxes, and masks over these one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, pixels
from ..functions.spans import expand

#: The blur of a scenario that names none (a fixed value).
DEFAULT_SIGMA = 12.0


def rendered(df: DataFrame, strategy: Column, context: Column | int = 0, sigma: Column | None = None, name: str = "rendered") -> DataFrame:
    """``df`` (``picture``, ``width``, ``height``, ``boxes`` of the tokens and ``spans``) with the picture in which the
    spans, with ``context`` more tokens at either side, are masked. Without boxes or a strategy it stays as it was."""
    found = geometry.span_boxes(F.col("boxes"), expand(F.col("spans"), context, F.size("boxes")))
    boxed = df.withColumn("_boxes", found).withColumn("_strategy", strategy).withColumn("_sigma", F.coalesce(sigma, F.lit(DEFAULT_SIGMA)) if sigma is not None else F.lit(DEFAULT_SIGMA))
    return boxed.withColumn(name, pixels.mask(F.col("picture"), F.col("width"), F.col("height"), F.col("_boxes"), F.col("_strategy"), F.col("_sigma"))).drop("_boxes", "_strategy", "_sigma")
