"""Where models plug in: predictors over records, and a second labeller for what no rule decides."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed, rules


class Predictor(Protocol):
    """Answers a batch of records; made once in each task."""

    def predict(self, records: list[dict]) -> list[str]: ...


def with_retries(call: Callable[[], object], attempts: int = 5, longest: float = 20.0, pause: Callable[[float], None] = time.sleep) -> object:
    """Call again after 1, 2, 4 ... seconds, ``longest`` at most; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            pause(min(2.0**attempt, longest))
    raise AssertionError


def predict(df: DataFrame, make: Callable[[], Predictor], column: str = "prediction", batch: int = 64) -> DataFrame:
    """``df`` with the predictor's answers."""
    names, schema = df.columns, StructType([*df.schema.fields, StructField(column, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.predict(part.to_pylist()), pa.string())], names=[*names, column])

    return df.mapInArrow(run, schema)


def label(df: DataFrame, make: Callable[[], Predictor] | None = None, question: str = "question", answer: str = "answer") -> DataFrame:
    """Type each row by rule; rows that no rule decides surely go to the model, or stay ``pending`` without one."""
    ruled = df.withColumn("_rule", rules.label(F.col(question), F.col(answer)))
    sure = ruled.where(F.col("_rule.rule_confidence") >= fixed.ACCEPT_CONFIDENCE).select(*df.columns, "_rule.*", F.lit("rule").alias("label_source"))
    rest = ruled.where(F.col("_rule.rule_confidence") < fixed.ACCEPT_CONFIDENCE)
    if make is None:
        return sure.unionByName(rest.select(*df.columns, F.lit(None).cast("string").alias("field_type"), "_rule.rule_reason", "_rule.rule_confidence", F.lit("pending").alias("label_source")))
    from ..functions.text import normalize_label

    asked = predict(rest, make, "_answer")
    return sure.unionByName(asked.select(*df.columns, normalize_label(F.col("_answer")).alias("field_type"), "_rule.rule_reason", "_rule.rule_confidence", F.lit("llm").alias("label_source")))
