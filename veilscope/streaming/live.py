"""The engine's transforms over streams: hourly metrics with a watermark, and repetitions dropped by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import exact_mean
from ..sources.manifests import scratch


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder, with its schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def timed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Event times as instants, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and return its result; ``append`` goes to a table, ``complete`` to memory,
    as it keeps one row for each group."""
    spark = stream.sparkSession
    checkpoint = scratch(spark, "stream-state")
    if mode == "append":
        out = scratch(spark, "stream-out")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def hourly_metrics(spark: SparkSession, path: str) -> DataFrame:
    rows = timed(source(spark, path)).withWatermark("ts", "2 hours")
    counted = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), exact_mean("value").alias("value"))
    return to_end(counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "value"), "complete")


def first_of_each(spark: SparkSession, path: str) -> DataFrame:
    """Rows that come again within the watermark are dropped by their key."""
    rows = timed(source(spark, path))
    return to_end(rows.unionByName(rows).withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append")
