"""Readers and writers of the engine's tables, always with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; a temporary one on a local master where none is named."""
    sc = spark.sparkContext
    done = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or (done.get() if done.isDefined() else None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilscope-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are dropped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=False, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> str:
    """With a header; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else F.col(c) for c in df.columns]
    df.select(*flat).write.csv(path, header=True, quote='"', escape='"')
    return path


def read_scenarios(spark: SparkSession, path: str | None) -> DataFrame:
    """Scenarios from a JSON array; the whole grid without a path."""
    from ..operators.scenarios import GRID, grid

    return grid(spark) if path is None else spark.read.schema(GRID).option("multiLine", True).json(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A Parquet or CSV table, or an empty one with its schema if there is none."""
    try:
        return read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists, on any file system that Spark reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def align(df: DataFrame, schema: T.StructType, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns of ``schema`` by name or by the first alias that is there; null where there is none."""
    def find(field: T.StructField):
        for name in (field.name, *(aliases or {}).get(field.name, ())):
            if name in df.columns:
                return F.col(name).cast(field.dataType).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    return df.select(*map(find, schema))


def append_results(df: DataFrame, path: str) -> None:
    """Add a batch of results; a batch is there as a whole or not at all."""
    df.write.mode("append").parquet(path)


def newest_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder below ``root`` that was changed last (ties: the last by name), on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    folders = [(x.getModificationTime(), x.getPath().toString()) for x in store.listStatus(at) if x.isDirectory()]
    return max(folders)[1] if folders else None


def read_shards(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All shards of a snapshot, as one table."""
    return spark.read.option("pathGlobFilter", pattern).parquet(folder)


def write_summary(summary: DataFrame, path: str) -> str:
    """A summary of one row as a JSON object in one file below ``path``."""
    summary.coalesce(1).write.json(path)  # one row
    return path
