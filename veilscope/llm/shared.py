"""Helpers that the operators of this subpackage share: the shared folder and batched Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shipping

#: Characters that count as white space in every contract of this subpackage (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: A file has fewer rows than two to the power of this.
FILE_ROWS_BITS = 40
#: Blocks of a folder of ``BlockFiles``, two to the power of this, and bytes of a row group of its files.
FOLDER_BITS = 6
ROW_GROUP = 256 * 1024


#: Rows that Spark hands to a Python worker at once; its own default holds tens of megabytes of texts, in both processes.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, and let them get ``ARROW_ROWS`` rows at once unless the session says otherwise."""
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder takes its place on a local master and nowhere else."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        done = sc._jsc.sc().getCheckpointDir()
        if done.isDefined():
            return done.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilscope-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage, also that of estimates.

    ``checkpoint()`` keeps the estimated size of the plan behind it, and a join's estimate is the product of both sides;
    so a loop that joins its own results squares the estimate in every round, until the planner multiplies numbers of
    millions of digits. A table that was written has the size of its files."""
    return stored(df, "step")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a column of row numbers that every scan repeats, however it is split: the file's number in the order
    of paths, then the place in the file. A ``df`` that is not a scan of files is stored first."""
    try:
        place = df.select(df.metadataColumn("_metadata").getField("file_path").alias("path"), df.metadataColumn("_metadata").getField("row_index")).select("path")
    except AnalysisException:
        return numbered(stored(df, "table"), name)
    files = sorted(r["path"] for r in place.distinct().collect())  # names of files, which the driver lists anyway
    at, path, number = (free_name(df, x) for x in ("_row_index", "_file_path", "_file_number"))
    known = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(files)], f"{path} string, {number} long")
    meta = df.metadataColumn("_metadata")
    joined = df.select("*", meta.getField("row_index").alias(at), meta.getField("file_path").alias(path)).join(F.broadcast(known), path)
    return joined.select(*map(by_name, df.columns), F.expr(f"shiftleft({number}, {FILE_ROWS_BITS}) | {at}").alias(name))


def by_name(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, rows: int = 512) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows, given and returned as lists by column name.

    Slices keep a worker's memory low when single rows are very long."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


class BlockFiles:
    """A table with a ``block`` column, written so that a task can read the rows of one block."""

    def __init__(self, df: DataFrame, name: str):
        self.path = fresh_path(df.sparkSession, name)
        self.names = [c for c in df.columns if c != "block"]
        dealt = df.withColumn("folder", F.expr(f"shiftright(block, {FOLDER_BITS})")).repartition("folder", "block").sortWithinPartitions("folder", "block", self.names[0])
        dealt.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("folder").parquet(self.path)

    def read(self, block: int) -> list[np.ndarray]:
        """The columns of a block's rows, in the order of the first."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/folder={block >> FOLDER_BITS}"
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return [np.zeros(0, np.int64) for _ in self.names]
        table = ds.dataset(folder, filesystem=files, format="parquet").to_table(columns=self.names, filter=ds.field("block") == block)
        columns = [table[c].to_numpy() for c in self.names]
        by = np.argsort(columns[0], kind="stable")
        return [c[by] for c in columns]
