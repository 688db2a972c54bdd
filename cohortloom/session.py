"""Session-level helpers that every operator may rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is shown to have at most this many rows and this many bytes of text.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 8 << 20

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors must reach.

    It is the one in spark.checkpoint.dir, or else the context's checkpoint folder. Only on one
    machine, where neither is set, a temporary folder is made; it is deleted at the end.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="cohortloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/cohortloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    What is read back survives the loss of executors, has its columns pruned, and has a size that
    the planner knows, so that joins with it are broadcast only where it is small.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows rows and max_bytes bytes, else leave the join to the planner.

    All columns are measured, as JSON; the scan stops after max_rows + 1 rows, so the test costs
    little on a large table.
    """
    size = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else df


def parallelism(spark: SparkSession) -> int:
    """Number of partitions for a stage whose tasks are meant to be of equal size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def from_nth(array: Column | str, n: int) -> Column:
    """All elements from the n-th on (from 1); empty if there are fewer."""
    a = F.col(array) if isinstance(array, str) else array
    return F.slice(a, n, F.greatest(F.size(a), F.lit(1)))
