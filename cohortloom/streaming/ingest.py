"""New samples as a stream: profiles arrive as Parquet files and are summed into the cohort.

Evidence is a commutative sum, so the state of a signature is its running total; each micro-batch
is pre-aggregated before it meets the state. A batch that is retried (same batch id) is applied
once, as its output is written under its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_profiles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of per-sample profiles that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def append_batches(stream: DataFrame, out: str, checkpoint: str):
    """Write each micro-batch's sums per signature and sample under out/batch=N; returns the query."""

    def write(batch: DataFrame, n: int) -> None:
        one = batch.groupBy("pid", "sample_id").agg(F.first("chrom").alias("chrom"), F.first("sj").alias("sj"), F.sum("evidence").alias("evidence"))
        one.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cohort_profile(spark: SparkSession, out: str) -> DataFrame:
    """The profile of all batches so far."""
    df = spark.read.parquet(out)
    return df.groupBy("pid", "sample_id").agg(F.first("chrom").alias("chrom"), F.first("sj").alias("sj"), F.sum("evidence").alias("evidence"))
