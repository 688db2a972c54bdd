"""The index of a cohort: Parquet tables in one folder, written once and read by every query.

sample    one row a sample: sample_id, name, path, attrs, total_evidence
profile   evidence per signature and sample
reads     reads that agree in all that is kept of them, with their number
pnir      one row per signature, by chromosome, in the order of the first site
site      postings by chromosome and position: a lookup prunes by folder and by the statistics of row groups

Defined cases. Empty tables make an index that answers with nothing. A chromosome that is null is kept.
Writing over an index replaces it. Chromosomes stay text, whatever they look like.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build
from .session import durable

SCHEMAS = {
    "sample": "sample_id bigint, name string, path string, attrs map<string,string>, total_evidence bigint",
    "profile": "sample_id bigint, pid string, chrom string, sj array<struct<d:bigint,a:bigint>>, evidence bigint",
    "reads": "sample_id bigint, pid string, junctions string, left bigint, right bigint, strand string, supp array<struct<chrom:string,s:bigint,e:bigint,strand:string>>, info array<struct<k:string,v:string>>, n bigint, chrom string",
    "pnir": "pid string, sj array<struct<d:bigint,a:bigint>>, n_sites int, total_evidence bigint, n_samples bigint, is_mono boolean, chrom string",
    "site": "pos bigint, pid string, n_sites int, kind string, chrom string",
}


@dataclass
class Index:
    """The tables of an index folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    sample = cached_property(lambda self: self.table("sample"))
    profile = cached_property(lambda self: self.table("profile"))
    reads = cached_property(lambda self: self.table("reads"))
    pnir = cached_property(lambda self: self.table("pnir"))
    site = cached_property(lambda self: self.table("site"))
    shapes = cached_property(lambda self: build.read_shapes(self.reads))
    totals = cached_property(lambda self: self.sample.select("sample_id", "total_evidence"))
    n_samples = cached_property(lambda self: self.sample.count())

    def postings(self, chroms: Iterable[str], low: int | None = None, high: int | None = None) -> DataFrame:
        """Postings of some chromosomes, and of positions from low to high if given; only their files and row groups are read."""
        df = self.site.filter(F.col("chrom").isin(list(chroms)))
        df = df if low is None else df.filter(F.col("pos") >= low)
        return df if high is None else df.filter(F.col("pos") <= high)


def _conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns and types of a table; missing ones are empty or null."""
    fields = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields
    have = {c.lower() for c in df.columns}
    empty = lambda t: F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t)
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name.lower() in have else empty(f.dataType.simpleString())).alias(f.name) for f in fields))


def write_index(samples: DataFrame, reads: DataFrame, path: str) -> Index:
    """Writes all tables from samples (sample_id, name, path, attrs) and reads with signatures; returns the index."""
    index = Index(samples.sparkSession, path)

    def save(df: DataFrame, name: str, *order: str, by_chrom: bool = True) -> None:
        df = _conform(df, name)
        if order:
            df = df.repartitionByRange("chrom", *order).sortWithinPartitions("chrom", *order) if by_chrom else df
        out = df.write.mode("overwrite")
        (out.partitionBy("chrom") if by_chrom else out).parquet(f"{path}/{name}")

    save(build.collapse(reads), "reads", "pid")
    save(build.profiles(index.reads), "profile", by_chrom=False)
    pnir = durable(build.cohort(index.profile, index.shapes).withColumn("_first", F.array_min(build.junction_sites(F.col("sj")))))
    save_pnir = _conform(pnir, "pnir").withColumn("_first", F.array_min(build.junction_sites(F.col("sj"))))
    save_pnir.repartitionByRange("chrom", "_first", "pid").sortWithinPartitions("chrom", "_first", "pid").drop("_first").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/pnir")
    save(build.site_postings(index.pnir, index.shapes), "site", "pos", "pid")
    total = build.sample_totals(index.profile)
    save(samples.join(total, "sample_id", "left").fillna(0, ["total_evidence"]), "sample", by_chrom=False)
    return index
