"""The text form of a sample's profile: parsed and written with built-in functions only.

One record a line: signature, evidence, chrom, junctions d-a,d-a and reads left-right:strand:supp:info
joined by |, where supp is chrom%s%e%strand,... and info k=v;k=v. A file opens with a line of
chromosomes and a header line.

Defined cases. Empty supp and info, and a missing info field, give empty arrays. Lines that aren't
records (fewer than five fields, or no number for a signature) are skipped, the two opening lines
with them. Repeated lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom, junction_text, junctions_of
from ..operators.build import signature

HEADER = "signature\tevidence\tchrom\tsplice_junctions\tisoform_diffs"


def _pairs(text: Column, a: str, b: str) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, "-")[0].try_cast("bigint").alias(a), F.split(x, "-")[1].try_cast("bigint").alias(b)))


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """sig, evidence, chrom, sj, reads of each record line; other columns stay."""
    f = F.split(value, "\t", -1)
    # other lines are nulled first, as the planner may put what reads the fields before the filter
    df = lines.withColumn("_f", F.when((F.size(f) >= 5) & F.get(f, F.lit(0)).rlike(r"^[0-9]+$"), f)).filter(F.col("_f").isNotNull())

    def read(x):
        p = F.split(x, ":", -1)
        ends = F.split(p[0], "-")
        supp = F.transform(F.filter(F.split(p[2], ","), lambda s: s != ""), lambda s: F.struct(F.split(s, "%")[0].alias("chrom"), F.split(s, "%")[1].try_cast("bigint").alias("s"), F.split(s, "%")[2].try_cast("bigint").alias("e"), F.split(s, "%")[3].alias("strand")))
        info = F.transform(F.filter(F.split(F.coalesce(F.get(p, F.lit(3)), F.lit("")), ";"), lambda s: s != ""), lambda s: F.struct(F.split(s, "=", 2)[0].alias("k"), F.get(F.split(s, "=", 2), F.lit(1)).alias("v")))
        return F.struct(ends[0].try_cast("bigint").alias("left"), ends[1].try_cast("bigint").alias("right"), p[1].alias("strand"), supp.alias("supp"), info.alias("info"))

    g = lambda i: F.col("_f")[i]
    keep = [c for c in lines.columns if c != value]
    return df.select(*keep, g(0).try_cast("decimal(20,0)").alias("sig"), g(1).try_cast("bigint").alias("evidence"), g(2).alias("chrom"), _pairs(g(3), "d", "a").alias("sj"), F.transform(F.filter(F.split(g(4), r"\|"), lambda x: x != ""), read).alias("reads"))


def read_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse(spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value"))


def format_records(df: DataFrame, *keep: str) -> DataFrame:
    """The record lines (column value) of sig, evidence, chrom, sj, reads, and columns to keep."""
    sj = F.array_join(F.transform("sj", lambda j: F.concat_ws("-", j["d"], j["a"])), ",")
    supp = lambda r: F.array_join(F.transform(r["supp"], lambda s: F.concat_ws("%", s["chrom"], s["s"], s["e"], s["strand"])), ",")
    info = lambda r: F.array_join(F.transform(r["info"], lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    reads = F.array_join(F.transform("reads", lambda r: F.concat_ws(":", F.concat_ws("-", r["left"], r["right"]), r["strand"], supp(r), info(r))), "|")
    return df.select(F.concat_ws("\t", "sig", "evidence", "chrom", sj, reads).alias("value"), *keep)


def records_of(reads: DataFrame) -> DataFrame:
    """sig, evidence, chrom, sj, reads of one sample's reads with signatures; the number in the file is a hash of the signature.

    A record's reads are one line of the file, as its form demands.
    """
    n = F.col("n").cast("int") if "n" in reads.columns else F.lit(1)
    none = F.array().cast("array<struct<k:string,v:string>>")
    info = F.col("info") if "info" in reads.columns else none
    one = F.array_repeat(F.struct("left", "right", "strand", "supp", info.alias("info")), n)
    df = reads.groupBy("chrom", "junctions").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("reads"))
    sig = F.xxhash64("chrom", "junctions").cast("decimal(20,0)")
    sig = F.when(sig < 0, sig + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(sig).cast("decimal(20,0)")
    return df.select(sig.alias("sig"), F.size("reads").cast("bigint").alias("evidence"), "chrom", junctions_of(F.col("junctions")).alias("sj"), "reads")


def reads_of(records: DataFrame) -> DataFrame:
    """The reads of parsed records with their signatures: sample_id, chrom, junctions, pid, left, right, strand, supp, info."""
    df = records.select("sample_id", bare_chrom("chrom").alias("chrom"), junction_text(F.col("sj")).alias("junctions"), F.explode("reads").alias("r"))
    return df.select("sample_id", "chrom", "junctions", signature(F.col("chrom"), F.col("junctions")).alias("pid"), "r.*")


def write_profile(df: DataFrame, path: str) -> None:
    """One sample's profile as gzipped text in signature order: chromosomes, header, records.

    The parts are written in parallel; one after the other they are the file.
    """
    chroms = df.select("chrom").distinct().groupBy().agg(F.array_join(F.array_sort(F.collect_list("chrom")), "\t").alias("value"))
    head = chroms.withColumn("_n", F.lit(-2)).unionByName(df.sparkSession.createDataFrame([(HEADER, -1)], "value string, _n int"))
    body = format_records(df.select("sig", "evidence", "chrom", "sj", "reads"), "sig").withColumn("_n", F.lit(0))
    every = head.withColumn("sig", F.lit(None).cast("decimal(20,0)")).unionByName(body)
    every.repartitionByRange("_n", "sig").sortWithinPartitions("_n", "sig").select("value").write.mode("overwrite").text(path, compression="gzip")
