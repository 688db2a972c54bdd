"""From reads to profiles, the cohort table and its site postings.

Defined cases. Reads without exons have no signature and are dropped. Repeated reads are a bag:
each counts. Exons may come in any order; null exons are skipped. Empty tables give empty results.
Group keys are short hashes next to the exact columns, so a junction chain of any length shuffles
in little space; where a key holds much of the data, counts are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom, junction_sites, junction_text, junctions_of


def keep_alignment(flag: Column, mapq: Column, least_mapq: int = 5, use_secondary: bool = False) -> Column:
    """Mapped, primary unless asked otherwise, and of enough quality; supplementary alignments are kept."""
    ok = (flag.bitwiseAND(4) == 0) & (mapq >= least_mapq)
    return ok if use_secondary else ok & (flag.bitwiseAND(256) == 0)


def cigar_exons(start: Column, cigar: Column) -> Column:
    """Exons [s, e) of an alignment that starts at 0-based `start`: M, D, = and X extend, N closes, others are passed over."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.expr("1").alias("_"), F.regexp_extract(x, r"[0-9]+", 0).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))
    first = F.struct(start.cast("bigint").alias("s"), start.cast("bigint").alias("e"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"))

    def step(acc, x):
        closed = F.when(acc["e"] > acc["s"], F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["done"])
        skip = x["op"] == "N"
        grow = x["op"].isin("M", "D", "=", "X")
        return F.struct(
            F.when(skip, acc["e"] + x["n"]).otherwise(acc["s"]).alias("s"),
            F.when(skip | grow, acc["e"] + x["n"]).otherwise(acc["e"]).alias("e"),
            F.when(skip, closed).otherwise(acc["done"]).alias("done"),
        )

    end = lambda acc: F.when(acc["e"] > acc["s"], F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["done"])
    return F.aggregate(ops, first, step, end)


def sa_segments(sa: Column) -> Column:
    """Supplementary segments of an SA tag: chrom, s, e, strand; null and empty tags give an empty array."""
    entries = F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda x: x != "")

    def one(x):
        f = F.split(x, ",")
        return F.transform(cigar_exons(f[1].cast("bigint") - 1, f[3]), lambda e: F.struct(bare_chrom(f[0]).alias("chrom"), e["s"].alias("s"), e["e"].alias("e"), f[2].alias("strand")))

    return F.flatten(F.transform(entries, one))


def junctions(exons: Column) -> Column:
    """Junctions (end of an exon, start of the next) of sorted exons; a single exon stands for itself."""
    n = F.size(exons)
    pairs = F.transform(F.slice(exons, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.struct(x["e"].alias("d"), F.get(exons, i + 1)["s"].alias("a")))
    return F.when(n == 1, F.transform(exons, lambda x: F.struct(x["s"].alias("d"), x["e"].alias("a")))).otherwise(pairs)


def sorted_segments(segments: Column) -> Column:
    """Segments with primary ones first, then by chromosome, start and end."""
    return F.array_sort(F.transform(segments, lambda x: F.struct(x["is_supp"].alias("is_supp"), x["chrom"].alias("chrom"), x["s"].alias("s"), x["e"].alias("e"), x["strand"].alias("strand"))))


def weight(df: DataFrame) -> Column:
    """Reads that a row stands for: its n, or 1."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def with_signature(reads: DataFrame) -> DataFrame:
    """Reads with sj, junctions (its text), left, right and pid, the md5 of chrom:d-a|d-a; the strand plays no part."""
    df = reads.withColumn("exons", F.array_sort(F.filter("exons", lambda x: x.isNotNull() & x["s"].isNotNull() & x["e"].isNotNull()))).filter(F.size("exons") > 0)
    df = df.withColumn("sj", junctions(F.col("exons"))).withColumn("junctions", junction_text(F.col("sj")))
    df = df.withColumn("left", F.col("exons")[0]["s"]).withColumn("right", F.element_at("exons", -1)["e"])
    return df.withColumn("pid", signature(F.col("chrom"), F.col("junctions")))


def signature(chrom: Column, junctions: Column) -> Column:
    return F.md5(F.concat_ws(":", chrom, junctions))


def collapse(reads: DataFrame) -> DataFrame:
    """Reads that agree in all that is kept of them as one row with their number n; supp and info are kept where they are given."""
    keep = ["sample_id", "pid", "chrom", "junctions", "left", "right", "strand", *(c for c in ("supp", "info") if c in reads.columns)]
    return reads.groupBy(*keep).agg(F.sum(weight(reads)).cast("bigint").alias("n"))


def profiles(reads: DataFrame) -> DataFrame:
    """Per sample and signature: sample_id, pid, chrom, sj, evidence."""
    df = reads.groupBy("sample_id", "pid", "chrom", "junctions").agg(F.sum(weight(reads)).cast("bigint").alias("evidence"))
    return df.select("sample_id", "pid", "chrom", junctions_of(F.col("junctions")).alias("sj"), "evidence")


def read_shapes(reads: DataFrame) -> DataFrame:
    """Reads of a signature and sample that share ends and strand: pid, sample_id, left, right, strand, n."""
    return reads.groupBy("pid", "sample_id", "left", "right", "strand").agg(F.sum(weight(reads)).cast("bigint").alias("n"))


def cohort(profile: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per signature: pid, chrom, sj, n_sites, total_evidence, n_samples, is_mono.

    is_mono: exactly one junction, and the ends of every read are this junction.
    """
    merged = profile.groupBy("pid").agg(F.first("chrom").alias("chrom"), F.first("sj").alias("sj"), F.sum("evidence").alias("total_evidence"), F.countDistinct("sample_id").alias("n_samples"))
    ends = shapes.groupBy("pid").agg(F.min("left").alias("l0"), F.max("left").alias("l1"), F.min("right").alias("r0"), F.max("right").alias("r1"))
    df = merged.join(ends, "pid")
    one = (F.size("sj") == 1) & (F.col("l0") == F.col("sj")[0]["d"]) & (F.col("l1") == F.col("l0")) & (F.col("r0") == F.col("sj")[0]["a"]) & (F.col("r1") == F.col("r0"))
    return df.select("pid", "chrom", "sj", (F.size("sj") * 2).alias("n_sites"), "total_evidence", "n_samples", one.alias("is_mono"))


def site_postings(pnir: DataFrame, shapes: DataFrame) -> DataFrame:
    """Postings chrom, pos, pid, n_sites, kind: 'sj' for splice sites, 'term' (n_sites 0) for read ends; each once."""
    sj = pnir.select("chrom", F.explode(junction_sites(F.col("sj"))).alias("pos"), "pid", "n_sites", F.lit("sj").alias("kind"))
    ends = shapes.select("pid", F.explode(F.array("left", "right")).alias("pos")).distinct()
    term = ends.join(pnir.select("pid", "chrom"), "pid").select("chrom", "pos", "pid", F.lit(0).alias("n_sites"), F.lit("term").alias("kind"))
    return sj.unionByName(term)


def sample_totals(profile: DataFrame) -> DataFrame:
    """Reads of each sample: sample_id, total_evidence."""
    return profile.groupBy("sample_id").agg(F.sum("evidence").alias("total_evidence"))


def merge_replicates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Profiles of replicates in one, without the sample: pid, chrom, sj, evidence."""
    both = a.select("pid", "chrom", "sj", "evidence").unionByName(b.select("pid", "chrom", "sj", "evidence"))
    return both.groupBy("pid").agg(F.first("chrom").alias("chrom"), F.first("sj").alias("sj"), F.sum("evidence").alias("evidence"))
