"""Isoforms that hold a splice junction.

Defined cases. Positions of a query are put in order; queries with a null are left out. A record
matches by its first junction with both ends strictly nearer than flank, so flank 0 finds nothing.
Queries that nothing matches have no rows. Repeated queries are looked up once per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import clamped_diff, cpm, junction_text
from ..session import bounded_broadcast
from .match import at_least
from .rangejoin import flank_join


def ordered_queries(q: DataFrame) -> DataFrame:
    """id, chrom, left, right with left <= right."""
    df = q.filter(F.col("chrom").isNotNull() & F.col("left").isNotNull() & F.col("right").isNotNull())
    return df.select("id", "chrom", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def first_junction(sj: Column, left: Column, right: Column, flank: int) -> Column:
    """Number (from 1) of the first junction with both ends strictly within flank; null if there is none."""
    at = F.filter(F.transform(sj, lambda j, i: F.when((F.abs(j["d"] - left) < flank) & (F.abs(j["a"] - right) < flank), i + 1)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def splice_report(q: DataFrame, pnir: DataFrame, site: DataFrame, shapes: DataFrame, totals: DataFrame, flank: int = 10) -> DataFrame:
    """One row per query and record: evidence, cpm, matched junction, distances, exons, ends, junctions."""
    q = ordered_queries(q)
    probes = q.select("id", "chrom", F.explode(F.array("left", "right")).alias("q_pos"))
    hits = flank_join(probes, site.filter("kind = 'sj'"), "q_pos", "pos", flank).select("id", "q_pos", "pid")
    need = q.select("id", F.when(F.col("left") == F.col("right"), 1).otherwise(2).alias("n_q"))
    hits = hits.join(need, "id")
    both = at_least(hits, "id", 0, F.col("n_q")).select("id", "pid")
    df = both.join(q, "id").join(pnir.select("pid", "sj", "total_evidence", "is_mono"), "pid")
    df = df.withColumn("sj_no", first_junction(F.col("sj"), F.col("left"), F.col("right"), flank)).filter("sj_no is not null")
    hit = F.get("sj", F.col("sj_no") - 1)
    ends = shapes.join(both.select("pid").distinct(), "pid", "left_semi").groupBy("pid").agg(F.min("left").alias("start_min"), F.max("left").alias("start_max"), F.min("right").alias("end_min"), F.max("right").alias("end_max"))
    grand = F.lit(totals.agg(F.sum("total_evidence").alias("n")).first()["n"] or 0)
    df = df.join(ends, "pid")
    exons = F.when(F.size("sj") > 1, F.size("sj") + 1).when(F.col("is_mono"), 1).otherwise(2)
    return df.select(
        "id", "chrom", "left", "right", "pid", F.col("total_evidence").alias("evidence"), cpm(F.col("total_evidence"), grand).alias("cpm"), "sj_no",
        clamped_diff(hit["d"], F.col("left")).alias("left_dist"), clamped_diff(hit["a"], F.col("right")).alias("right_dist"), exons.alias("n_exons"),
        "start_min", "start_max", "end_min", "end_max", junction_text(F.col("sj")).alias("junctions"),
    )


def splice_cells(report: DataFrame, shapes: DataFrame, profile: DataFrame, totals: DataFrame) -> DataFrame:
    """Per query, record and sample: count, cpm and the text left|right|strand of its reads, each shape as often as it occurs."""
    reads = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("left", "right", "strand", "n"))), lambda x: F.array_repeat(F.concat_ws("|", x["left"], x["right"], x["strand"]), x["n"].cast("int")))), ",")
    hit = report.select("id", "pid")
    text = shapes.join(hit.select("pid").distinct(), "pid", "left_semi").groupBy("pid", "sample_id").agg(reads.alias("reads"))
    df = hit.join(profile.select("pid", "sample_id", "evidence"), "pid").join(text, ["pid", "sample_id"]).join(bounded_broadcast(totals), "sample_id")
    return df.select("id", "pid", "sample_id", "evidence", cpm(F.col("evidence"), F.col("total_evidence")).alias("cpm"), "reads")
