"""Overlapping and gapped intervals: a sweep line in chunks of bounded size.

Every span gives a plus event at its start and a minus event at its end. Events are summed per
(entity, position) before the shuffle, so a coordinate bin of BIN positions holds at most BIN rows
of an entity however many spans fall into it: one entity may hold most of the data without any
task growing with it. The prefix sum runs within bins, with the net counts of earlier bins carried
in; the bins of an entity (its length / BIN rows) are the only rows that are ever put in one order.

Defined cases. A span with a null start or end, or with end <= start, is none. Rows with a null or
empty entity column are left out, unless the column may be empty. Spans that touch are continuous. Repeated rows change nothing.
Empty input gives an empty result. The result has the entity columns, kind, start_pos and end_pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import bare_chrom
from ..session import durable

#: Width of a coordinate bin; the largest number of rows that a bin of an entity can hold.
BIN = 1 << 17


def boundary_events(spans: DataFrame, entity: list[str], start: str, end: str, may_be_empty: tuple[str, ...] = ()) -> DataFrame:
    """Net change of the number of active spans per entity and position; positions without a change are dropped."""
    s, e = F.col(start), F.col(end)
    keep = s.isNotNull() & e.isNotNull() & (e > s)
    for c in entity:
        keep = keep & F.col(c).isNotNull()
        if c not in may_be_empty:
            keep = keep & (F.col(c).cast("string") != "")
    both = F.array(F.struct(s.cast("bigint").alias("pos"), F.lit(1).alias("d")), F.struct(e.cast("bigint").alias("pos"), F.lit(-1).alias("d")))
    df = spans.filter(keep).select(*entity, F.explode(both).alias("ev")).select(*entity, F.col("ev.pos").alias("pos"), F.col("ev.d").alias("d"))
    return df.groupBy(*entity, F.floor(F.col("pos") / BIN).alias("bin"), "pos").agg(F.sum("d").alias("d")).filter("d <> 0")


def active_counts(events: DataFrame, entity: list[str]) -> DataFrame:
    """Events with the number of active spans after (`active`) and before (`before`) each position."""
    net = events.groupBy(*entity, "bin").agg(F.sum("d").alias("net"))
    earlier = Window.partitionBy(*entity).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = net.select(*entity, "bin", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("carry"))
    within = Window.partitionBy(*entity, "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = events.join(carry, [*entity, "bin"]).withColumn("active", F.col("carry") + F.sum("d").over(within))
    return df.withColumn("before", F.col("active") - F.col("d"))


def periods_and_gaps(spans: DataFrame, entity: list[str], start: str, end: str, may_be_empty: tuple[str, ...] = ()) -> DataFrame:
    """Maximal covered periods, and the gaps between neighbouring periods, of each entity.

    Events and the turns among them are written once each, as both are read twice.
    """
    events = durable(boundary_events(spans, entity, start, end, may_be_empty))
    turns = active_counts(events, entity).filter("active = 0 or before = 0")
    turns = durable(turns.select(*entity, "bin", "pos", (F.col("before") == 0).alias("opens")))
    df = with_next(turns, entity).withColumnRenamed("next_pos", "end_pos")
    return df.select(*entity, F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("pos").alias("start_pos"), "end_pos")


def with_next(points: DataFrame, entity: list[str]) -> DataFrame:
    """Distinct points (entity, bin, pos) with next_pos, the entity's next one; the last point is left out.

    The next point is found within the bin; for the last of a bin it is the first of the entity's
    next bin. The points should be written, as they are read twice.
    """
    within = Window.partitionBy(*entity, "bin").orderBy("pos")
    first = points.groupBy(*entity, "bin").agg(F.min("pos").alias("first_pos"))
    following = Window.partitionBy(*entity).orderBy("bin")
    after = first.select(*entity, "bin", F.lead("first_pos").over(following).alias("after_bin"))
    df = points.withColumn("next_pos", F.lead("pos").over(within)).join(after, [*entity, "bin"])
    return df.withColumn("next_pos", F.coalesce("next_pos", "after_bin")).drop("after_bin", "bin").filter(F.col("next_pos").isNotNull())


def gene_spans(gene: DataFrame) -> DataFrame:
    """chrom, s, e of genes with a chromosome."""
    return gene.select(bare_chrom("chrom").alias("chrom"), F.col("gene_start").alias("s"), F.col("gene_end").alias("e")).filter("chrom <> ''")


def exon_spans(transcript: DataFrame) -> DataFrame:
    """gene_id, chrom, s, e of the exons of transcripts with both."""
    exons = transcript.select("gene_id", bare_chrom("chrom").alias("chrom"), F.explode("exons").alias("x")).filter("chrom <> '' and gene_id <> ''")
    return exons.select("gene_id", "chrom", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def all_periods(gene: DataFrame, transcript: DataFrame, longest_gap: int = 1_000_000) -> DataFrame:
    """Both grains in one sweep: grain, chrom, gene_id, kind, start_pos, end_pos.

    Grain chrom: periods and gaps of a chromosome's genes, without gaps longer than longest_gap.
    Grain gene: those of the exons of each gene and chromosome.
    """
    a = gene_spans(gene).select(F.lit("chrom").alias("grain"), "chrom", F.lit("").alias("gene_id"), "s", "e")
    b = exon_spans(transcript).select(F.lit("gene").alias("grain"), "chrom", "gene_id", "s", "e")
    df = periods_and_gaps(a.unionByName(b), ["grain", "chrom", "gene_id"], "s", "e", ("gene_id",))
    return df.filter((F.col("grain") == "gene") | (F.col("kind") == "period") | (F.col("end_pos") - F.col("start_pos") <= longest_gap))
