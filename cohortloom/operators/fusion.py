"""Fusions: breakpoint pairs, region pairs and discovery over genes.

A read's supplementary segments are [chrom, s, e, strand]. Records are looked up at both kinds of
posting, each record once per query side.

Defined cases. Null and empty segment lists support nothing. A query side without records gives no
row for the query. Segments on more than one chromosome take no part in discovery. Genes tie by
start, end and id. Reads of repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import exons_of, span_text
from ..session import bounded_broadcast
from .build import weight
from .rangejoin import flank_join, interval_join, range_join


def any_near(supp: Column, chrom: Column, lo: Column, hi: Column) -> Column:
    """Some segment on chrom overlaps [lo, hi]."""
    return F.exists(supp, lambda x: (x["chrom"] == chrom) & (x["s"] <= hi) & (x["e"] >= lo))


def supporting(reads: DataFrame, *columns: str) -> DataFrame:
    """Reads with supplementary segments, those that agree in the columns as one row with their number n.

    A record that holds much of the data is reduced to its distinct segments before it is joined.
    """
    return reads.filter(F.size("supp") > 0).groupBy(*columns).agg(F.sum(weight(reads)).cast("bigint").alias("n"))


def breakpoint_evidence(q: DataFrame, site: DataFrame, reads: DataFrame, flank: int = 10) -> DataFrame:
    """id, sample_id, evidence: reads of records at one breakpoint with a segment at the other, both ways added."""
    sides = q.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"chr{a}").alias("chrom"), F.col(f"pos{a}").alias("q_pos"), F.col(f"chr{b}").alias("m_chrom"), F.col(f"pos{b}").alias("m_pos")) for n, a, b in (("left", 1, 2), ("right", 2, 1))))).alias("s")).select("id", "s.*")
    hits = flank_join(sides, site.select("chrom", "pos", "pid"), "q_pos", "pos", flank).select("id", "side", "m_chrom", "m_pos", "pid").distinct()
    full = hits.groupBy("id").agg(F.countDistinct("side").alias("n")).filter("n = 2").select("id")
    df = hits.join(full, "id", "left_semi").join(supporting(reads, "pid", "sample_id", "supp"), "pid")
    df = df.filter(any_near(F.col("supp"), F.col("m_chrom"), F.col("m_pos") - flank, F.col("m_pos") + flank))
    return df.groupBy("id", "sample_id").agg(F.sum("n").alias("evidence"))


def breakpoint_rows(q: DataFrame, evidence: DataFrame, min_read: int = 1) -> DataFrame:
    """Per query with evidence: total and number of samples with at least min_read."""
    one = evidence.groupBy("id").agg(F.sum("evidence").alias("total_evidence"), F.count_if(F.col("evidence") >= min_read).alias("positive_samples"))
    return q.join(one, "id").select("id", "chr1", "pos1", "chr2", "pos2", "total_evidence", "positive_samples")


def region_reads(q: DataFrame, site: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads that support a pair of regions: id, side, sample_id, pid, left, right the first segment that starts or ends in the other region, and the number n of such reads."""
    cols = lambda n, a, b: F.struct(F.lit(n).alias("side"), F.col(f"chr{a}").alias("chrom"), F.col(f"s{a}").alias("lo"), F.col(f"e{a}").alias("hi"), F.col(f"chr{b}").alias("m_chrom"), F.col(f"s{b}").alias("m_lo"), F.col(f"e{b}").alias("m_hi"))
    sides = q.select("id", F.explode(F.array(cols("left", 1, 2), cols("right", 2, 1))).alias("x")).select("id", "x.*")
    hits = range_join(sides, site.select("chrom", "pos", "pid"), F.col("lo"), F.col("hi"), "pos", 1 << 12).select("id", "side", "m_chrom", "m_lo", "m_hi", "pid").distinct()
    df = hits.join(supporting(reads, "pid", "sample_id", "left", "right", "strand", "supp"), "pid")
    inside = lambda p: (p >= F.col("m_lo")) & (p <= F.col("m_hi"))
    seg = F.get(F.filter("supp", lambda x: (x["chrom"] == F.col("m_chrom")) & (inside(x["s"]) | inside(x["e"]))), F.lit(0))
    df = df.withColumn("seg", seg).filter("seg is not null")
    return df.select("id", "side", "sample_id", "pid", "left", "right", F.col("seg.chrom").alias("seg_chrom"), F.col("seg.s").alias("seg_s"), F.col("seg.e").alias("seg_e"), F.filter("supp", lambda x: x["chrom"] == F.col("m_chrom")).alias("supp"), "n")


def region_rows(found: DataFrame, pnir: DataFrame, samples: DataFrame) -> DataFrame:
    """What region_reads found as the columns of the detailed result, one row per read.

    chr1, start1, end1 (the read), chr2, start2, end2 (its segments on the other side), main_exon_count1,
    supp_segment_count2, query_part, main_isoforms and supp_aln_regions (s-e,s-e), sample_name.
    samples: sample_id, name.
    """
    df = found.join(pnir.select("pid", F.col("chrom").alias("chr1"), "sj"), "pid").join(bounded_broadcast(samples.select("sample_id", F.col("name").alias("sample_name"))), "sample_id")
    df = df.withColumn("main", exons_of(F.col("left"), F.col("right"), F.col("sj"))).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return df.select(
        "id", "chr1", F.col("left").alias("start1"), F.col("right").alias("end1"), F.col("seg_chrom").alias("chr2"), F.array_min(F.transform("supp", lambda x: x["s"])).alias("start2"), F.array_max(F.transform("supp", lambda x: x["e"])).alias("end2"),
        F.size("main").alias("main_exon_count1"), F.size("supp").alias("supp_segment_count2"), F.col("side").alias("query_part"), span_text(F.col("main")).alias("main_isoforms"), span_text(F.col("supp")).alias("supp_aln_regions"), "sample_name",
    )


def candidates(pnir: DataFrame, reads: DataFrame) -> DataFrame:
    """Groups of reads with the same main junctions and segments on one chromosome: cand, chrom, main sites, supp chrom, supp sites, sample_id, n."""
    one = F.size(F.array_distinct(F.transform("supp", lambda x: x["chrom"]))) == 1
    df = supporting(reads.filter(one), "pid", "sample_id", "supp").join(pnir.select("pid", F.col("chrom").alias("main_chrom"), "sj"), "pid")
    main = F.array_sort(F.flatten(F.transform("sj", lambda j: F.array(j["d"], j["a"]))))
    supp = F.array_sort(F.flatten(F.transform("supp", lambda x: F.array(x["s"], x["e"]))))
    df = df.select("main_chrom", main.alias("main"), F.col("supp")[0]["chrom"].alias("supp_chrom"), supp.alias("supp"), "sample_id", "n")
    df = df.withColumn("cand", F.md5(F.concat_ws(";", "main_chrom", F.array_join("main", ","), "supp_chrom", F.array_join("supp", ","))))
    return df.groupBy("cand", "sample_id").agg(F.first("main_chrom").alias("main_chrom"), F.first("main").alias("main"), F.first("supp_chrom").alias("supp_chrom"), F.first("supp").alias("supp"), F.sum("n").alias("n"))


def best_gene(spans: DataFrame, key: str, gene: DataFrame, flank: int = 10, gene_type: str | None = "protein_coding") -> DataFrame:
    """The gene that overlaps each (key, chrom, sites) and has most edges within flank of its sites: key, gene_id, gene_name, n_match, ambiguous."""
    g = gene if gene_type is None else gene.filter(F.col("gene_type") == gene_type)
    g = g.select("chrom", F.col("start").alias("g_s"), F.col("end").alias("g_e"), "gene_id", "gene_name", F.col("sites").alias("edges"))
    s = spans.select(key, "chrom", "sites", F.array_min("sites").alias("q_s"), F.array_max("sites").alias("q_e"))
    df = interval_join(s, g, "q_s", "q_e", "g_s", "g_e", 1 << 14)
    n = F.size(F.filter(F.array_distinct("sites"), lambda p: F.exists("edges", lambda e: F.abs(e - p) <= flank)))
    df = df.withColumn("n_match", n).filter("n_match > 0")
    w = Window.partitionBy(key).orderBy(F.col("n_match").desc(), "g_s", "g_e", "gene_id")
    return df.withColumn("rn", F.row_number().over(w)).withColumn("ambiguous", F.count("*").over(Window.partitionBy(key)) > 1).filter("rn = 1").select(key, "gene_id", "gene_name", "n_match", "ambiguous")


def gene_pairs(cand: DataFrame, gene: DataFrame, flank: int = 10, gene_type: str | None = "protein_coding") -> DataFrame:
    """Candidates whose two sides fall into different genes: pair (names in order), direction and sites of each side."""
    shape = cand.groupBy("cand").agg(*(F.first(c).alias(c) for c in ("main_chrom", "main", "supp_chrom", "supp")))
    side = lambda c, p: best_gene(shape.select("cand", F.col(f"{c}_chrom").alias("chrom"), F.col(c).alias("sites")), "cand", gene, flank, gene_type).select("cand", F.col("gene_id").alias(f"{p}_id"), F.col("gene_name").alias(f"{p}_name"))
    df = shape.join(side("main", "m"), "cand").join(side("supp", "s"), "cand").filter("m_id <> s_id")
    forward = F.col("m_name") <= F.col("s_name")
    return df.select("cand", F.least("m_name", "s_name").alias("gene_a"), F.greatest("m_name", "s_name").alias("gene_b"), F.when(forward, "ab").otherwise("ba").alias("direction"), "main_chrom", "main", "supp_chrom", "supp")


def clusters(cand: DataFrame, pairs: DataFrame, require_both: bool = True) -> DataFrame:
    """One row per gene pair: evidence, samples and the mean outermost sites of both genes, kept if both directions agree.

    Means run over candidates; the directions agree if, for each gene, the range seen as main and
    the range seen as segment overlap. Without require_both, pairs seen one way are kept as well.
    """
    lo, hi = F.array_min, F.array_max
    ab = F.col("direction") == "ab"
    m = {f"{d}_{s}_{e}": F.avg(F.when(ab if d == "ab" else ~ab, f(s))) for d in ("ab", "ba") for s in ("main", "supp") for e, f in (("lo", lo), ("hi", hi))}
    sd = {f"{d}_{s}_{e}_sd": F.stddev_pop(F.when(ab if d == "ab" else ~ab, f(s))) for d in ("ab", "ba") for s in ("main", "supp") for e, f in (("lo", lo), ("hi", hi))}
    ends = pairs.groupBy("gene_a", "gene_b").agg(*(v.alias(k) for k, v in (m | sd).items()), F.count("*").alias("n_candidates"))
    over = lambda a, b: (F.col(f"{a}_lo") <= F.col(f"{b}_hi")) & (F.col(f"{b}_lo") <= F.col(f"{a}_hi"))
    agree = F.coalesce(over("ab_main", "ba_supp") & over("ab_supp", "ba_main"), F.lit(False))
    one_way = F.col("ab_main_lo").isNull() | F.col("ba_main_lo").isNull()
    ends = ends.withColumn("two_strand", ~one_way).filter(agree if require_both else agree | one_way)
    per = cluster_samples(cand, pairs)
    total = per.groupBy("gene_a", "gene_b").agg(F.sum("n").alias("total_evidence"), F.count("*").alias("total_samples"))
    return ends.join(total, ["gene_a", "gene_b"])


def cluster_samples(cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """gene_a, gene_b, sample_id, n: the reads of each sample for each gene pair."""
    return cand.select("cand", "sample_id", "n").join(pairs.select("cand", "gene_a", "gene_b"), "cand").groupBy("gene_a", "gene_b", "sample_id").agg(F.sum("n").alias("n"))
