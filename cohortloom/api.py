"""The commands: profile, merge, index, and the queries on an index.

Each takes and gives DataFrames or paths; nothing here computes that isn't in the operators. Parameters
have the defaults of the command line they stand for; those that only set threads, caches or chunk sizes
have no use here. Wrong parameters raise ValueError before any job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.genome import bare_chrom, junction_text
from .index import Index, write_index
from .operators import build, em, fusion, quantify, splice, stats
from .session import bounded_broadcast, durable
from .sources import alignments, gtf, profile_text, tables

READS = "sample_id bigint, chrom string, strand string, exons array<struct<s:bigint,e:bigint>>, supp array<struct<chrom:string,s:bigint,e:bigint,strand:string>>, info array<struct<k:string,v:string>>"


def profile_alignments(spark: SparkSession, path: str, mapq: int = 5, use_secondary: bool = False, rname: bool = False) -> DataFrame:
    """Reads of a SAM or BAM file with their signatures."""
    records = alignments.read_bam(spark, [path]) if path.endswith(".bam") else alignments.read_sam(spark, path)
    return build.with_signature(alignments.profile_alignments(records, 0, mapq, use_secondary, rname))


def profile_gtf(spark: SparkSession, path: str, tid: bool = False, gid: bool = False) -> DataFrame:
    """The transcripts of a GTF file as reads with their signatures."""
    return build.with_signature(gtf.transcripts_as_reads(gtf.transcripts(gtf.read_gtf(spark, path)), 0, tid, gid))


def write_profile(reads: DataFrame, path: str) -> None:
    """One sample's reads as a profile file."""
    profile_text.write_profile(profile_text.records_of(reads), path)


def merge_profiles(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """Samples and reads of all profiles that a manifest lists; a path without a profile gives a sample without reads."""
    samples = durable(tables.read_manifest(spark, manifest))
    paths = [r["path"] for r in samples.select("path").distinct().collect()]
    if not paths:
        raise ValueError("the manifest lists no sample")
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*(?=/)", "")
    text = profile_text.read_profiles(spark, paths).withColumn("path", plain(F.col("path")))
    # a profile is a file or the folder of its parts
    given = bounded_broadcast(samples.select("sample_id", plain(F.col("path")).alias("_given")))
    text = text.withColumn("_given", F.explode(F.array("path", F.regexp_replace("path", "/[^/]*$", "")))).join(given, "_given")
    return samples, profile_text.reads_of(text)


def build_index(samples: DataFrame, reads: DataFrame, path: str) -> Index:
    """Writes an index from samples and reads, as merge_profiles gives them."""
    return write_index(samples, reads, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a GTF file, numbered in the order of their place in the genome."""
    df = gtf.transcripts(gtf.read_gtf(spark, path))
    order = df.withColumn("_order", F.concat_ws("\t", "chrom", F.lpad(F.col("start").cast("string"), 12, "0"), F.lpad(F.col("end").cast("string"), 12, "0"), "tx_id"))
    return tables.number_rows(order, "_order").withColumn("tx_idx", F.col("row_no") - 1).drop("_order", "row_no")


def _positive(**values: float) -> None:
    for k, v in values.items():
        if v < 0:
            raise ValueError(f"{k} must not be negative")


def query_isoform(
    index: Index, tx: DataFrame, flank: int = 10, min_read: int = 1, em_max_iter: int = 100, em_conv_min_diff: float = 0.01, em_effective_len_coef: int = 2, em_damping_factor: float = 0.3,
    min_em_abundance: float = 1e-4, no_check_tss_tes: bool = False, tss_degrad_bp: int = 2000, tes_degrad_bp: int = 8000, terminal_tolerance_bp: int = 10, info: bool = False,
) -> DataFrame:
    """Transcripts quantified over an index, in long form; see stats.isoform_rows for the columns, write_isoform for the file."""
    _positive(flank=flank, min_read=min_read, em_max_iter=em_max_iter, tss_degrad_bp=tss_degrad_bp, tes_degrad_bp=tes_degrad_bp, terminal_tolerance_bp=terminal_tolerance_bp)
    if not 0 < em_damping_factor <= 1:
        raise ValueError("em_damping_factor must be above 0 and at most 1")
    settings = em.Settings(em_max_iter, em_conv_min_diff, em_effective_len_coef, em_damping_factor)
    opts = quantify.Options(flank, min_read, settings, min_em_abundance, not no_check_tss_tes, tss_degrad_bp, tes_degrad_bp, terminal_tolerance_bp, info)
    q = quantify.quantify(tx, index.pnir, index.site, index.profile, index.shapes, opts)
    return stats.isoform_rows(tx, q.cells, index.n_samples, min_read, quantify.supporting_info(q, index.reads, opts) if info else None)


ISOFORM_KEYS = ["chrom", "start", "end", "length", "exon_count", "trans_id", "gene_id", "confidence", "detected", "min_read", "n_pos_samples", "attributes"]


def isoform_table(index: Index, rows: DataFrame) -> tuple[DataFrame, list[str], dict[str, int]]:
    """Isoform rows as a wide table with one column a sample, the samples' names in order, and their reads."""
    samples = index.sample.select("sample_id", "name", "total_evidence").orderBy("sample_id").collect()
    names = index.sample.select("sample_id", F.col("name").alias("_sample"))
    named = rows.join(bounded_broadcast(names), "sample_id", "left")
    return tables.wide(named, ["tx_idx", *ISOFORM_KEYS], "_sample", "cell", [r["name"] for r in samples], "0.0:0.0:0.0:0:0.0:0.0:"), [r["name"] for r in samples], {r["name"]: r["total_evidence"] for r in samples}


def write_isoform(index: Index, rows: DataFrame, path: str) -> None:
    """The isoform result as gzipped text in the order of tx_idx, written in parallel."""
    table, names, totals = isoform_table(index, rows)
    head = {"detected": "detected(total:fsm:em)", "n_pos_samples": "n_pos_samples(total:fsm:em/sample_size)"}
    meta = [f"{r['name']}\t" + ";".join(f"{k}={v}" for k, v in sorted((r["attrs"] or {}).items())) for r in index.sample.orderBy("sample_id").select("name", "attrs").collect()]
    tables.write_result_table(table, ISOFORM_KEYS, names, totals, stats.FORMAT, path, meta, order="tx_idx", labels=head)


def query_splice(index: Index, pairs: DataFrame | str, flank: int = 10, min_read: int = 1) -> DataFrame:
    """Isoforms that hold a junction. pairs: chr:pos,pos, or a DataFrame of id, chrom, left, right; records with fewer than min_read reads are left out."""
    _positive(flank=flank, min_read=min_read)
    if isinstance(pairs, str):
        chrom, left, right = tables.parse_junction(pairs)
        pairs = index.spark.createDataFrame([(pairs, chrom, left, right)], "id string, chrom string, left bigint, right bigint")
    report = splice.splice_report(pairs, index.pnir, index.site, index.shapes, index.totals, flank)
    return report.filter(F.col("evidence") >= min_read)


def query_fusion_breakpoints(index: Index, pairs: DataFrame | str, flank: int = 10, min_read: int = 1) -> DataFrame:
    """Evidence for pairs of breakpoints. pairs: chr:pos,chr:pos, or a DataFrame of id, chr1, pos1, chr2, pos2 as tables.bed_pairs gives it."""
    _positive(flank=flank, min_read=min_read)
    if isinstance(pairs, str):
        pairs = index.spark.createDataFrame([(pairs, *tables.parse_breakpoints(pairs))], "id string, chr1 string, pos1 bigint, chr2 string, pos2 bigint")
    return fusion.breakpoint_rows(pairs, fusion.breakpoint_evidence(pairs, index.site, index.reads, flank), min_read)


def query_fusion_region(index: Index, regions: str, min_read: int = 1) -> DataFrame:
    """Reads that support a pair of regions chr:s-e,chr:s-e; records with fewer than min_read such reads are left out."""
    _positive(min_read=min_read)
    q = index.spark.createDataFrame([(regions, *tables.parse_regions(regions))], "id string, chr1 string, s1 bigint, e1 bigint, chr2 string, s2 bigint, e2 bigint")
    found = fusion.region_reads(q, index.site, index.reads)
    enough = found.groupBy("id", "side", "pid").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_read).select("id", "side", "pid")
    return found.join(enough, ["id", "side", "pid"], "left_semi")


def discover_fusions(index: Index, genes: DataFrame, flank: int = 10, min_read: int = 1, require_both: bool = True, gene_type: str | None = "protein_coding") -> DataFrame:
    """Fused pairs of genes with at least min_read reads. genes as gtf.genes gives them."""
    _positive(flank=flank, min_read=min_read)
    cand = durable(fusion.candidates(index.pnir, index.reads))
    pairs = durable(fusion.gene_pairs(cand, genes, flank, gene_type))
    return fusion.clusters(cand, pairs, require_both).filter(F.col("total_evidence") >= min_read)


def merge_replicates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two profiles in one, as one sample."""
    return build.merge_replicates(a, b)


def merge_outputs(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """Two isoform result files in one, in long form, with detected, positives and confidence computed anew."""
    a, totals_a, keys, _ = tables.read_result_table(spark, path_a)
    b, totals_b, keys_b, _ = tables.read_result_table(spark, path_b)
    if keys != keys_b:
        raise ValueError("the tables have different columns")
    fixed = [k for k in keys if k.split("(")[0] not in ("confidence", "detected", "n_pos_samples")]
    positives = next(k for k in keys if k.startswith("n_pos_samples"))
    side = lambda df: df.withColumnRenamed(positives, "positives").select(*fixed, "positives", "sample", "cell")
    return tables.merge_isoform(side(a), side(b), fixed, totals_a, totals_b)


def view(index: Index, what: str) -> DataFrame:
    """The parts of an index as text columns: postings, records, samples or chromosomes."""
    if what == "postings":
        return index.site.select("chrom", "pos", "pid", "n_sites", "kind")
    if what == "records":
        return index.pnir.select("chrom", "pid", junction_text(F.col("sj")).alias("junctions"), "n_sites", "total_evidence", "n_samples", "is_mono")
    if what == "samples":
        return index.sample.select("sample_id", "name", "total_evidence", F.to_json("attrs").alias("attrs"))
    if what == "chromosomes":
        return index.pnir.groupBy("chrom").agg(F.count("*").alias("n_records"))
    raise ValueError(f"no such view: {what}")


def splice_document(index: Index, genes: DataFrame, pair: str, flank: int = 10) -> DataFrame:
    """One row, column document: the isoforms that hold a junction, their cells per sample, and the genes that overlap them, as JSON.

    Isoforms are in the order of their leftmost start. A document is as long as the isoforms of one
    junction; it is what one page shows.
    """
    report = durable(query_splice(index, pair, flank))
    names = index.sample.select("sample_id", F.col("name").alias("sample"))
    cells = splice.splice_cells(report, index.shapes, index.profile, index.totals).join(bounded_broadcast(names), "sample_id")
    cells = cells.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("sample", "evidence", "cpm", "reads"))).alias("cells"))
    isoforms = report.join(cells, "pid", "left").select(F.struct("start_min", "end_max", "pid", "chrom", "evidence", "cpm", "sj_no", "left_dist", "right_dist", "n_exons", "junctions", "cells").alias("x"))
    span = report.groupBy().agg(F.first("chrom").alias("chrom"), F.min("start_min").alias("s"), F.max("end_max").alias("e"))
    near = genes.join(F.broadcast(span.select(F.col("chrom").alias("_c"), "s", "e")), (bare_chrom("chrom") == F.col("_c")) & (F.col("start") <= F.col("e")) & (F.col("end") >= F.col("s")))
    near = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("start", "end", "gene_id", "gene_name", "gene_type"))).alias("genes"))
    # one row each
    both = isoforms.groupBy().agg(F.array_sort(F.collect_list("x")).alias("isoforms")).withColumn("_k", F.lit(1)).join(near.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.to_json(F.struct(F.lit(pair).alias("query"), "isoforms", "genes")).alias("document"))
