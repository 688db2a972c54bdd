"""Quantification of transcripts over a cohort: matching, full evidence, EM, and the cells of the result.

Transcripts with the same chain are matched once, and those that also share their ends and strand have
their evidence counted once; only the last step has a row per transcript.

Defined cases. As in match, em and stats: transcripts without evidence have no cells here and zeros in
the result rows; repeated transcripts are apart by tx_idx and have equal cells; empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import em, match, stats


@dataclass(frozen=True)
class Options:
    """The parameters of the isoform query."""

    flank: int = 10
    min_read: int = 1
    em: em.Settings = field(default_factory=em.Settings)
    min_em_abundance: float = 1e-4
    check_tss_tes: bool = True
    tss_degrad_bp: int = 2000
    tes_degrad_bp: int = 8000
    terminal_tolerance_bp: int = 10
    info: bool = False


@dataclass
class Quantification:
    """A query's transcripts and what was found for them; each table written once."""

    tx: DataFrame
    kinds: DataFrame
    full: DataFrame
    fsm: DataFrame
    cells: DataFrame


def with_kinds(tx: DataFrame) -> DataFrame:
    """Transcripts with cid (null for mono-exons), group_id and kid, which those with the same chain, ends and strand share."""
    df = match.overlap_groups(tx).withColumn("cid", F.when(~F.col("is_mono"), match.chain_id()))
    kid = F.md5(F.concat_ws(":", F.coalesce("cid", F.lit("mono")), "chrom", "start", "end", "strand"))
    return df.withColumn("kid", kid)


def full_pairs(kinds: DataFrame, chains: DataFrame, pnir: DataFrame, site: DataFrame, flank: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full matches of chains (cid, pid), of kinds (kid, pid), and contained mono-exon records (kid, pid, span)."""
    fsm = durable(match.full_chain_matches(chains, pnir, site, flank))
    mono = durable(match.mono_matches(kinds.withColumnRenamed("kid", "tx_idx"), pnir, flank).withColumnRenamed("tx_idx", "kid"))
    multi = fsm.join(kinds.filter(~F.col("is_mono")).select("cid", "kid"), "cid").select("kid", "pid")
    return fsm, durable(multi.unionByName(mono.filter("full").select("kid", "pid"))), mono.filter("not full")


def quantify(tx: DataFrame, pnir: DataFrame, site: DataFrame, profile: DataFrame, shapes: DataFrame, opts: Options = Options()) -> Quantification:
    """Cells (tx_idx, sample_id, fsm, em, em_shown) of all transcripts over a cohort."""
    tx = durable(with_kinds(tx))
    kinds = durable(tx.groupBy("kid").agg(*(F.first(c).alias(c) for c in ("cid", "chrom", "group_id", "start", "end", "strand", "is_mono", "sj"))))
    chains = durable(match.tx_chains(tx))
    fsm, full, inside = full_pairs(kinds, chains, pnir, site, opts.flank)
    windows = {"tolerance": opts.terminal_tolerance_bp, "tss": opts.tss_degrad_bp, "tes": opts.tes_degrad_bp}
    as_tx = kinds.withColumnRenamed("kid", "tx_idx")
    counted = durable(match.full_evidence(full.withColumnRenamed("kid", "tx_idx"), shapes, as_tx, opts.check_tss_tes, **windows).withColumnRenamed("tx_idx", "kid"))
    # partial evidence
    runs, atoms = em.kept_runs(durable(match.run_matches(chains, pnir, opts.flank)), fsm, tx.filter(~F.col("is_mono")))
    runs, atoms = durable(runs), durable(atoms)
    covered = em.coverage(runs, chains.select("cid", F.size("sj").alias("n_sj")))
    info = atoms.groupBy("chrom", "group_id", "cid", "atom").agg(F.count("*").alias("times")).join(covered, "cid")
    mono = inside.join(profile.select("pid", "sample_id", "evidence"), "pid").groupBy("kid", "sample_id").agg(F.sum("evidence").cast("double").alias("cov"))
    mono = mono.join(kinds.select("kid", "chrom", "group_id"), "kid")
    member = F.array(F.struct(F.concat(F.lit("mono:"), "kid").alias("cid"), F.lit(1).alias("k")))
    cls = em.classes(runs, profile).unionByName(mono.select("chrom", "group_id", member.alias("members"), "sample_id", "cov"))
    cls = cls.select("chrom", "group_id", "members", F.col("sample_id").cast("bigint").alias("sample_id"), "cov")
    alone = mono.select("chrom", "group_id", F.concat(F.lit("mono:"), "kid").alias("cid"), F.lit(0).alias("atom"), F.lit(1).cast("bigint").alias("times"), F.lit(0).alias("n_sj"), F.lit(1).alias("covered")).distinct()
    order = ["chrom", "group_id", "cid", "atom", "times", "n_sj", "covered"]
    got = durable(em.abundances(cls, info.select(*order).unionByName(alone.select(*order)), opts.em))
    names = atoms.select("tx_idx", "cid", "atom").unionByName(tx.filter("is_mono").select("tx_idx", F.concat(F.lit("mono:"), "kid").alias("cid"), F.lit(0).alias("atom")))
    per_tx = names.join(got, ["cid", "atom"]).select("tx_idx", "sample_id", "em")
    fsm_tx = tx.select("tx_idx", "kid").join(counted, "kid").select("tx_idx", "sample_id", "fsm")
    cells = durable(stats.abundance_cells(fsm_tx, per_tx, opts.min_em_abundance))
    return Quantification(tx, kinds, full, fsm, cells)


def supporting_info(q: Quantification, reads: DataFrame, opts: Options = Options()) -> DataFrame:
    """tx_idx, sample_id, info: the k=v pairs of the reads that support a transcript in full, each distinct text once, joined by commas.

    As long as the reads that support a transcript in one sample; asked for by Options.info only.
    """
    text = F.array_join(F.transform("info", lambda p: F.concat_ws("=", p["k"], p["v"])), ";")
    named = reads.filter(F.size("info") > 0).select("pid", "sample_id", "left", "right", text.alias("text"))
    df = q.full.join(named, "pid").join(q.kinds.select("kid", "start", "end", F.col("strand").alias("tx_strand"), "is_mono"), "kid")
    if opts.check_tss_tes:
        ok = match.within_ends(F.col("left"), F.col("right"), F.col("start"), F.col("end"), F.col("tx_strand"), opts.terminal_tolerance_bp, opts.tss_degrad_bp, opts.tes_degrad_bp)
        df = df.filter(F.col("is_mono") | ok)
    df = df.groupBy("kid", "sample_id").agg(F.array_join(F.array_sort(F.collect_set("text")), ",").alias("info"))
    return q.tx.select("tx_idx", "kid").join(df, "kid").select("tx_idx", "sample_id", "info")
