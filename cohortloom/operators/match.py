"""Matching transcripts against the cohort: full matches, partial matches, chains, mono-exons, groups.

Defined cases. Transcripts without exons match nothing. Repeated postings count once. A chromosome
that the cohort lacks gives no rows here and zeros in the result rows. Sites of all transcripts are
pooled and made distinct before the cohort is probed, so a site shared by many transcripts is
looked up once. Ties in the order of transcripts are settled by (start, end, tx_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import junction_sites, junction_text
from ..session import durable
from .build import signature
from .periods import BIN, periods_and_gaps, with_next
from .rangejoin import flank_join, interval_join


def overlap_groups(df: DataFrame, entity: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Rows with group_id, the first position of the chain of overlapping intervals (closed ends) they are in.

    The chains are the covered periods of the sweep line, which no crowded chromosome slows down; a
    row finds its own by the coordinate bin of its start. Rows that are no interval are dropped.
    """
    chains = periods_and_gaps(df, [entity], start, end).filter("kind = 'period'")
    bins = F.explode(F.sequence(F.floor(F.col("start_pos") / BIN), F.floor(F.col("end_pos") / BIN)))
    chains = chains.select(entity, bins.alias("_bin"), F.col("start_pos").alias("group_id"), F.col("end_pos").alias("_upto"))
    rows = df.withColumn("_bin", F.floor(F.col(start) / BIN)).join(chains, [entity, "_bin"])
    return rows.filter((F.col(start) >= F.col("group_id")) & (F.col(start) < F.col("_upto"))).drop("_bin", "_upto")


def elementary_segments(df: DataFrame, entity: str, start: str, end: str, id_: str) -> DataFrame:
    """Segments between neighbouring end points with the intervals active in them: entity, seg_start, seg_end, id.

    Neighbours are found in coordinate bins; equal intervals are swept once.
    """
    spans = durable(df.select(entity, F.col(start).alias("_s"), F.col(end).alias("_e"), id_).filter("_s < _e"))
    points = spans.select(entity, F.explode(F.array("_s", "_e")).alias("pos")).distinct().withColumn("bin", F.floor(F.col("pos") / BIN))
    segs = with_next(durable(points), [entity]).select(entity, F.col("pos").alias("seg_start"), F.col("next_pos").alias("seg_end"))
    hit = interval_join(spans.select(entity, "_s", "_e").distinct(), segs, "_s", "_e", "seg_start", "seg_end", 1 << 14, entity)
    hit = hit.filter("_s <= seg_start and _e >= seg_end")
    return spans.join(hit, [entity, "_s", "_e"]).select(entity, "seg_start", "seg_end", id_)


def tx_chains(tx: DataFrame) -> DataFrame:
    """The distinct junction chains of multi-exon transcripts: cid, chrom, sj. Transcripts that share one are matched once."""
    return tx.filter(~F.col("is_mono")).select(chain_id(), "chrom", "sj").dropDuplicates(["cid"])


def chain_id() -> Column:
    return signature(F.col("chrom"), junction_text(F.col("sj"))).alias("cid")


def by_transcript(df: DataFrame, tx: DataFrame) -> DataFrame:
    """Rows of chains as rows of the transcripts that have them."""
    return df.join(tx.filter(~F.col("is_mono")).select("tx_idx", chain_id()), "cid").drop("cid")


def tx_sites(tx: DataFrame, id_: str = "tx_idx") -> DataFrame:
    """Junction sites of multi-exon transcripts (or of chains): id, chrom, sj_no (from 0), side (0 donor, 1 acceptor), q_pos."""
    df = tx.filter(~F.col("is_mono")) if "is_mono" in tx.columns else tx
    df = df.select(id_, "chrom", F.posexplode("sj").alias("sj_no", "j"))
    return df.select(id_, "chrom", "sj_no", F.posexplode(F.array("j.d", "j.a")).alias("side", "q_pos"))


def site_hits(sites: DataFrame, postings: DataFrame, flank: int) -> DataFrame:
    """Query sites with the signatures that have a splice site within flank: sites' columns, pid, n_sites."""
    probes = sites.select("chrom", "q_pos").distinct()
    hits = flank_join(probes, postings.filter("kind = 'sj'"), "q_pos", "pos", flank).select("chrom", "q_pos", "pid", "n_sites").distinct()
    return sites.join(hits, ["chrom", "q_pos"])


def full_matches(hits: DataFrame, tx: DataFrame) -> DataFrame:
    """Relational division: (tx_idx, pid) where the signature is hit at every site and has as many sites."""
    n = hits.groupBy("tx_idx", "pid", "n_sites").agg(F.countDistinct("q_pos").alias("n_hit"))
    want = tx.filter(~F.col("is_mono")).select("tx_idx", F.size(junction_sites(F.col("sj"))).alias("n_pos"), (F.size("sj") * 2).alias("n_all"))
    return n.join(want, "tx_idx").filter("n_hit = n_pos and n_sites = n_all").select("tx_idx", "pid")


def full_chain_matches(chains: DataFrame, pnir: DataFrame, postings: DataFrame, flank: int) -> DataFrame:
    """(cid, pid) of full matches: the record has as many sites as the chain, and one within flank of each.

    Only a chain's rarest site is looked up: the one with the fewest records of that many sites
    around it. The records found are then tested on their own junctions, so the sites that all
    records of a gene share multiply nothing.
    """
    sites = chains.select("cid", "chrom", (F.size("sj") * 2).alias("n_sites"), F.explode(junction_sites(F.col("sj"))).alias("q_pos"))
    posted = postings.filter("kind = 'sj'").select("chrom", "pos", "pid", F.col("n_sites").alias("m_sites"))
    counts = posted.groupBy("chrom", "pos", "m_sites").agg(F.count("*").alias("n"))
    near = flank_join(sites.select("chrom", "n_sites", "q_pos").distinct(), counts, "q_pos", "pos", flank).filter("n_sites = m_sites")
    near = near.groupBy("chrom", "n_sites", "q_pos").agg(F.sum("n").alias("n"))
    rare = sites.join(near, ["chrom", "n_sites", "q_pos"], "left").groupBy("cid", "chrom", "n_sites").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q_pos")).alias("r"))
    # a site without any record rules the chain out
    probes = rare.filter("r.n > 0").select("cid", "chrom", "n_sites", F.col("r.q_pos").alias("q_pos"))
    pairs = flank_join(probes, posted, "q_pos", "pos", flank).filter("n_sites = m_sites").select("cid", "pid").distinct()
    pairs = pairs.join(chains.select("cid", junction_sites(F.col("sj")).alias("want")), "cid").join(pnir.select("pid", junction_sites(F.col("sj")).alias("have")), "pid")
    return pairs.filter(F.forall("want", lambda q: F.exists("have", lambda r: F.abs(r - q) <= flank))).select("cid", "pid")


def run_matches(chains: DataFrame, pnir: DataFrame, flank: int) -> DataFrame:
    """(cid, pid, first, n_sj) of records whose junctions are a contiguous run of the chain's, each end within flank.

    Such a record's first junction is near one of the chain's, so records are found by it: distinct
    junctions meet distinct first junctions, and only then chains meet records.
    """
    refs = chains.select("cid", "chrom", F.explode("sj").alias("j")).select("cid", "chrom", F.col("j.d").alias("d"), F.col("j.a").alias("a"))
    recs = pnir.filter(F.size("sj") > 0).select("pid", "chrom", F.col("sj")[0]["d"].alias("rd"), F.col("sj")[0]["a"].alias("ra"))
    met = flank_join(refs.select("chrom", "d", "a").distinct(), recs.select("chrom", "rd", "ra").distinct(), "d", "rd", flank)
    met = met.filter(F.abs(F.col("ra") - F.col("a")) <= flank).select("chrom", "d", "a", "rd", "ra")
    pairs = refs.join(met, ["chrom", "d", "a"]).select("cid", "chrom", "rd", "ra").distinct().join(recs, ["chrom", "rd", "ra"]).select("cid", "pid")
    df = pairs.join(chains.select("cid", F.col("sj").alias("ref")), "cid").join(pnir.select("pid", F.col("sj").alias("rec")), "pid")
    df = df.withColumn("c", chain(F.col("ref"), F.col("rec"), flank)).filter(F.col("c").getField("all"))
    return df.select("cid", "pid", F.col("c.first").alias("first"), F.size("rec").alias("n_sj"))


def at_least(hits: DataFrame, query: str, k: int, n_queries: Column) -> DataFrame:
    """Signatures hit by at least k positions of a query; k = 0, or more than there are, means all."""
    df = hits.groupBy(query, "pid").agg(F.countDistinct("q_pos").alias("n_hit"), F.max(n_queries).alias("n"))
    need = F.when((F.lit(k) == 0) | (F.lit(k) >= F.col("n")), F.col("n")).otherwise(F.lit(k))
    return df.filter(F.col("n_hit") >= need).select(query, "pid", "n_hit")


def partial_matches(hits: DataFrame, id_: str = "tx_idx") -> DataFrame:
    """(transcript or chain, pid) where the signature is hit at both sites of at least one junction."""
    both = hits.groupBy(id_, "sj_no", "pid").agg(F.countDistinct("side").alias("n")).filter("n = 2")
    return both.select(id_, "pid").distinct()


def unclaimed(partial: DataFrame, fsm: DataFrame, tx: DataFrame) -> DataFrame:
    """Partial matches without those that this or an earlier transcript of the group claims in full."""
    order = tx.select("tx_idx", "chrom", "group_id", F.struct("start", "end", "tx_idx").alias("ord"))
    claim = fsm.join(order, "tx_idx").groupBy("chrom", "group_id", "pid").agg(F.min("ord").alias("claim"))
    df = partial.join(order, "tx_idx").join(claim, ["chrom", "group_id", "pid"], "left")
    return df.filter(F.col("claim").isNull() | (F.col("claim") > F.col("ord"))).select("tx_idx", "pid")


def chain(ref: Column, rec: Column, flank: int) -> Column:
    """struct(all, first, count): how a record's junctions follow a run of the transcript's, each end within flank."""
    near = lambda a, b: (F.abs(a["d"] - b["d"]) <= flank) & (F.abs(a["a"] - b["a"]) <= flank)
    r0 = F.get(rec, F.lit(0))
    at = F.filter(F.transform(ref, lambda t, i: F.when(near(t, r0), i)), lambda i: i.isNotNull())
    first = F.when((F.size(rec) > F.size(ref)) | (F.size(rec) == 0), F.lit(-1)).otherwise(F.coalesce(F.get(at, F.lit(0)), F.lit(-1)))
    tail = F.slice(ref, F.greatest(first + 1, F.lit(1)), F.size(rec))
    steps = F.zip_with(tail, rec, lambda t, r: F.coalesce(near(t, r), F.lit(False)))
    run = F.coalesce(F.array_position(steps, F.lit(False)), F.lit(0))
    count = F.when(first < 0, 0).when(run == 0, F.size(rec)).otherwise((run - 1).cast("int"))
    return F.struct(((count == F.size(rec)) & (first >= 0)).alias("all"), first.alias("first"), count.alias("count"))


def chained(partial: DataFrame, tx: DataFrame, pnir: DataFrame, flank: int) -> DataFrame:
    """Partial matches whose junctions are a contiguous run of the transcript's: tx_idx, pid, first, n_sj."""
    df = partial.join(tx.select("tx_idx", F.col("sj").alias("ref")), "tx_idx").join(pnir.select("pid", F.col("sj").alias("rec")), "pid")
    df = df.withColumn("c", chain(F.col("ref"), F.col("rec"), flank))
    return df.filter(F.col("c").getField("count") == F.size("rec")).select("tx_idx", "pid", F.col("c.first").alias("first"), F.size("rec").alias("n_sj"))


def within_ends(shape_left: Column, shape_right: Column, start: Column, end: Column, strand: Column, tolerance: int = 10, tss: int = 2000, tes: int = 8000) -> Column:
    """Read ends within the windows at the transcript's ends; the wide and the narrow one change sides with the strand."""
    near, far = F.when(strand == "+", tss).otherwise(tes), F.when(strand == "+", tes).otherwise(tss)
    return (shape_left >= start - tolerance) & (shape_left <= start + near) & (shape_right >= end - far) & (shape_right <= end + tolerance)


def full_evidence(fsm: DataFrame, shapes: DataFrame, tx: DataFrame, check_ends: bool = True, **windows) -> DataFrame:
    """Reads of each sample that support a transcript in full: tx_idx, sample_id, fsm. Mono-exons aren't held to the windows."""
    df = fsm.join(shapes, "pid").join(tx.select("tx_idx", "start", "end", F.col("strand").alias("tx_strand"), "is_mono"), "tx_idx")
    if check_ends:
        df = df.filter(F.col("is_mono") | within_ends(F.col("left"), F.col("right"), F.col("start"), F.col("end"), F.col("tx_strand"), **windows))
    return df.groupBy("tx_idx", "sample_id").agg(F.sum("n").alias("fsm"))


def covered(chains: DataFrame, tx: DataFrame) -> DataFrame:
    """tx_idx of the transcripts whose junctions are all in the run of some chained record."""
    df = chains.select("tx_idx", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_sj") - 1)).alias("k"))
    n = df.groupBy("tx_idx").agg(F.countDistinct("k").alias("n"))
    return n.join(tx.select("tx_idx", F.size("sj").alias("n_all")), "tx_idx").filter("n = n_all").select("tx_idx")


def mono_matches(tx: DataFrame, pnir: DataFrame, flank: int) -> DataFrame:
    """Mono-exon signatures at mono-exon transcripts, each pair once: tx_idx, pid, full (both ends within flank, else contained)."""
    t = tx.filter("is_mono").select("chrom", "tx_idx", F.col("start").alias("t_s"), F.col("end").alias("t_e"), (F.col("start") - flank).alias("q_s"), (F.col("end") + flank).alias("q_e"))
    m = pnir.filter("is_mono").select("chrom", "pid", F.col("sj")[0]["d"].alias("m_s"), F.col("sj")[0]["a"].alias("m_e"))
    df = interval_join(t, m, "q_s", "q_e", "m_s", "m_e", 1 << 12)
    full = (F.abs(F.col("m_s") - F.col("t_s")) <= flank) & (F.abs(F.col("m_e") - F.col("t_e")) <= flank)
    inside = (F.col("m_s") >= F.col("t_s")) & (F.col("m_e") <= F.col("t_e"))
    return df.filter(full | inside).select("tx_idx", "pid", full.alias("full"), (F.col("m_e") - F.col("m_s")).alias("span"))
