"""Queries that go through files: the driver's tables are written as GTF, SAM, profiles and manifests, read
back by the readers, indexed, and queried through the commands.

The files lie in the shared folder for intermediate tables.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import genome as g
from ..index import Index
from ..operators import build, fusion, rangejoin
from ..session import scratch_path
from ..sources import alignments, gtf, profile_text, tables
from .projection import BASE, SAMPLES, Cohort
from .reference import _CAND, _EM, _FULL, _ROWS, _fusion_queries, _isoform_columns, _recursive

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Files(Cohort):
    """The cohort of a data directory as files."""

    def place(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def gtf(self) -> str:
        path = self.place("gtf")
        gtf.write_gtf(self.tx, self.gene, path)
        return path

    @cached_property
    def sam(self) -> str:
        """One line a read; segments of the SA tag have one block."""
        path = self.place("sam")
        exons = g.exons_of(F.col("left"), F.col("right"), g.junctions_of(F.col("junctions")))
        ops = F.transform(F.col("exons"), lambda x, i: F.concat((x["e"] - x["s"]).cast("string"), F.lit("M"), F.coalesce(F.concat((F.get("exons", i + 1)["s"] - x["e"]).cast("string"), F.lit("N")), F.lit(""))))
        sa = F.array_join(F.transform("supp", lambda x: F.concat(F.lit("chr"), x["chrom"], F.lit(","), x["s"] + 1, F.lit(","), x["strand"], F.lit(","), x["e"] - x["s"], F.lit("M,60,0;"))), "")
        df = self.reads.withColumn("exons", exons).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        name = F.concat_ws(".", F.lit("r"), "sample_id", F.substring("pid", 1, 12), "left", "right", "_i")
        line = F.concat_ws("\t", name, F.when(F.col("strand") == "+", "0").otherwise("16"), F.concat(F.lit("chr"), "chrom"), F.col("left") + 1, F.lit("60"), F.array_join(ops, ""), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.when(F.size("supp") > 0, F.concat(F.lit("SA:Z:"), sa)))
        df.select(line.alias("value")).write.text(path)
        return path

    @cached_property
    def manifest(self) -> str:
        path = self.place("manifest")
        lines = ["name\tpath\tTissue"]
        for i in range(SAMPLES):
            at = f"{path}-S{i}"
            api.write_profile(self.reads.filter(F.col("sample_id") == i), at)
            lines.append(f"S{i}\t{at}\t{'tissue' if i % 2 else 'blood'}")
        self.spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
        return path

    @cached_property
    def index(self) -> Index:
        return api.build_index(*api.merge_profiles(self.spark, self.manifest), self.place("index"))

    @cached_property
    def transcripts(self) -> DataFrame:
        return api.read_transcripts(self.spark, self.gtf)


def query(sql: str | None = None):
    """Register a function of Files as a query, with the SQL that follows the common CTEs."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Files(spark, d))
        if sql:
            SQL[f.__name__] = BASE + sql
        return f

    return add


# ---- sources


@query("""SELECT tx_id, gene_id, chrom, start, "end", strand, n_exon::INT AS exon_count, is_mono, array_to_string(list_transform(sj, lambda j: j.d || '-' || j.a), '|') AS junctions FROM tx""")
def ref_s2_s3_p8_gtf_transcripts(c: Files) -> DataFrame:
    tx = gtf.transcripts(gtf.read_gtf(c.spark, c.gtf))
    return tx.select("tx_id", "gene_id", "chrom", "start", "end", "strand", F.size("exons").alias("exon_count"), "is_mono", g.junction_text(F.col("sj")).alias("junctions"))


@query("SELECT gene_id, gene_name, gene_type, chrom, start, \"end\", sites FROM gene")
def ref_s5_gtf_genes(c: Files) -> DataFrame:
    return gtf.genes(gtf.read_gtf(c.spark, c.gtf))


@query("SELECT 'TID=' || tx_id || ';GID=' || gene_id AS info, md5(chrom || ':' || array_to_string(list_transform(sj, lambda j: j.d || '-' || j.a), '|')) AS pid FROM tx")
def ref_p9_p20_gtf_profile(c: Files) -> DataFrame:
    """Annotated transcripts as a profile file, read back with their ids."""
    path = c.place("annotation")
    api.write_profile(api.profile_gtf(c.spark, c.gtf, True, True), path)
    reads = profile_text.reads_of(profile_text.read_profiles(c.spark, path).withColumn("sample_id", F.lit(0)))
    return reads.select(F.array_join(F.transform("info", lambda p: F.concat_ws("=", p["k"], p["v"])), ";").alias("info"), "pid")


@query("""SELECT pid, "left", "right", strand, coalesce(supp_chrom || ':' || supp_s || '-' || supp_e, '') AS supp, count(*) AS n FROM reads GROUP BY ALL""")
def ref_s1_p2_p3_alignments(c: Files) -> DataFrame:
    reads = build.collapse(api.profile_alignments(c.spark, c.sam))
    supp = F.array_join(F.transform("supp", lambda x: F.concat(x["chrom"], F.lit(":"), x["s"], F.lit("-"), x["e"])), ",")
    return reads.groupBy("pid", "left", "right", "strand", supp.alias("supp")).agg(F.sum("n").alias("n"))


@query("""SELECT DISTINCT ON (rn) rn, pid FROM (SELECT pid, sample_id, "left", "right", 'r.' || sample_id || '.' || left(pid, 12) || '.' || "left" || '.' || "right" AS rn FROM reads)""")
def ref_p20_read_names(c: Files) -> DataFrame:
    reads = build.with_signature(alignments.profile_alignments(alignments.read_sam(c.spark, c.sam), rname=True))
    return reads.select(F.regexp_replace(F.col("info")[0]["v"], r"\.[0-9]+$", "").alias("rn"), "pid").distinct()


@query("SELECT 'S' || sample_id AS sample, pid, junctions, evidence, evidence AS n_reads FROM profile")
def ref_s6_s7_s8_o1_profile_files(c: Files) -> DataFrame:
    samples = tables.read_manifest(c.spark, c.manifest)
    out = None
    for r in samples.orderBy("sample_id").collect():
        df = profile_text.read_profiles(c.spark, r["path"]).withColumn("sample", F.lit(r["name"]))
        out = df if out is None else out.unionByName(df)
    junctions = g.junction_text(F.col("sj"))
    return out.select("sample", build.signature(F.col("chrom"), junctions).alias("pid"), junctions.alias("junctions"), "evidence", F.size("reads").cast("bigint").alias("n_reads"))


@query("SELECT i::BIGINT AS sample_id, 'S' || i AS name, CASE WHEN i % 2 = 1 THEN 'tissue' ELSE 'blood' END AS tissue FROM range(8) t(i)")
def ref_s9_s10_s11_manifest(c: Files) -> DataFrame:
    meta = tables.validate_meta(tables.read_manifest(c.spark, c.manifest))
    return meta.select("sample_id", "name", F.col("attrs")["Tissue"].alias("tissue"))


@query("SELECT 'S' || i AS name, CASE WHEN i % 2 = 1 THEN 'tissue' ELSE 'blood' END AS tissue FROM range(8) t(i)")
def ref_s10_meta_file(c: Files) -> DataFrame:
    path = c.place("meta")
    tables.write_meta(tables.read_manifest(c.spark, c.manifest), path)
    parts = c.spark.read.text(path).filter(~F.col("value").startswith("Sample\t")).select(F.split("value", "\t").alias("f"))
    return parts.select(F.col("f")[0].alias("name"), F.col("f")[2].alias("tissue"))


@query("SELECT gene_id AS id, chrom, start AS a, \"end\" AS b FROM gene")
def ref_s14_s15_position_strings(c: Files) -> DataFrame:
    """Pairs of positions written as text and parsed again, on the driver, as a command line's are."""
    rows = [(r["gene_id"], *tables.parse_junction(f"chr{r['chrom']}:{r['end']},{r['start']}")) for r in c.gene.select("gene_id", "chrom", "start", "end").collect()]
    for _, chrom, a, b in rows:
        assert tables.parse_breakpoints(f"{chrom}:{a},chr{chrom}:{b}") == (chrom, a, chrom, b)
        assert tables.parse_regions(f"{chrom}:{a}-{b},{chrom}:{b}-{b}") == (chrom, a, b, chrom, b, b)
    return c.spark.createDataFrame(rows, "id string, chrom string, a bigint, b bigint")


# ---- the index


@query("SELECT pid, chrom, junctions, n_sites, total_evidence, n_samples, is_mono FROM pnir")
def ref_s16_s17_o2_index_records(c: Files) -> DataFrame:
    return api.view(c.index, "records")


@query("SELECT chrom, pos, pid, n_sites, kind FROM site WHERE chrom IN ('C1', 'C3') AND pos BETWEEN 200000 AND 1500000")
def ref_s19_s20_s22_index_postings(c: Files) -> DataFrame:
    return c.index.postings(["C1", "C3"], 200_000, 1_500_000).select("chrom", "pos", "pid", "n_sites", "kind")


@query("SELECT 'S' || sample_id AS name, total_evidence FROM totals")
def ref_s24_index_samples(c: Files) -> DataFrame:
    return api.open_index(c.spark, c.index.path).sample.select("name", "total_evidence")


@query("SELECT chrom, count(*) AS n_records FROM pnir GROUP BY chrom")
def ref_s29_view(c: Files) -> DataFrame:
    return api.view(c.index, "chromosomes")


# ---- the commands


@query()
def ref_x2_x6_isoform_command(c: Files) -> DataFrame:
    """From GTF and profile files through the index to isoform rows."""
    return _isoform_columns(api.query_isoform(c.index, c.transcripts, min_read=2))


SQL["ref_x2_x6_isoform_command"] = _recursive(_EM + _ROWS + "SELECT * FROM isoform")


@query()
def ref_s25_s26_o4_isoform_file(c: Files) -> DataFrame:
    """The isoform result written as text and read again: counts of each cell."""
    path = c.place("isoform")
    api.write_isoform(c.index, api.query_isoform(c.index, c.transcripts, min_read=2), path)
    rows, _, _, _ = tables.read_result_table(c.spark, path)
    x = lambda i: tables.cell_part(F.col("cell"), i)
    return rows.select("trans_id", F.col("start").cast("bigint").alias("start"), F.col("detected(total:fsm:em)").alias("detected"), "sample", x(3).cast("bigint").alias("fsm"), F.round(x(5), 3).alias("em")).filter("fsm > 0 or em > 0.01")


SQL["ref_s25_s26_o4_isoform_file"] = _recursive(_EM + _ROWS + "SELECT trans_id, start, detected, 'S' || sample_id AS sample, fsm, em_shown AS em FROM isoform WHERE fsm > 0 OR em_shown > 0.01")


@query(_FULL.format(tol=10) + """, half AS (SELECT tx_idx, sample_id // 4 AS h, count(*) FILTER (fsm > 0) AS n FROM fev GROUP BY ALL),
ranked AS (SELECT tx_idx, fsm, total_evidence, row_number() OVER (PARTITION BY tx_idx ORDER BY fsm DESC) AS i FROM fev JOIN totals USING (sample_id)),
conf AS (SELECT tx_idx, count(*) / 8.0 * exp(avg(ln(1e6 * fsm / total_evidence))) * (1 - (2.0 * sum(i * fsm) / (8 * sum(fsm)) - 9.0 / 8)) AS confidence FROM ranked GROUP BY tx_idx)
SELECT tx_id, CASE WHEN n > 0 THEN 'yes:yes:no' ELSE 'no:no:no' END AS detected, n || ':' || n || ':0/8' AS positives, round(coalesce(confidence, 0), 3) AS confidence
FROM tx LEFT JOIN conf USING (tx_idx) JOIN (SELECT tx.tx_idx, coalesce(sum(n), 0)::BIGINT AS n FROM tx LEFT JOIN half USING (tx_idx) GROUP BY tx.tx_idx) USING (tx_idx)""")
def ref_u6_merge_isoform(c: Files) -> DataFrame:
    """Two result files of four samples each, merged: positives, detected and confidence anew, over counts of full matches."""
    from .reference import _full

    cells = _full(c).select("tx_idx", F.concat(F.lit("S"), "sample_id").alias("sample"), F.concat_ws(":", F.lit("0"), "fsm", F.lit("0"), "fsm", F.lit("0:0:")).alias("cell"))
    totals = {f"S{r['sample_id']}": r["total_evidence"] for r in c.totals.collect()}
    paths = []
    for names in ([f"S{i}" for i in range(4)], [f"S{i}" for i in range(4, 8)]):
        wide = c.tx.select("tx_idx", "tx_id").join(tables.wide(cells.filter(F.col("sample").isin(names)), ["tx_idx"], "sample", "cell", names, "0:0:0:0:0:0:"), "tx_idx", "left").fillna("0:0:0:0:0:0:", names)
        n = sum((F.when(tables.cell_part(F.col(s), 1) > 0, 1).otherwise(0) for s in names), F.lit(0))
        wide = wide.withColumn("n_pos_samples", F.concat_ws(":", n, n, F.lit(f"0/{len(names)}")))
        paths.append(c.place("half"))
        tables.write_result_table(wide, ["tx_id", "n_pos_samples"], names, {s: totals.get(s, 0) for s in names}, "CPM:COUNT:FSM_CPM:FSM_COUNT:EM_CPM:EM_COUNT:INFO", paths[-1], order="tx_idx")
    merged = api.merge_outputs(c.spark, *paths)
    return merged.select("tx_id", "detected", "positives", F.round("confidence", 3).alias("confidence")).distinct()


@query(""", q AS (SELECT DISTINCT chrom || ':' || j.d || ':' || j.a AS id, chrom, j.d AS l, j.a AS r FROM txj),
rep AS (SELECT id, pid, total_evidence FROM q JOIN pnir p USING (chrom) WHERE len(list_filter(p.sj, lambda j: abs(j.d - l) < 10 AND abs(j.a - r) < 10)) > 0)
SELECT id, pid, total_evidence AS evidence FROM rep WHERE total_evidence >= 3""")
def ref_x_splice_command(c: Files) -> DataFrame:
    from .reference import _splice_queries

    return api.query_splice(c.index, _splice_queries(c), min_read=3).select("id", "pid", "evidence")


@query(_CAND + """, e AS (SELECT gene_a, gene_b, sum(n)::BIGINT AS total_evidence FROM pairs JOIN (SELECT cand, n FROM cand) USING (cand) GROUP BY ALL),
m AS (SELECT gene_a, gene_b, avg(CASE WHEN direction = 'ab' THEN list_min(main) END) AS aml, avg(CASE WHEN direction = 'ab' THEN list_max(main) END) AS amh, avg(CASE WHEN direction = 'ab' THEN list_min(supp) END) AS asl,
  avg(CASE WHEN direction = 'ab' THEN list_max(supp) END) AS ash, avg(CASE WHEN direction = 'ba' THEN list_min(main) END) AS bml, avg(CASE WHEN direction = 'ba' THEN list_max(main) END) AS bmh,
  avg(CASE WHEN direction = 'ba' THEN list_min(supp) END) AS bsl, avg(CASE WHEN direction = 'ba' THEN list_max(supp) END) AS bsh FROM pairs GROUP BY ALL)
SELECT gene_a, gene_b, total_evidence, aml IS NOT NULL AND bml IS NOT NULL AS two_strand FROM e JOIN m USING (gene_a, gene_b) WHERE total_evidence >= 5
  AND (aml IS NULL OR bml IS NULL OR (aml <= bsh AND bsl <= amh AND asl <= bmh AND bml <= ash))""")
def ref_x5_discovery_command(c: Files) -> DataFrame:
    found = api.discover_fusions(c.index, gtf.genes(gtf.read_gtf(c.spark, c.gtf)), min_read=5, require_both=False)
    return found.select("gene_a", "gene_b", "total_evidence", "two_strand")


@query("""SELECT 'S' || sample_id AS sample_name, chrom AS chr1, "left" AS start1, "right" AS end1, supp_chrom AS chr2, supp_s AS start2, supp_e AS end2, count(*) AS n FROM reads r
WHERE chrom = 'C2' AND supp_chrom = 'C3' AND (supp_s BETWEEN 305000 - 4000 AND 305000 + 4000 OR supp_e BETWEEN 305000 - 4000 AND 305000 + 4000)
AND EXISTS (FROM site t WHERE t.pid = r.pid AND t.chrom = 'C2' AND pos BETWEEN 200000 AND 215000) GROUP BY ALL""")
def ref_x4_f10_region_command(c: Files) -> DataFrame:
    found = api.query_fusion_region(c.index, "C2:200000-215000,C3:301000-309000").filter("side = 'left'")
    rows = fusion.region_rows(found, c.index.pnir, c.index.sample)
    return rows.groupBy("sample_name", "chr1", "start1", "end1", "chr2", "start2", "end2").agg(F.count("*").alias("n"))


@query("""SELECT g.gene_id AS gene, tx_id FROM gene g JOIN tx ON tx.chrom = g.chrom AND tx.start <= g."end" AND tx."end" >= g.start""")
def ref_j19_annotation_overlap(c: Files) -> DataFrame:
    genes = gtf.genes(gtf.read_gtf(c.spark, c.gtf)).select("chrom", F.col("gene_id").alias("gene"), F.col("start").alias("g_s"), F.col("end").alias("g_e"))
    tx = c.tx.select("chrom", "tx_id", F.col("start").alias("t_s"), F.col("end").alias("t_e"))
    return rangejoin.interval_join(tx, genes, "t_s", "t_e", "g_s", "g_e", 1 << 14).select("gene", "tx_id")


@query("""SELECT pid, min("left") AS start_min, max("right") AS end_max, count(*) AS evidence FROM reads WHERE pid IN (SELECT pid FROM pnir p, (SELECT chrom, j FROM txj ORDER BY chrom, j.d, j.a LIMIT 1) q
  WHERE p.chrom = q.chrom AND len(list_filter(p.sj, lambda x: abs(x.d - q.j.d) < 10 AND abs(x.a - q.j.a) < 10)) > 0) GROUP BY pid""")
def ref_s31_o6_splice_document(c: Files) -> DataFrame:
    """The document of the first junction of the annotation, taken apart again."""
    from .reference import _splice_queries

    # a top-1 report: one document is about one junction
    q = _splice_queries(c).orderBy("chrom", "left", "right").limit(1).first()
    doc = json.loads(api.splice_document(c.index, gtf.genes(gtf.read_gtf(c.spark, c.gtf)), f"{q['chrom']}:{q['left']},{q['right']}").first()["document"])
    starts = [x["start_min"] for x in doc["isoforms"]]
    assert starts == sorted(starts) and doc["genes"]
    return c.spark.createDataFrame([(x["pid"], x["start_min"], x["end_max"], sum(y["evidence"] for y in x["cells"])) for x in doc["isoforms"]], "pid string, start_min bigint, end_max bigint, evidence bigint")


@query("SELECT id, chr1, pos1, chr2, pos2, CASE WHEN pos1 < pos2 THEN 'chr' || chr1 || '|' || chr2 ELSE '' END AS rest FROM (SELECT 'F' || g AS id, 'C' || (g % 5) AS chr1, 100000 * g + 2000 AS pos1, 'C' || ((g + 1) % 5) AS chr2, 100000 * (g + 1) + 2000 AS pos2 FROM (SELECT DISTINCT g FROM tx) WHERE g % 2 = 0 AND g + 1 IN (SELECT g FROM tx))")
def ref_s13_unordered_bed(c: Files) -> DataFrame:
    """Breakpoints of a BED file as they stand, without putting the smaller one first."""
    q = _fusion_queries(c)
    path = c.place("bed")
    q.select(F.concat_ws("\t", "chr2", "pos2", F.concat(F.lit("chr"), "chr1"), "pos1", "id", F.concat_ws("|", F.concat(F.lit("chr"), "chr1"), "chr2")).alias("value")).write.text(path)
    df = tables.bed_pairs(c.spark.read.text(path), ordered=False)
    return df.select("id", F.col("chr2").alias("chr1"), F.col("pos2").alias("pos1"), F.col("chr1").alias("chr2"), F.col("pos1").alias("pos2"), "rest")
