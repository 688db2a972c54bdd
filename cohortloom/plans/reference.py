"""Queries on the operators of cohort analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genome import junction_sites, junction_text
from ..operators import build, em, fusion, match, quantify, splice, stats
from ..operators.rangejoin import cross_keys, range_join
from ..session import durable, from_nth
from .projection import BASE, Cohort

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Cohort as a query, with the SQL that follows the common CTEs."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Cohort(spark, d))
        if sql:
            SQL[f.__name__] = BASE + sql
        return f

    return add


# ---- build


@query("SELECT sample_id, pid, chrom, junctions, evidence FROM profile")
def ref_a1_profiles(c: Cohort) -> DataFrame:
    return c.profile.select("sample_id", "pid", "chrom", junction_text(F.col("sj")).alias("junctions"), "evidence")


@query("SELECT pid, chrom, junctions, n_sites, total_evidence, n_samples, is_mono FROM pnir")
def ref_a2_cohort(c: Cohort) -> DataFrame:
    return c.pnir.select("pid", "chrom", junction_text(F.col("sj")).alias("junctions"), "n_sites", "total_evidence", "n_samples", "is_mono")


@query("SELECT pid, junctions, count(*) AS evidence FROM reads WHERE sample_id IN (0, 1) GROUP BY ALL")
def ref_a3_merge_replicates(c: Cohort) -> DataFrame:
    df = build.merge_replicates(c.profile.filter("sample_id = 0"), c.profile.filter("sample_id = 1"))
    return df.select("pid", junction_text(F.col("sj")).alias("junctions"), "evidence")


@query("SELECT * FROM totals")
def ref_a4_sample_totals(c: Cohort) -> DataFrame:
    return c.totals


@query("SELECT * FROM site")
def ref_p11_site_postings(c: Cohort) -> DataFrame:
    return c.site


@query("SELECT chrom, pos, count(DISTINCT pid) AS n_pid, count(*) AS n FROM site GROUP BY ALL")
def ref_a18_pointers_by_position(c: Cohort) -> DataFrame:
    return c.site.groupBy("chrom", "pos").agg(F.countDistinct("pid").alias("n_pid"), F.count("*").alias("n"))


@query("SELECT chrom, count(*) AS n FROM pnir GROUP BY chrom")
def ref_a19_records_by_chrom(c: Cohort) -> DataFrame:
    return c.pnir.groupBy("chrom").count().withColumnRenamed("count", "n")


@query("SELECT pid FROM pnir WHERE is_mono")
def ref_p12_mono_records(c: Cohort) -> DataFrame:
    return c.pnir.filter("is_mono").select("pid")


@query("SELECT pid, sj[1].d AS first_donor, list_transform(range(1, len(sj)), lambda i: sj[i + 1].d - sj[i].a) AS inner_exons FROM pnir WHERE len(sj) > 1")
def ref_p17_inner_exons(c: Cohort) -> DataFrame:
    inner = F.transform(from_nth("sj", 2), lambda j, i: j["d"] - F.get("sj", i)["a"])
    return c.pnir.filter(F.size("sj") > 1).select("pid", F.col("sj")[0]["d"].alias("first_donor"), inner.alias("inner_exons"))


@query("SELECT tx_idx, chrom, start, \"end\", strand, n_exon AS exon_count, list_sum(list_transform(exons, lambda x: x.e - x.s))::BIGINT AS tx_length, \"end\" - start AS coord_length FROM tx ORDER BY chrom, start, \"end\"")
def ref_s4_p10_transcripts(c: Cohort) -> DataFrame:
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda s, x: s + x["e"] - x["s"])
    return c.tx.select("tx_idx", "chrom", "start", "end", "strand", F.size("exons").alias("exon_count"), length.alias("tx_length"), (F.col("end") - F.col("start")).alias("coord_length")).orderBy("chrom", "start", "end")


@query("SELECT sample_id, tx_idx, pid FROM (SELECT 0 AS sample_id, tx_idx, md5(chrom || ':' || array_to_string(list_transform(sj, lambda j: j.d || '-' || j.a), '|')) AS pid FROM tx)")
def ref_p9_transcripts_as_reads(c: Cohort) -> DataFrame:
    return build.with_signature(c.tx.withColumn("sample_id", F.lit(0))).select("sample_id", "tx_idx", "pid")


# ---- lookups


@query("SELECT DISTINCT tx_idx, sj_no, side, pid FROM txs JOIN site ON site.chrom = txs.chrom AND pos = q_pos WHERE kind = 'sj'")
def ref_j1_exact_lookup(c: Cohort) -> DataFrame:
    sites = match.tx_sites(c.tx)
    return sites.join(c.site.filter("kind = 'sj'").select("chrom", F.col("pos").alias("q_pos"), "pid"), ["chrom", "q_pos"]).select("tx_idx", "sj_no", "side", "pid")


@query("SELECT tx_idx, sj_no, side, pid, n_sites FROM hits")
def ref_j2_flank_lookup(c: Cohort) -> DataFrame:
    return c.by_transcript(c.hits).select("tx_idx", "sj_no", "side", "pid", "n_sites")


@query("SELECT DISTINCT tx_idx, pid, kind FROM tx JOIN site ON site.chrom = tx.chrom AND pos BETWEEN start AND \"end\"")
def ref_j3_range_scan(c: Cohort) -> DataFrame:
    # transcripts share intervals: each is looked up once; a transcript is one row with all its intervals, so that its hits are distinct before they are written out
    tx = durable(c.tx.groupBy("tx_idx").agg(F.array_sort(F.collect_set(F.struct("chrom", "start", "end"))).alias("at")))
    q = tx.select("at").distinct().select("at", F.inline("at"))
    hits = range_join(q, c.site, F.col("start"), F.col("end"), "pos", 1 << 12).select("at", "pid", "kind").distinct()
    return cross_keys(tx, durable(hits), "at")


@query("SELECT tx_idx, sj_no, side, count(DISTINCT pid) AS n FROM hits GROUP BY ALL")
def ref_j4_hits_per_site(c: Cohort) -> DataFrame:
    return c.by_transcript(c.hits.groupBy("cid", "sj_no", "side").agg(F.countDistinct("pid").alias("n")))


@query("SELECT tx_idx, pid FROM hits JOIN tx USING (tx_idx) GROUP BY tx_idx, pid HAVING count(DISTINCT q_pos) = any_value(len(list_distinct(flatten(list_transform(sj, lambda j: [j.d, j.a])))))")
def ref_j5_u1_hit_by_all(c: Cohort) -> DataFrame:
    n = c.chains.select("cid", F.size(junction_sites(F.col("sj"))).alias("n_pos"))
    return c.by_transcript(match.at_least(c.hits.join(n, "cid"), "cid", 0, F.col("n_pos")).select("cid", "pid"))


@query("SELECT * FROM fsm")
def ref_j6_full_matches(c: Cohort) -> DataFrame:
    return c.by_transcript(c.fsm)


@query("SELECT gene_id, pid, count(DISTINCT q) AS n_hit FROM (SELECT gene_id, chrom, unnest(sites) AS q FROM gene) g JOIN site s ON s.chrom = g.chrom AND abs(pos - q) <= 10 WHERE kind = 'sj' GROUP BY ALL HAVING count(DISTINCT q) >= 2")
def ref_j7_at_least_k(c: Cohort) -> DataFrame:
    q = c.gene.select("gene_id", "chrom", F.size("sites").alias("n"), F.explode("sites").alias("q_pos"))
    return match.at_least(match.site_hits(q, c.site, 10), "gene_id", 2, F.col("n"))


@query("SELECT * FROM partial0")
def ref_j8_partial_matches(c: Cohort) -> DataFrame:
    return c.by_transcript(match.partial_matches(c.hits, "cid"))


@query("SELECT * FROM partials")
def ref_j9_u3_unclaimed(c: Cohort) -> DataFrame:
    return c.kept(match.partial_matches(c.hits, "cid")).select("tx_idx", "pid")


@query("SELECT * FROM chains")
def ref_j10_chains(c: Cohort) -> DataFrame:
    return c.kept(match.run_matches(c.chains, c.pnir, 10)).select("tx_idx", "pid", "first", "n_sj")


@query('SELECT tx_idx, pid, "full" FROM mono WHERE "full" OR inside')
def ref_j11_j12_mono_matches(c: Cohort) -> DataFrame:
    return c.mono.select("tx_idx", "pid", "full")


@query("SELECT tx_idx, f.pid, chrom, total_evidence, junctions FROM fsm f JOIN pnir USING (pid)")
def ref_j13_records_of_matches(c: Cohort) -> DataFrame:
    return c.by_transcript(c.fsm.join(c.pnir, "pid")).select("tx_idx", "pid", "chrom", "total_evidence", junction_text(F.col("sj")).alias("junctions"))


@query("SELECT tx_idx FROM (SELECT tx_idx, unnest(range(first, first + n_sj)) AS k FROM chains) JOIN tx USING (tx_idx) GROUP BY tx_idx HAVING count(DISTINCT k) = any_value(len(sj))")
def ref_a20_covered(c: Cohort) -> DataFrame:
    runs, atoms = em.kept_runs(match.run_matches(c.chains, c.pnir, 10), c.fsm, c.kinds.filter("not is_mono"))
    covered = em.coverage(runs, c.chains.select("cid", F.size("sj").alias("n_sj")))
    return atoms.join(covered.select("cid", "covered"), "cid").filter("atom < covered").select("tx_idx")


# ---- windows over intervals


@query("SELECT tx_idx, chrom, group_id FROM grouped")
def ref_w1_overlap_groups(c: Cohort) -> DataFrame:
    return match.overlap_groups(c.tx).select("tx_idx", "chrom", "group_id")


@query("""SELECT s.chrom, seg_start, seg_end, tx_idx FROM (SELECT chrom, p AS seg_start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS seg_end
  FROM (SELECT DISTINCT chrom, unnest([start, "end"]) AS p FROM tx)) s JOIN tx ON tx.chrom = s.chrom AND start <= seg_start AND "end" >= seg_end""")
def ref_w2_elementary_segments(c: Cohort) -> DataFrame:
    return match.elementary_segments(c.tx, "chrom", "start", "end", "tx_idx")


@query("SELECT tx_idx, row_number() OVER (PARTITION BY gene_id ORDER BY start, \"end\", tx_idx)::INT AS ordinal, start - lag(\"end\") OVER (PARTITION BY gene_id ORDER BY start, \"end\", tx_idx) AS gap FROM tx")
def ref_w5_ordinals(c: Cohort) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("gene_id").orderBy("start", "end", "tx_idx")
    return c.tx.select("tx_idx", F.row_number().over(w).alias("ordinal"), (F.col("start") - F.lag("end").over(w)).alias("gap"))


@query('SELECT a.gene_id AS a, b.gene_id AS b FROM gene a JOIN gene b ON a.chrom = b.chrom AND a.start <= b."end" + 600000 AND b.start <= a."end" + 600000 AND a.gene_id < b.gene_id')
def ref_j20_gene_overlaps(c: Cohort) -> DataFrame:
    from ..operators.rangejoin import interval_join

    pad = c.gene.select("chrom", F.col("gene_id").alias("a"), F.col("start").alias("a_s"), (F.col("end") + 600000).alias("a_e"))
    other = pad.select("chrom", F.col("a").alias("b"), F.col("a_s").alias("b_s"), F.col("a_e").alias("b_e"))
    return interval_join(pad, other, "a_s", "a_e", "b_s", "b_e", 1 << 17).filter("a < b").select("a", "b")


# ---- quantification

_FULL = """, full_pairs AS (SELECT tx_idx, pid FROM fsm UNION ALL SELECT tx_idx, pid FROM mono WHERE "full"),
fev AS (SELECT tx_idx, sample_id, sum(n)::BIGINT AS fsm FROM full_pairs JOIN shapes USING (pid) JOIN tx t USING (tx_idx) WHERE t.is_mono OR
  ("left" >= start - {tol} AND "left" <= start + CASE WHEN t.strand = '+' THEN 2000 ELSE 8000 END AND "right" >= "end" - CASE WHEN t.strand = '+' THEN 8000 ELSE 2000 END AND "right" <= "end" + {tol}) GROUP BY ALL),
fcpm AS (SELECT *, 1e6 * fsm / total AS cpm FROM fev JOIN (SELECT sample_id, sum(fsm) AS total FROM fev GROUP BY sample_id) USING (sample_id))
"""


def _full(c: Cohort, **windows) -> DataFrame:
    kinds = c.kinds.dropDuplicates(["kid"]).drop("tx_idx")
    _, full, _ = quantify.full_pairs(kinds, c.chains, c.pnir, c.site, 10)
    kid = lambda df: df.withColumnRenamed("kid", "tx_idx")
    counted = match.full_evidence(kid(full), c.shapes, kid(kinds), **windows).withColumnRenamed("tx_idx", "kid")
    return c.kinds.select("tx_idx", "kid").join(counted, "kid").select("tx_idx", "sample_id", "fsm")


@query(_FULL.format(tol=10) + "SELECT tx_idx, sample_id, fsm FROM fev")
def ref_a7_full_evidence(c: Cohort) -> DataFrame:
    return _full(c)


@query(_FULL.format(tol=3) + "SELECT tx_idx, sample_id, fsm FROM fev")
def ref_p13_narrow_windows(c: Cohort) -> DataFrame:
    return _full(c, tolerance=3)


@query(_FULL.format(tol=10) + "SELECT tx_idx, sample_id, fsm, round(cpm, 6) AS cpm FROM fcpm")
def ref_a11_full_cpm(c: Cohort) -> DataFrame:
    cells = stats.abundance_cells(_full(c), _no_em(c))
    return stats.with_cpm(cells, stats.query_totals(cells)).select("tx_idx", "sample_id", "fsm", F.round("fsm_cpm", 6).alias("cpm"))


def _no_em(c: Cohort) -> DataFrame:
    return c.spark.createDataFrame([], "tx_idx bigint, sample_id bigint, em double")


@query(_FULL.format(tol=10) + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY tx_idx ORDER BY fsm DESC) AS i FROM fcpm)
SELECT tx_idx, round(count(*) / 8.0 * exp(avg(ln(cpm))) * (1 - (2.0 * sum(i * fsm) / (8 * sum(fsm)) - 9.0 / 8)), 4) AS confidence FROM ranked GROUP BY tx_idx""")
def ref_a10_w4_confidence(c: Cohort) -> DataFrame:
    cells = stats.abundance_cells(_full(c), _no_em(c))
    full = stats.with_cpm(cells, stats.query_totals(cells))
    return stats.confidence(full, "tx_idx", "fsm", "fsm_total", 8).withColumn("confidence", F.round("confidence", 4))


def _cells(c: Cohort, opts: em.Settings = em.Settings()) -> DataFrame:
    return c.quantified(quantify.Options(em=opts)).cells


# the damped steps of a whole group, mono-exons too, until all of it has settled
_EM = _FULL.format(tol=10) + """, ev AS (SELECT pid, sample_id, evidence FROM profile), ok AS (SELECT tx_idx FROM (SELECT tx_idx, unnest(range(first, first + n_sj)) AS k FROM chains) JOIN tx USING (tx_idx)
  GROUP BY tx_idx HAVING count(DISTINCT k) = any_value(len(sj))),
multi AS (SELECT c.tx_idx, g.chrom || ':' || group_id AS grp, g.chrom || ':' || group_id || ':' || pid AS cls, pid, 1.0::DOUBLE / (len(g.sj) + 2) AS w FROM chains c JOIN grouped g USING (tx_idx) JOIN ok USING (tx_idx)),
monos AS (SELECT tx_idx, g.chrom || ':' || group_id AS grp, 'mono' || tx_idx AS cls, sample_id, sum(evidence)::DOUBLE AS cov FROM mono m JOIN grouped g USING (tx_idx) JOIN ev USING (pid) WHERE inside AND NOT "full" GROUP BY ALL),
em_in AS MATERIALIZED (SELECT tx_idx, grp, cls, sample_id, evidence::DOUBLE AS cov, w FROM multi JOIN ev USING (pid) UNION ALL SELECT tx_idx, grp, cls, sample_id, cov, 1.0::DOUBLE FROM monos),
steps AS (SELECT DISTINCT 0 AS it, grp, tx_idx, sample_id, 0.1::DOUBLE AS a, false AS done FROM em_in
  UNION ALL SELECT it, grp, tx_idx, sample_id, na, max(abs(na - a) / CASE WHEN abs(a) < 1e-6 THEN 1 ELSE abs(a) END) OVER (PARTITION BY grp) <= 0.01 FROM (
    SELECT x.it + 1 AS it, grp, tx_idx, sample_id, a, 0.7::DOUBLE * a + 0.3::DOUBLE * sum(cov * a * w / total) AS na FROM (
      SELECT s.it, s.grp, s.tx_idx, s.sample_id, s.a, e.cov, e.w, sum(s.a * e.w) OVER (PARTITION BY e.cls, s.sample_id) AS total
      FROM steps s JOIN em_in e ON e.tx_idx = s.tx_idx AND e.sample_id = s.sample_id WHERE NOT s.done AND s.it < 100) x GROUP BY x.it, grp, tx_idx, sample_id, a)),
em AS (SELECT tx_idx, sample_id, a AS em FROM (SELECT *, max(it) OVER (PARTITION BY grp) AS last FROM steps) WHERE it = last),
cell AS (SELECT tx_idx, sample_id, coalesce(fsm, 0) AS fsm, coalesce(em, 0) AS em, CASE WHEN em >= 1e-4 THEN em ELSE 0 END AS shown FROM fev FULL JOIN em USING (tx_idx, sample_id)),
tot AS (SELECT sample_id, sum(fsm)::BIGINT AS fsm_total, sum(em) AS em_total, sum(fsm + em) AS all_total FROM cell GROUP BY sample_id)
"""


def _recursive(sql: str) -> str:
    return BASE.replace("WITH", "WITH RECURSIVE", 1) + sql


@query()
def ref_a8_em(c: Cohort) -> DataFrame:
    return _cells(c).filter("em > 0").select("tx_idx", "sample_id", F.round("em", 4).alias("em"))


SQL["ref_a8_em"] = _recursive(_EM + "SELECT tx_idx, sample_id, round(em, 4) AS em FROM em WHERE em > 0")


_EM1 = """, ev AS (SELECT pid, sample_id, evidence FROM profile), ok AS (SELECT tx_idx FROM (SELECT tx_idx, unnest(range(first, first + n_sj)) AS k FROM chains) JOIN tx USING (tx_idx)
  GROUP BY tx_idx HAVING count(DISTINCT k) = any_value(len(sj))),
m AS (SELECT c.tx_idx, g.chrom, group_id, pid, 1.0 / (len(g.sj) + 2) AS w FROM chains c JOIN grouped g USING (tx_idx) JOIN ok USING (tx_idx)),
t AS (SELECT chrom, group_id, pid, sum(w) AS total FROM m GROUP BY ALL),
multi AS (SELECT tx_idx, sample_id, 0.3 * sum(evidence * w / total) + 0.07 AS em FROM m JOIN t USING (chrom, group_id, pid) JOIN ev USING (pid) GROUP BY ALL),
monos AS (SELECT tx_idx, sample_id, 0.3 * sum(evidence) + 0.07 AS em FROM mono JOIN ev USING (pid) WHERE inside AND NOT "full" GROUP BY ALL)
SELECT tx_idx, sample_id, round(em, 3) AS em FROM (SELECT * FROM multi UNION ALL SELECT * FROM monos)"""


@query(_EM1)
def ref_a8_em_one_step(c: Cohort) -> DataFrame:
    return _cells(c, em.Settings(max_iter=1)).filter("em > 0").select("tx_idx", "sample_id", F.round("em", 3).alias("em"))


@query('SELECT tx_idx, sample_id, sum(evidence)::BIGINT AS cov, count(*) AS n_records, (sum(span) // count(*))::BIGINT AS effective_length FROM mono JOIN profile USING (pid) WHERE inside AND NOT "full" GROUP BY ALL')
def ref_a9_mono_classes(c: Cohort) -> DataFrame:
    df = c.mono.filter("not full").join(c.profile, "pid").groupBy("tx_idx", "sample_id")
    return df.agg(F.sum("evidence").alias("cov"), F.count("*").alias("n_records"), F.expr("sum(span) div count(*)").alias("effective_length"))


@query()
def ref_a5_query_totals(c: Cohort) -> DataFrame:
    return stats.query_totals(_cells(c)).select("sample_id", "fsm_total", F.round("em_total", 3).alias("em_total"), F.round("all_total", 3).alias("all_total"))


SQL["ref_a5_query_totals"] = _recursive(_EM + "SELECT sample_id, fsm_total, round(em_total, 3) AS em_total, round(all_total, 3) AS all_total FROM tot")


@query()
def ref_a6_sample_summary(c: Cohort) -> DataFrame:
    return stats.sample_summary(_cells(c), c.tx.count())


SQL["ref_a6_sample_summary"] = _recursive(_EM + """SELECT sample_id, count(*) FILTER (fsm >= 1) AS n_fsm, count(*) FILTER (em >= 1) AS n_em, count(*) FILTER (fsm >= 1 OR em >= 1) AS n_any,
  round(count(*) FILTER (fsm >= 1 OR em >= 1) * 100.0 / (SELECT count(*) FROM tx), 4) AS pct_any FROM cell GROUP BY sample_id""")


@query()
def ref_p14_positives(c: Cohort) -> DataFrame:
    return stats.positives(_cells(c), 2)


SQL["ref_p14_positives"] = _recursive(_EM + "SELECT tx_idx, count(*) FILTER (fsm + em >= 2) AS n_all, count(*) FILTER (fsm >= 2) AS n_fsm, count(*) FILTER (em >= 2) AS n_em FROM cell GROUP BY tx_idx")


@query()
def ref_p19_gated_em(c: Cohort) -> DataFrame:
    cells = c.quantified(quantify.Options(min_em_abundance=2.0)).cells
    return cells.filter("em > 0 and em_shown = 0").select("tx_idx", "sample_id", F.round("em", 4).alias("em"))


SQL["ref_p19_gated_em"] = _recursive(_EM + "SELECT tx_idx, sample_id, round(em, 4) AS em FROM em WHERE em < 2")


def _isoform_columns(rows: DataFrame, *more: str) -> DataFrame:
    rounded = [F.round(x, 3).alias(x) for x in ("confidence", "em_shown", "all_cpm", "fsm_cpm", "em_cpm")]
    return rows.select("chrom", "start", "end", "length", "exon_count", "trans_id", "gene_id", "min_read", "detected", "n_pos_samples", *more, "sample_id", "fsm", *rounded)


@query()
def ref_x2_isoform_rows(c: Cohort) -> DataFrame:
    return _isoform_columns(stats.isoform_rows(c.tx, _cells(c), 8, 2))


_ROWS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY tx_idx ORDER BY fsm + em DESC) AS i FROM cell JOIN tot USING (sample_id)),
heads AS (SELECT tx_idx, count(*) FILTER (fsm + em > 0) / 8.0 * exp(avg(CASE WHEN fsm + em > 0 THEN ln(1e6 * (fsm + em) / all_total) END)) * (1 - (2.0 * sum(i * (fsm + em)) / (8 * sum(fsm + em)) - 9.0 / 8)) AS confidence,
  count(*) FILTER (fsm + em >= 2) AS n_all, count(*) FILTER (fsm >= 2) AS n_fsm, count(*) FILTER (em >= 2) AS n_em FROM ranked GROUP BY tx_idx),
isoform AS (SELECT chrom, start, "end", list_sum(list_transform(exons, lambda x: x.e - x.s))::BIGINT AS length, n_exon::INT AS exon_count, tx_id AS trans_id, gene_id, 2::INT AS min_read,
  CASE WHEN n_all > 0 THEN 'yes' ELSE 'no' END || ':' || CASE WHEN n_fsm > 0 THEN 'yes' ELSE 'no' END || ':' || CASE WHEN n_em > 0 THEN 'yes' ELSE 'no' END AS detected,
  coalesce(n_all, 0) || ':' || coalesce(n_fsm, 0) || ':' || coalesce(n_em, 0) || '/8' AS n_pos_samples, sample_id, fsm, round(coalesce(confidence, 0), 3) AS confidence, round(shown, 3) AS em_shown,
  round(1e6 * (fsm + shown) / all_total, 3) AS all_cpm, round(1e6 * fsm / all_total, 3) AS fsm_cpm, round(1e6 * shown / all_total, 3) AS em_cpm
  FROM tx LEFT JOIN heads USING (tx_idx) LEFT JOIN (SELECT * FROM cell JOIN tot USING (sample_id)) USING (tx_idx))
"""
SQL["ref_x2_isoform_rows"] = _recursive(_EM + _ROWS + "SELECT * FROM isoform")


# ---- splice


def _splice_queries(c: Cohort) -> DataFrame:
    """Every junction of every transcript, each once."""
    return c.chains.select("chrom", F.explode("sj").alias("j")).select("chrom", F.col("j.d").alias("left"), F.col("j.a").alias("right")).distinct().select(F.concat_ws(":", "chrom", "left", "right").alias("id"), "chrom", "right", "left")


_SPLICE = """, q AS (SELECT DISTINCT chrom || ':' || j.d || ':' || j.a AS id, chrom, j.d AS l, j.a AS r FROM txj),
sq AS (SELECT id, q.chrom, l, r, p.*, list_filter(range(1, len(sj) + 1), lambda i: abs(sj[i].d - l) < 10 AND abs(sj[i].a - r) < 10)[1] AS k FROM q JOIN pnir p ON p.chrom = q.chrom),
ends AS (SELECT pid, min("left") AS start_min, max("left") AS start_max, min("right") AS end_min, max("right") AS end_max FROM reads GROUP BY pid),
rep AS (SELECT * FROM sq JOIN ends USING (pid) WHERE k IS NOT NULL)
"""


@query(_SPLICE + """SELECT id, chrom, l AS "left", r AS "right", pid, total_evidence AS evidence, round(1e6 * total_evidence / (SELECT count(*) FROM reads), 6) AS cpm, k::INT AS sj_no,
  sj[k].d - l AS left_dist, sj[k].a - r AS right_dist, CASE WHEN len(sj) > 1 THEN len(sj) + 1 WHEN is_mono THEN 1 ELSE 2 END AS n_exons, start_min, start_max, end_min, end_max, junctions FROM rep""")
def ref_a17_j18_splice_report(c: Cohort) -> DataFrame:
    return splice.splice_report(_splice_queries(c), c.pnir, c.site, c.shapes, c.totals).withColumn("cpm", F.round("cpm", 6))


@query(_SPLICE + """SELECT id, pid, sample_id, evidence, round(1e6 * evidence / total_evidence, 6) AS cpm, txt AS reads FROM (SELECT id, pid FROM rep) JOIN (SELECT pid, sample_id, evidence FROM profile) USING (pid)
  JOIN (SELECT sample_id, total_evidence FROM totals) USING (sample_id) JOIN (SELECT pid, sample_id, string_agg("left" || '|' || "right" || '|' || strand, ',' ORDER BY "left", "right", strand) AS txt FROM reads GROUP BY ALL) USING (pid, sample_id)""")
def ref_s31_splice_cells(c: Cohort) -> DataFrame:
    report = splice.splice_report(_splice_queries(c), c.pnir, c.site, c.shapes, c.totals)
    return splice.splice_cells(report, c.shapes, c.profile, c.totals).withColumn("cpm", F.round("cpm", 6))


# ---- fusion


def _fusion_queries(c: Cohort) -> DataFrame:
    """Breakpoints of each gene pair: the second exon's start in either gene."""
    g = c.gene.select(F.substring("gene_id", F.lit(2), F.lit(9)).cast("bigint").alias("g"), "chrom")
    a, b = g.filter("g % 2 = 0").select("g", F.col("chrom").alias("chr1")), g.select((F.col("g") - 1).alias("g"), F.col("chrom").alias("chr2"))
    at = lambda n: 100000 * n + 2000 * 1
    return a.join(b, "g").select(F.concat(F.lit("F"), "g").alias("id"), "chr1", at(F.col("g")).alias("pos1"), "chr2", at(F.col("g") + 1).alias("pos2"))


_FUSION = """, fq AS (SELECT 'F' || g AS id, 'C' || (g % 5) AS chr1, 100000 * g + 2000 AS pos1, 'C' || ((g + 1) % 5) AS chr2, 100000 * (g + 1) + 2000 AS pos2
  FROM (SELECT DISTINCT g FROM tx) WHERE g % 2 = 0 AND g + 1 IN (SELECT g FROM tx)),
sides AS (SELECT id, 'left' AS side, chr1 AS chrom, pos1 AS p, chr2 AS mc, pos2 AS mp FROM fq UNION ALL SELECT id, 'right', chr2, pos2, chr1, pos1 FROM fq),
fh AS (SELECT DISTINCT id, side, mc, mp, pid FROM sides JOIN site USING (chrom) WHERE abs(pos - p) <= 10),
fok AS (SELECT id FROM fh GROUP BY id HAVING count(DISTINCT side) = 2),
fe AS (SELECT id, sample_id, count(*) AS evidence FROM fh JOIN fok USING (id) JOIN reads USING (pid) WHERE supp_chrom = mc AND supp_s <= mp + 10 AND supp_e >= mp - 10 GROUP BY ALL)
"""


@query(_FUSION + "SELECT * FROM fe")
def ref_j14_a12_breakpoint_evidence(c: Cohort) -> DataFrame:
    return fusion.breakpoint_evidence(_fusion_queries(c), c.site, c.reads)


@query(_FUSION + "SELECT id, chr1, pos1, chr2, pos2, sum(evidence)::BIGINT AS total_evidence, count(*) AS positive_samples FROM fq JOIN fe USING (id) GROUP BY ALL")
def ref_x3_fusion_breakpoints(c: Cohort) -> DataFrame:
    q = _fusion_queries(c)
    return fusion.breakpoint_rows(q, fusion.breakpoint_evidence(q, c.site, c.reads))


@query(_FUSION + """SELECT DISTINCT ON (id, side, rid) id, side, sample_id, r.pid, "left", "right", supp_chrom AS seg_chrom, supp_s AS seg_s, supp_e AS seg_e FROM
  (SELECT id, side, chrom, p - 3000 AS lo, p + 3000 AS hi, mc, mp - 3000 AS mlo, mp + 3000 AS mhi FROM sides) s JOIN (SELECT *, row_number() OVER () AS rid FROM reads) r ON r.supp_chrom = mc
  AND (supp_s BETWEEN mlo AND mhi OR supp_e BETWEEN mlo AND mhi) AND r.chrom = s.chrom JOIN site t ON t.chrom = s.chrom AND t.pid = r.pid AND t.pos BETWEEN lo AND hi""")
def ref_j15_x4_fusion_regions(c: Cohort) -> DataFrame:
    q = _fusion_queries(c)
    near = lambda n: [(F.col(f"pos{n}") - 3000).alias(f"s{n}"), (F.col(f"pos{n}") + 3000).alias(f"e{n}")]
    found = fusion.region_reads(q.select("id", "chr1", *near(1), "chr2", *near(2)), c.site, c.reads)
    return found.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "supp")


_CAND = """, cr AS (SELECT *, list_sort(flatten(list_transform(sj, lambda j: [j.d, j.a]))) AS main FROM reads WHERE supp_chrom IS NOT NULL),
cand AS (SELECT md5(chrom || ';' || array_to_string(main, ',') || ';' || supp_chrom || ';' || supp_s || ',' || supp_e) AS cand, sample_id, any_value(chrom) AS mc, any_value(main) AS main,
  any_value(supp_chrom) AS sc, any_value([supp_s, supp_e]) AS supp, count(*) AS n FROM cr GROUP BY ALL),
shp AS (SELECT cand, any_value(mc) AS mc, any_value(main) AS main, any_value(sc) AS sc, any_value(supp) AS supp FROM cand GROUP BY cand),
sd AS (SELECT cand, 'm' AS side, mc AS chrom, main AS sites FROM shp UNION ALL SELECT cand, 's', sc, supp FROM shp),
bg0 AS (SELECT cand, side, gene_id, gene_name, start, "end", len(list_filter(list_distinct(sd.sites), lambda p: len(list_filter(g.sites, lambda e: abs(e - p) <= 10)) > 0)) AS n_match
  FROM sd JOIN gene g ON g.chrom = sd.chrom AND list_min(sd.sites) <= g."end" AND list_max(sd.sites) >= g.start WHERE gene_type = 'protein_coding'),
bg AS (SELECT * FROM bg0 WHERE n_match > 0 QUALIFY row_number() OVER (PARTITION BY cand, side ORDER BY n_match DESC, start, "end", gene_id) = 1),
pairs AS (SELECT cand, least(m.gene_name, s.gene_name) AS gene_a, greatest(m.gene_name, s.gene_name) AS gene_b, CASE WHEN m.gene_name <= s.gene_name THEN 'ab' ELSE 'ba' END AS direction, shp.*
  FROM (SELECT * FROM bg WHERE side = 'm') m JOIN (SELECT * FROM bg WHERE side = 's') s USING (cand) JOIN shp USING (cand) WHERE m.gene_id <> s.gene_id)
"""


@query(_CAND + "SELECT cand, sample_id, n FROM cand")
def ref_a13_p21_fusion_candidates(c: Cohort) -> DataFrame:
    return fusion.candidates(c.pnir, c.reads).select("cand", "sample_id", "n")


@query(_CAND + "SELECT cand, side, gene_id, n_match FROM bg")
def ref_j16_j17_o5_best_gene(c: Cohort) -> DataFrame:
    cand = durable(fusion.candidates(c.pnir, c.reads).dropDuplicates(["cand"]))
    side = lambda n: fusion.best_gene(cand.select("cand", F.col(f"{n}_chrom").alias("chrom"), F.col(n).alias("sites")), "cand", c.gene).select("cand", F.lit(n[0]).alias("side"), "gene_id", "n_match")
    return side("main").unionByName(side("supp"))


@query(_CAND + "SELECT cand, gene_a, gene_b, direction FROM pairs")
def ref_x1_a14_gene_pairs(c: Cohort) -> DataFrame:
    cand = fusion.candidates(c.pnir, c.reads)
    return fusion.gene_pairs(cand, c.gene).select("cand", "gene_a", "gene_b", "direction")


_ENDS = [(f"{d}_{s}_{e}", d, s, e) for d in ("ab", "ba") for s in ("main", "supp") for e in ("lo", "hi")]
_OF = lambda d, s, e: f"CASE WHEN direction = '{d}' THEN list_{'min' if e == 'lo' else 'max'}({s}) END"


@query(_CAND + ", e AS (SELECT gene_a, gene_b, " + ", ".join(f"avg({_OF(d, s, e)}) AS {n}, stddev_pop({_OF(d, s, e)}) AS {n}_sd" for n, d, s, e in _ENDS) + """, count(*) AS n_candidates FROM pairs GROUP BY ALL),
pe AS (SELECT gene_a, gene_b, sum(n)::BIGINT AS total_evidence, count(DISTINCT sample_id) AS total_samples FROM pairs JOIN (SELECT cand, sample_id, n FROM cand) USING (cand) GROUP BY ALL)
SELECT gene_a, gene_b, n_candidates, total_evidence, total_samples, """ + ", ".join(f"round({n}, 4) AS {n}, round({n}_sd, 4) AS {n}_sd" for n, *_ in _ENDS) + """ FROM e JOIN pe USING (gene_a, gene_b)
WHERE ab_main_lo <= ba_supp_hi AND ba_supp_lo <= ab_main_hi AND ab_supp_lo <= ba_main_hi AND ba_main_lo <= ab_supp_hi""")
def ref_a15_a16_x5_fusion_discovery(c: Cohort) -> DataFrame:
    cand = durable(fusion.candidates(c.pnir, c.reads))
    df = fusion.clusters(cand, durable(fusion.gene_pairs(cand, c.gene)))
    return df.select("gene_a", "gene_b", "n_candidates", "total_evidence", "total_samples", *(F.round(x, 4).alias(x) for n, *_ in _ENDS for x in (n, f"{n}_sd")))


@query(_CAND + """SELECT gene_a, gene_b, sample_id, sum(n)::BIGINT AS n FROM pairs JOIN (SELECT cand, sample_id, n FROM cand) USING (cand) GROUP BY ALL""")
def ref_a16_cluster_samples(c: Cohort) -> DataFrame:
    cand = durable(fusion.candidates(c.pnir, c.reads))
    return fusion.cluster_samples(cand, fusion.gene_pairs(cand, c.gene))
