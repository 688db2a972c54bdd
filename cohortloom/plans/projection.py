"""A deterministic genome from the driver's tables: transcripts from part, reads from lineitem.

Written once for Spark and once as DuckDB CTEs; every query on the reference's operators starts here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, em, match, quantify
from ..session import durable, table

SAMPLES = 8


@dataclass
class Cohort:
    """The tables of one data directory, each defined when first asked for.

    Profiles, read shapes, the cohort and site hits are the index that several steps of a query read; they
    are written once.
    """

    spark: SparkSession
    d: str

    @cached_property
    def tx(self) -> DataFrame:
        part = table(self.spark, self.d, "part").select(F.col("p_partkey").alias("tx_idx"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("bigint").alias("g"), (F.col("p_size") % 6 + 1).alias("n_exon"), (F.col("p_partkey") % 4).alias("v"))
        i = lambda k: k + F.col("v") % 2
        exon = lambda k: F.struct((100000 * F.col("g") + 2000 * i(k) + F.when((F.col("v") >= 2) & (i(k) % 2 == 1), 100).otherwise(0)).alias("s"), (100000 * F.col("g") + 2000 * i(k) + 300).alias("e"))
        df = part.withColumn("exons", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_exon").cast("bigint") - 1), exon))
        return durable(df.select(
            "tx_idx", "g", "v", "n_exon", F.concat(F.lit("C"), F.col("g") % 5).alias("chrom"), F.col("exons")[0]["s"].alias("start"), F.element_at("exons", -1)["e"].alias("end"),
            F.when(F.col("g") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("T"), "tx_idx").alias("tx_id"), F.concat(F.lit("G"), "g").alias("gene_id"),
            "exons", build.junctions(F.col("exons")).alias("sj"), (F.col("n_exon") == 1).alias("is_mono"),
        ))

    @cached_property
    def grouped(self) -> DataFrame:
        return match.overlap_groups(self.tx)

    @cached_property
    def gene(self) -> DataFrame:
        df = self.tx.groupBy("g").agg(F.first("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.flatten(F.transform("exons", lambda x: F.array(x["s"], x["e"]))))))).alias("sites"))
        return df.select(F.concat(F.lit("G"), "g").alias("gene_id"), F.concat(F.lit("N"), F.lpad(F.col("g").cast("string"), 2, "0")).alias("gene_name"), F.when(F.col("g") == 13, "lncRNA").otherwise("protein_coding").alias("gene_type"), "chrom", "start", "end", "sites")

    @cached_property
    def reads(self) -> DataFrame:
        """Reads that agree in all that is kept of them, with their number n.

        Which exons a read has depends on a few small numbers only: junctions and signatures are worked
        out once for each of their combinations that occurs.
        """
        li = table(self.spark, self.d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"))
        tx = self.tx.select(F.col("tx_idx").alias("l_partkey"), "g", "n_exon", "v").filter("not (n_exon = 6 and v = 3)")
        skip = F.least(F.col("l_linenumber") % 3, F.col("n_exon") - 1)
        mate = F.when(F.col("g") % 2 == 0, F.col("g") + 1).otherwise(F.col("g") - 1)
        at = F.when(F.col("disc").isin(0, 10) & (mate >= 1), 100000 * mate + 2000 * (1 + F.col("q") % 3))
        df = li.join(tx, "l_partkey").withColumn("skip", skip).withColumn("many", F.col("n_exon") - F.col("skip") > 1)
        df = df.groupBy(
            "g", "n_exon", "v", "skip", F.when(F.col("l_linenumber") == 7, F.col("q") % 5 - 2).otherwise(0).alias("shift"), F.when(~F.col("many"), F.col("tax")).otherwise(0).alias("widen"),
            F.when(F.col("many"), F.col("q") % 7).otherwise(0).alias("lo"), F.col("tax").alias("hi"), at.alias("at"), (F.col("l_suppkey") % SAMPLES).alias("sample_id"),
        ).agg(F.count("*").alias("n"))
        df = durable(df)
        key = ["g", "n_exon", "v", "skip", "shift", "widen"]
        shape = df.select(*key).distinct().join(self.tx.select("g", "n_exon", "v", "chrom", "strand", "exons").dropDuplicates(["g", "n_exon", "v"]), ["g", "n_exon", "v"])
        kept = F.slice("exons", F.col("skip") + 1, F.col("n_exon"))
        shape = shape.withColumn("exons", F.transform(kept, lambda x: F.struct((x["s"] + F.col("shift")).alias("s"), (x["e"] + F.col("shift") + F.col("widen")).alias("e"))))
        shape = durable(build.with_signature(shape).select(*key, "chrom", "strand", "pid", "junctions", "left", "right"))
        mate_chrom = F.concat(F.lit("C"), mate % 5)
        segment = F.array(F.struct(mate_chrom.alias("chrom"), F.col("at").alias("s"), (F.col("at") + 300).alias("e"), F.lit("+").alias("strand")))
        supp = F.when(F.col("at").isNotNull(), segment).otherwise(F.array().cast("array<struct<chrom:string,s:bigint,e:bigint,strand:string>>"))
        df = df.join(shape, key)
        right = F.col("right") - F.col("widen") + F.col("hi")
        reads = df.select("sample_id", "pid", "chrom", "junctions", (F.col("left") - F.col("lo")).alias("left"), right.alias("right"), "strand", supp.alias("supp"), "n")
        return durable(build.collapse(reads))

    @cached_property
    def profile(self) -> DataFrame:
        return durable(build.profiles(self.reads))

    @cached_property
    def shapes(self) -> DataFrame:
        return durable(build.read_shapes(self.reads))

    @cached_property
    def pnir(self) -> DataFrame:
        return durable(build.cohort(self.profile, self.shapes))

    @cached_property
    def site(self) -> DataFrame:
        return durable(build.site_postings(self.pnir, self.shapes))

    @cached_property
    def totals(self) -> DataFrame:
        return build.sample_totals(self.profile)

    @cached_property
    def chains(self) -> DataFrame:
        """The distinct junction chains: what is matched. by_transcript gives the rows of transcripts."""
        return durable(match.tx_chains(self.tx))

    @cached_property
    def hits(self) -> DataFrame:
        return durable(match.site_hits(match.tx_sites(self.chains, "cid"), self.site, 10))

    @cached_property
    def fsm(self) -> DataFrame:
        return durable(match.full_chain_matches(self.chains, self.pnir, self.site, 10))

    def by_transcript(self, df: DataFrame) -> DataFrame:
        return match.by_transcript(df, self.tx)

    @cached_property
    def kinds(self) -> DataFrame:
        return durable(quantify.with_kinds(self.tx))

    def kept(self, pairs: DataFrame) -> DataFrame:
        """Pairs of chains and records as pairs of transcripts that may keep the record."""
        kept, atoms = em.kept_runs(pairs, self.fsm, self.kinds.filter(~F.col("is_mono")))
        return kept.join(atoms.select("tx_idx", "cid", "atom"), "cid").filter(F.col("atom") < F.col("k")).drop("k", "atom", "cid")

    @cached_property
    def mono(self) -> DataFrame:
        return match.mono_matches(self.tx, self.pnir, 10)

    def quantified(self, opts: quantify.Options = quantify.Options()) -> quantify.Quantification:
        return quantify.quantify(self.tx, self.pnir, self.site, self.profile, self.shapes, opts)


BASE = """
WITH tx0 AS (SELECT p_partkey AS tx_idx, regexp_extract(p_brand, '#([0-9]+)', 1)::BIGINT AS g, p_size % 6 + 1 AS n_exon, p_partkey % 4 AS v FROM part),
tx1 AS (SELECT *, list_transform(range(0, n_exon), lambda k: {'s': 100000 * g + 2000 * (k + v % 2) + CASE WHEN v >= 2 AND (k + v % 2) % 2 = 1 THEN 100 ELSE 0 END,
  'e': 100000 * g + 2000 * (k + v % 2) + 300}) AS exons FROM tx0),
tx AS (SELECT tx_idx, g, v, n_exon, 'C' || (g % 5) AS chrom, exons[1].s AS start, exons[-1].e AS "end", CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand,
  'T' || tx_idx AS tx_id, 'G' || g AS gene_id, exons, CASE WHEN n_exon = 1 THEN [{'d': exons[1].s, 'a': exons[1].e}]
  ELSE list_transform(range(1, n_exon), lambda i: {'d': exons[i].e, 'a': exons[i + 1].s}) END AS sj, n_exon = 1 AS is_mono FROM tx1),
gene AS (SELECT 'G' || g AS gene_id, 'N' || lpad(g::VARCHAR, 2, '0') AS gene_name, CASE WHEN g = 13 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_type, any_value(chrom) AS chrom,
  min(start) AS start, max("end") AS "end", list_sort(list_distinct(flatten(list(flatten(list_transform(exons, lambda x: [x.s, x.e])))))) AS sites FROM tx GROUP BY g),
rd0 AS (SELECT l_suppkey % 8 AS sample_id, chrom, strand, g, l_quantity::INT AS q, round(l_tax * 100)::BIGINT AS tax, round(l_discount * 100)::BIGINT AS disc,
  CASE WHEN l_linenumber = 7 THEN l_quantity::INT % 5 - 2 ELSE 0 END AS shift, exons[least(l_linenumber % 3, n_exon - 1) + 1:] AS kept,
  CASE WHEN g % 2 = 0 THEN g + 1 ELSE g - 1 END AS mate FROM lineitem JOIN tx ON l_partkey = tx_idx WHERE NOT (n_exon = 6 AND v = 3)),
rd1 AS (SELECT *, list_transform(range(1, len(kept) + 1), lambda i: {'s': kept[i].s + shift - CASE WHEN i = 1 AND len(kept) > 1 THEN q % 7 ELSE 0 END,
  'e': kept[i].e + shift + CASE WHEN i = len(kept) THEN tax ELSE 0 END}) AS exons FROM rd0),
rd2 AS (SELECT sample_id, chrom, strand, exons, exons[1].s AS "left", exons[-1].e AS "right",
  CASE WHEN len(exons) = 1 THEN [{'d': exons[1].s, 'a': exons[1].e}] ELSE list_transform(range(1, len(exons)), lambda i: {'d': exons[i].e, 'a': exons[i + 1].s}) END AS sj,
  CASE WHEN disc IN (0, 10) AND mate >= 1 THEN 'C' || (mate % 5) END AS supp_chrom, 100000 * mate + 2000 * (1 + q % 3) AS supp_s FROM rd1),
reads AS (SELECT *, CASE WHEN supp_chrom IS NOT NULL THEN supp_s + 300 END AS supp_e, array_to_string(list_transform(sj, lambda j: j.d || '-' || j.a), '|') AS junctions,
  md5(chrom || ':' || array_to_string(list_transform(sj, lambda j: j.d || '-' || j.a), '|')) AS pid FROM rd2),
profile AS (SELECT sample_id, pid, any_value(chrom) AS chrom, any_value(sj) AS sj, any_value(junctions) AS junctions, count(*) AS evidence FROM reads GROUP BY sample_id, pid),
shapes AS (SELECT pid, sample_id, "left", "right", strand, count(*) AS n FROM reads GROUP BY ALL),
pnir AS (SELECT pid, any_value(chrom) AS chrom, any_value(sj) AS sj, any_value(junctions) AS junctions, len(any_value(sj)) * 2 AS n_sites, count(*) AS total_evidence,
  count(DISTINCT sample_id) AS n_samples, len(any_value(sj)) = 1 AND bool_and("left" = sj[1].d AND "right" = sj[1].a) AS is_mono FROM reads GROUP BY pid),
site AS (SELECT DISTINCT chrom, unnest(flatten(list_transform(sj, lambda j: [j.d, j.a]))) AS pos, pid, n_sites, 'sj' AS kind FROM pnir
  UNION ALL SELECT DISTINCT chrom, unnest(["left", "right"]), pid, 0, 'term' FROM reads),
totals AS (SELECT sample_id, count(*) AS total_evidence FROM reads GROUP BY sample_id),
grp0 AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM tx),
grouped AS (SELECT * EXCLUDE upto, max(CASE WHEN upto IS NULL OR start > upto THEN start END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS group_id FROM grp0),
txj AS (SELECT tx_idx, chrom, unnest(range(len(sj))) AS sj_no, unnest(sj) AS j FROM tx WHERE NOT is_mono),
txs AS (SELECT tx_idx, chrom, sj_no, unnest([0, 1]) AS side, unnest([j.d, j.a]) AS q_pos FROM txj),
hits AS (SELECT DISTINCT tx_idx, sj_no, side, q_pos, pid, n_sites FROM txs JOIN site USING (chrom) WHERE kind = 'sj' AND abs(pos - q_pos) <= 10),
fsm AS (SELECT tx_idx, pid FROM hits JOIN tx USING (tx_idx) GROUP BY tx_idx, pid, n_sites HAVING n_sites = 2 * any_value(len(sj))
  AND count(DISTINCT q_pos) = any_value(len(list_distinct(flatten(list_transform(sj, lambda j: [j.d, j.a])))))),
partial0 AS (SELECT DISTINCT tx_idx, pid FROM (SELECT tx_idx, sj_no, pid FROM hits GROUP BY ALL HAVING count(DISTINCT side) = 2)),
claim AS (SELECT chrom, group_id, pid, min({'s': start, 'e': "end", 't': tx_idx}) AS claim FROM fsm JOIN grouped USING (tx_idx) GROUP BY ALL),
partials AS (SELECT tx_idx, p.pid FROM partial0 p JOIN grouped g USING (tx_idx) LEFT JOIN claim c ON c.chrom = g.chrom AND c.group_id = g.group_id AND c.pid = p.pid
  WHERE claim IS NULL OR claim > {'s': g.start, 'e': g."end", 't': tx_idx}),
chain0 AS (SELECT tx_idx, pid, t.sj AS ref, p.sj AS rec, list_filter(range(1, len(t.sj) + 1), lambda k: abs(t.sj[k].d - p.sj[1].d) <= 10 AND abs(t.sj[k].a - p.sj[1].a) <= 10)[1] AS k1
  FROM partials JOIN tx t USING (tx_idx) JOIN pnir p USING (pid) WHERE len(p.sj) <= len(t.sj)),
chains AS (SELECT tx_idx, pid, (k1 - 1)::INT AS first, len(rec)::INT AS n_sj FROM chain0 WHERE k1 IS NOT NULL
  AND len(list_filter(range(0, len(rec)), lambda i: abs(ref[k1 + i].d - rec[1 + i].d) <= 10 AND abs(ref[k1 + i].a - rec[1 + i].a) <= 10)) = len(rec)),
mono AS (SELECT tx_idx, pid, abs(m.sj[1].d - t.start) <= 10 AND abs(m.sj[1].a - t."end") <= 10 AS "full", m.sj[1].a - m.sj[1].d AS span, m.sj[1].d >= t.start AND m.sj[1].a <= t."end" AS inside
  FROM tx t JOIN pnir m USING (chrom) WHERE t.is_mono AND m.is_mono AND m.sj[1].d <= t."end" + 10 AND m.sj[1].a >= t.start - 10)
"""
