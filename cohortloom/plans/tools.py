"""Queries on scalar functions and tools, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genome as g
from ..operators import build
from ..session import table
from ..sources import tables
from .projection import BASE, SAMPLES, Cohort

_NAMES = [f"S{i}" for i in range(SAMPLES)]
_BARE = r"regexp_replace(upper(regexp_replace(chrom, '^\s+|\s+$', '', 'g')), '^(CHR)+', '')"


def ref_f1_f2_f3_chrom_names(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "gene").select("chrom").distinct().filter("chrom is not null")
    return df.select("chrom", g.bare_chrom("chrom").alias("bare"), g.pad_chrom("chrom").alias("padded"), g.plain_chrom("chrom").alias("plain"))


def ref_f4_pack(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", g.pack(F.col("c_custkey"), F.col("c_nationkey")).alias("packed"))
    return df.select("c_custkey", "packed", g.unpack_hi(F.col("packed")).alias("hi"), g.unpack_lo(F.col("packed")).alias("lo"))


def ref_f5_f6_f7_ranges(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "gene").filter("gene_start is not null and gene_end is not null").select("gene_idx", F.col("gene_start").alias("s"), F.col("gene_end").alias("e"))
    at = F.lit(820_000).cast("bigint")
    return df.select("gene_idx", g.overlaps(F.col("s"), F.col("e"), at, at + 10_000).alias("over"), g.clamped_diff(F.col("s") * 10_000, at).alias("diff"), g.saturating_sub(F.col("s"), 815_000).alias("sat")).distinct()


def ref_f8_fields(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "fusion_raw").filter("trim(raw_line) <> ''").select("line_id", g.split_fields(F.col("raw_line")).alias("f"))
    return df.select("line_id", F.size("f").alias("n"), F.col("f")[0].alias("first")).distinct()


def ref_f11_attributes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "transcript").filter("gene_id is not null")
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "tx_id", F.lit('"; level 2;'))
    return df.select("tx_idx", g.attr(attrs, "gene_id").alias("gene"), g.attr(attrs, "transcript_id").alias("tx"), g.attr(attrs, "level").alias("level"), g.attr(attrs, "none").alias("none")).distinct()


def ref_f12_cell_parts(spark: SparkSession, d: str) -> DataFrame:
    """All cells; parts that are no number are null, and 0 in the pair of cpm and count."""
    cell = F.col("init_string")
    df = table(spark, d, "sample_chip").select("chip_id", tables.cell_part(cell, 0).alias("a"), tables.cell_part(cell, 1).alias("b"), g.cpm_and_count(cell).alias("p"))
    return df.select("chip_id", "a", "b", "p.cpm", "p.count").distinct()


def ref_f12_named_values(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "transcript").select("tx_idx", *(g.named_value(F.col("orig_attrs"), k).alias(k) for k in ("gene_name", "level", "tag")))
    return df.distinct()


def ref_f13_math(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders").filter(x > 0).select("o_orderkey", F.round(F.ln(x), 6).alias("ln"), F.round(F.sqrt(x), 6).alias("root"), F.round(F.exp(F.ln(x) / 2), 6).alias("half"), F.round(F.pow(F.ln(x), 2), 6).alias("square"))


def ref_f14_strands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript").select("tx_idx", g.strand_symbol(F.col("strand")).alias("strand")).distinct()


def ref_f15_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))


def ref_p1_alignment_filter(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 4096).alias("flag"), F.col("l_quantity").cast("int").alias("mapq"))
    return df.filter(build.keep_alignment(F.col("flag"), F.col("mapq"))).groupBy("flag").agg(F.count("*").alias("n"))


def ref_p2_p3_cigar(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    df = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pos"), q.alias("q"), n.alias("n")).distinct()
    cigar = F.concat(F.lit("7S"), "q", F.lit("M2D"), F.col("n") * 100, F.lit("N5I"), F.col("n"), F.lit("M3H"))
    sa = F.concat(F.lit("chr2,"), F.col("pos") + 1, F.lit(",-,"), "q", F.lit("M10N"), "n", F.lit("M,60,0;"))
    return df.select("pos", "q", "n", F.to_json(build.cigar_exons(F.col("pos"), cigar)).alias("exons"), F.to_json(build.sa_segments(sa)).alias("supp"))


def ref_p15_s12_s13_bed(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "fusion_raw").filter("raw_line is not null").select(F.regexp_replace("raw_line", "\r$", "").alias("value"))
    return tables.bed_pairs(raw).select("chr1", "pos1", "chr2", "pos2", "id").distinct()


def ref_a21_u8_chrom_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gene").select(g.bare_chrom("chrom").alias("chrom"))
    return a.unionByName(table(spark, d, "transcript").select(g.bare_chrom("chrom").alias("chrom"))).filter("chrom is not null").distinct()


def ref_a22_keep_first(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "event_type")


def _cells(c: Cohort) -> DataFrame:
    return c.profile.select("pid", F.concat(F.lit("S"), "sample_id").alias("sample"), F.concat_ws(":", "evidence", F.lit("1")).alias("cell"))


def ref_s25_wide_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.wide(_cells(Cohort(spark, d)), ["pid"], "sample", "cell", _NAMES)


def ref_s32_s26_long_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.long(tables.wide(_cells(Cohort(spark, d)), ["pid"], "sample", "cell", _NAMES), ["pid"], _NAMES).filter("cell <> '0:0:NULL'")


def ref_u6_u4_merge_results(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(Cohort(spark, d))
    return tables.merge_results(cells.filter("sample < 'S4'"), cells.filter("sample >= 'S4'"), ["pid"])


def ref_u5_u2_merge_meta(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("tissue"))
    return tables.merge_meta(a, table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("x").alias("platform")))


def ref_u7_split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tables.split_manifest(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


def ref_j21_sample_meta(spark: SparkSession, d: str) -> DataFrame:
    c = Cohort(spark, d)
    names = spark.createDataFrame([(i, f"S{i}", "tissue" if i % 2 else "blood") for i in range(SAMPLES)], "sample_id bigint, name string, tissue string")
    return c.profile.join(F.broadcast(names), "sample_id").groupBy("tissue").agg(F.sum("evidence").alias("evidence"))


_NUMBER = r"CASE WHEN regexp_full_match(string_split(init_string, ':')[{0}], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(string_split(init_string, ':')[{0}] AS DOUBLE) END"
QUERIES = {k: v for k, v in globals().items() if k.startswith("ref_")}
SQL = {
    "ref_f1_f2_f3_chrom_names": f"SELECT DISTINCT chrom, {_BARE} AS bare, CASE WHEN starts_with(chrom, 'chr') THEN chrom ELSE 'chr' || chrom END AS padded, CASE WHEN regexp_replace(chrom, '^(chr)+', '') = 'MT' THEN 'M' ELSE regexp_replace(chrom, '^(chr)+', '') END AS plain FROM gene WHERE chrom IS NOT NULL",
    "ref_f4_pack": "SELECT c_custkey, c_custkey * 4294967296 + c_nationkey AS packed, c_custkey AS hi, c_nationkey::BIGINT AS lo FROM customer",
    "ref_f5_f6_f7_ranges": "SELECT DISTINCT gene_idx, gene_start <= 830000 AND gene_end >= 820000 AS over, greatest(least(gene_start * 10000 - 820000, 2147483647), -2147483647) AS diff, greatest(gene_start - 815000, 0) AS sat FROM gene WHERE gene_start IS NOT NULL AND gene_end IS NOT NULL",
    "ref_f8_fields": r"SELECT DISTINCT line_id, len(f)::INT AS n, f[1] AS first FROM (SELECT line_id, CASE WHEN contains(raw_line, chr(9)) THEN string_split(raw_line, chr(9)) ELSE regexp_split_to_array(trim(raw_line, ' '), '\s+') END AS f FROM fusion_raw WHERE trim(raw_line, ' ') <> '')",
    "ref_f11_attributes": "SELECT DISTINCT tx_idx, gene_id AS gene, tx_id AS tx, '2' AS level, NULL AS none FROM transcript WHERE gene_id IS NOT NULL",
    "ref_f12_cell_parts": f"""SELECT DISTINCT chip_id, {_NUMBER.format(1)} AS a, {_NUMBER.format(2)} AS b, CASE WHEN contains(init_string, ':') THEN coalesce({_NUMBER.format(1)}, 0) ELSE 0 END AS cpm,
  CASE WHEN contains(init_string, ':') THEN coalesce(try_cast(trunc({_NUMBER.format(2)}) AS BIGINT), 0) ELSE 0 END AS count FROM sample_chip""",
    "ref_f12_named_values": "SELECT DISTINCT tx_idx, " + ", ".join(f"coalesce(list_filter(list_transform(string_split(orig_attrs, ';'), lambda x: trim(x)), lambda x: starts_with(x, '{k}:'))[1][{len(k) + 2}:], '') AS {k}" for k in ("gene_name", "level", "tag")) + " FROM transcript",
    "ref_f13_math": "SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln, round(sqrt(o_totalprice), 6) AS root, round(exp(ln(o_totalprice) / 2), 6) AS half, round(pow(ln(o_totalprice), 2), 6) AS square FROM orders WHERE o_totalprice > 0",
    "ref_f14_strands": "SELECT DISTINCT tx_idx, CASE WHEN strand IN ('+', '1', '0', 'plus') THEN '+' WHEN strand IN ('-', '-1', 'minus') THEN '-' END AS strand FROM transcript",
    "ref_f15_json": "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS j FROM nation",
    "ref_p1_alignment_filter": "SELECT l_orderkey % 4096 AS flag, count(*) AS n FROM lineitem WHERE (l_orderkey % 4096) & 4 = 0 AND (l_orderkey % 4096) & 256 = 0 AND l_quantity::INT >= 5 GROUP BY 1",
    "ref_p2_p3_cigar": """SELECT DISTINCT pos, q, n, '[{"s":' || pos || ',"e":' || (pos + q + 2) || '},{"s":' || (pos + q + 2 + 100 * n) || ',"e":' || (pos + q + 2 + 101 * n) || '}]' AS exons,
  '[{"chrom":"2","s":' || pos || ',"e":' || (pos + q) || ',"strand":"-"},{"chrom":"2","s":' || (pos + q + 10) || ',"e":' || (pos + q + 10 + n) || ',"strand":"-"}]' AS supp
  FROM (SELECT l_partkey AS pos, l_quantity::INT AS q, l_linenumber AS n FROM lineitem)""",
    "ref_p15_s12_s13_bed": f"""SELECT DISTINCT CASE WHEN p1 > p2 THEN c2 ELSE c1 END AS chr1, least(p1, p2) AS pos1, CASE WHEN p1 > p2 THEN c1 ELSE c2 END AS chr2, greatest(p1, p2) AS pos2, id FROM (
  SELECT {_BARE.replace("chrom,", "f[1],")} AS c1, try_cast(CASE WHEN regexp_full_match(trim(f[2], ' '), '[+-]?[0-9]+') THEN trim(f[2], ' ') END AS BIGINT) AS p1, {_BARE.replace("chrom,", "f[3],")} AS c2,
  try_cast(CASE WHEN regexp_full_match(trim(f[4], ' '), '[+-]?[0-9]+') THEN trim(f[4], ' ') END AS BIGINT) AS p2, f[5] AS id
  FROM (SELECT string_split(regexp_replace(raw_line, '\\r$', ''), chr(9)) AS f FROM fusion_raw WHERE raw_line IS NOT NULL AND NOT starts_with(raw_line, '#')) WHERE len(f) >= 5) WHERE p1 IS NOT NULL AND p2 IS NOT NULL""",
    "ref_a21_u8_chrom_union": f"SELECT DISTINCT {_BARE} AS chrom FROM (SELECT chrom FROM gene UNION ALL SELECT chrom FROM transcript) WHERE chrom IS NOT NULL",
    "ref_a22_keep_first": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "ref_s25_wide_table": BASE + "SELECT pid, " + ", ".join(f"coalesce(max(CASE WHEN sample_id = {i} THEN evidence || ':1' END), '0:0:NULL') AS S{i}" for i in range(SAMPLES)) + " FROM profile GROUP BY pid",
    "ref_s32_s26_long_table": BASE + "SELECT pid, 'S' || sample_id AS sample, evidence || ':1' AS cell FROM profile",
    "ref_u6_u4_merge_results": BASE + "SELECT pid, 'S' || sample_id AS sample, evidence || ':1' AS cell FROM profile",
    "ref_u5_u2_merge_meta": "SELECT n_name AS name, 'r' || n_regionkey AS tissue, 'NA' AS platform FROM nation UNION ALL SELECT r_name, 'NA', 'x' FROM region",
    "ref_u7_split_manifest": "SELECT c_custkey, c_name, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS shard FROM customer",
    "ref_j21_sample_meta": BASE + "SELECT CASE WHEN sample_id % 2 = 1 THEN 'tissue' ELSE 'blood' END AS tissue, sum(evidence)::BIGINT AS evidence FROM profile GROUP BY 1",
}
