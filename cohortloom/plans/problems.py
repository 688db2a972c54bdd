"""Queries on the general data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, hotkeys, lines, packed, periods
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.failed_lines(table(spark, d, "fusion_raw"), table(spark, d, "manifest_raw"), table(spark, d, "chrom_map"))


def p1_valid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return lines.load_fusion(table(spark, d, "fusion_raw"), table(spark, d, "chrom_map"))


def p1_valid_manifest(spark: SparkSession, d: str) -> DataFrame:
    df = lines.load_manifest(table(spark, d, "manifest_raw"))
    return df.select("line_id", "series", "file_no", "sample", "path", F.size("values").alias("n_fields"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "manifest_raw"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.typed_table(table(spark, d, "manifest_raw"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.all_periods(table(spark, d, "gene"), table(spark, d, "transcript"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack_tables(table(spark, d, "gene"), table(spark, d, "sample_chip"), table(spark, d, "transcript"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.hot_keys(table(spark, d, "pnir"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    df = hotkeys.cohort_records(table(spark, d, "pnir"))
    return df.select("signature", "chrom_id", "n_records", "total_evidence", F.array_join(F.col("sample_evidence").cast("array<string>"), ",").alias("sample_evidence"))


QUERIES = {f.__name__: f for f in (p1_found, p1_valid_fusion, p1_valid_manifest, p2_found, p2_table, p3_found, p4_found, p5_found, p5_records)}

_FIELD = r'''"(?:[^"]|"")*"|[^"\t][^\t]*|'''
_BARE = r"regexp_replace(upper(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^(CHR)+', '')"
_FIELDS = f"list_transform(regexp_extract_all(chr(9) || body, '\\t({_FIELD})', 1), lambda x: CASE WHEN x[1] = '\"' THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
_LINES = f"""
WITH fus0 AS (SELECT DISTINCT line_id, regexp_replace(raw_line, '\\r$', '') AS body FROM fusion_raw
  WHERE raw_line IS NOT NULL),
fus1 AS (SELECT line_id, body, regexp_full_match(chr(9) || body, '(\\t({_FIELD}))*') AS quotes FROM fus0
  WHERE regexp_matches(body, '\\S') AND NOT starts_with(body, '#')),
fus2 AS (SELECT line_id, quotes, list_transform({_FIELDS}, lambda x: trim(x, ' ')) AS f FROM fus1),
fus3 AS (SELECT line_id, quotes, len(f) AS n, {_BARE.format("f[1]")} AS left_chr, f[2] AS p1, {_BARE.format("f[3]")} AS right_chr, f[4] AS p2,
  f[5] AS idstring, f[6] AS note FROM fus2),
fus AS (SELECT line_id, left_chr, right_chr, try_cast(CASE WHEN regexp_full_match(p1, '[0-9]+') THEN p1 END AS HUGEINT) AS left_pos,
  try_cast(CASE WHEN regexp_full_match(p2, '[0-9]+') THEN p2 END AS HUGEINT) AS right_pos, idstring, note,
  CASE WHEN NOT quotes THEN 'quoting' WHEN n NOT IN (5, 6) THEN 'column_count' END AS bad FROM fus3),
fusion AS (SELECT fus.*, coalesce(bad, CASE WHEN idstring <> '' AND left_pos <= a.chrom_len AND right_pos <= b.chrom_len THEN NULL ELSE 'invalid_value' END) AS reason
  FROM fus LEFT JOIN chrom_map a ON left_chr = a.chrom LEFT JOIN chrom_map b ON right_chr = b.chrom),
man0 AS (SELECT DISTINCT line_id, series, file_no, line_no, regexp_replace(raw_line, '\\r$', '') AS body FROM manifest_raw WHERE raw_line IS NOT NULL),
man1 AS (SELECT *, contains(body, chr(9)) AS tabbed, regexp_full_match(chr(9) || body, '(\\t({_FIELD}))*') AS quotes FROM man0 WHERE regexp_matches(body, '\\S')),
man2 AS (SELECT *, list_transform(CASE WHEN tabbed THEN {_FIELDS} ELSE regexp_split_to_array(trim(body), '\\s+') END, lambda x: trim(x, ' ')) AS f FROM man1),
head AS (SELECT DISTINCT series, file_no, list_transform(f, lambda x: trim(trim(replace(x, chr(65279), '')), '"')) AS names FROM man2 WHERE line_no = 1),
manifest AS (SELECT m.line_id, m.series, m.file_no, m.f, h.names, CASE WHEN tabbed AND NOT quotes THEN 'quoting' WHEN len(f) <> len(h.names) THEN 'column_count'
  WHEN f[1] = '' OR NOT regexp_full_match(f[2], '[A-Za-z0-9_./-]*\\.isoform\\.gz') THEN 'invalid_value' END AS reason
  FROM man2 m JOIN head h USING (series, file_no) WHERE line_no <> 1)
"""
# where several candidates agree in all values, flooding decides; the SQL takes it that there is one
_DRIFT = (
    _LINES
    + """,
cols AS (SELECT series, file_no, i, names[i] AS name FROM (SELECT series, file_no, names, unnest(range(3, len(names) + 1)) AS i FROM head) WHERE names[i] <> '' AND list_position(names[3:], names[i]) = i - 2),
cells AS (SELECT series, file_no, m.f[1] AS sample, name, m.f[i] AS v FROM manifest m JOIN cols USING (series, file_no) WHERE reason IS NULL),
full_ AS (SELECT * FROM cells WHERE v NOT IN ('', 'NA', 'NULL', '.')),
kinds AS (SELECT series, file_no, name, bool_and(regexp_full_match(v, '[0-9]+')) AS whole, bool_and(regexp_full_match(v, '[0-9]+|[0-9]+\\.[0-9]*|\\.[0-9]+')) AS dec, bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS day
  FROM full_ GROUP BY ALL),
types AS (SELECT series, file_no, name, CASE WHEN whole THEN 'integer' WHEN dec THEN 'decimal' WHEN day THEN 'date' ELSE 'text' END AS kind FROM kinds),
steps AS (SELECT series, file_no, lag(file_no) OVER (PARTITION BY series ORDER BY file_no) AS prev_no FROM head),
gone AS (SELECT s.series, s.file_no, prev_no, c.name FROM steps s JOIN cols c ON c.series = s.series AND c.file_no = prev_no ANTI JOIN cols d ON d.series = s.series AND d.file_no = s.file_no AND d.name = c.name),
come AS (SELECT s.series, s.file_no, c.name FROM steps s JOIN cols c ON c.series = s.series AND c.file_no = s.file_no ANTI JOIN cols d ON d.series = s.series AND d.file_no = prev_no AND d.name = c.name WHERE prev_no IS NOT NULL),
one AS (SELECT series, file_no, sample, name, min(v) AS v FROM full_ GROUP BY ALL),
same AS (SELECT g.series, g.file_no, g.name AS old_name, c.name AS new_name FROM gone g JOIN come c USING (series, file_no) JOIN one a ON a.series = g.series AND a.file_no = g.prev_no AND a.name = g.name
  JOIN one b ON b.series = g.series AND b.file_no = g.file_no AND b.name = c.name AND b.sample = a.sample GROUP BY ALL HAVING bool_and(a.v = b.v))
SELECT series, file_no, 'renamed' AS drift, old_name, new_name FROM same
UNION ALL SELECT series, file_no, 'removed', name, '' FROM gone g WHERE NOT EXISTS (FROM same s WHERE s.series = g.series AND s.file_no = g.file_no AND old_name = name)
UNION ALL SELECT series, file_no, 'added', '', name FROM come g WHERE NOT EXISTS (FROM same s WHERE s.series = g.series AND s.file_no = g.file_no AND new_name = name)
UNION ALL SELECT s.series, s.file_no, 'retyped', a.name, a.name FROM steps s JOIN types a ON a.series = s.series AND a.file_no = prev_no JOIN types b ON b.series = s.series AND b.file_no = s.file_no AND b.name = a.name WHERE a.kind <> b.kind"""
)
_PERIODS = f"""
WITH spans AS (SELECT 'chrom' AS grain, {_BARE.format("chrom")} AS chrom, '' AS gene_id, gene_start AS s, gene_end AS e FROM gene
  UNION ALL SELECT 'gene', {_BARE.format("chrom")}, gene_id, x.s, x.e FROM (SELECT chrom, gene_id, unnest(exons) AS x FROM transcript WHERE gene_id <> '')),
good AS (SELECT DISTINCT * FROM spans WHERE e > s AND chrom <> ''),
seen AS (SELECT *, max(e) OVER (PARTITION BY grain, chrom, gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM good),
isle AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY grain, chrom, gene_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM seen),
per AS (SELECT grain, chrom, gene_id, min(s) AS start_pos, max(e) AS end_pos FROM isle GROUP BY grain, chrom, gene_id, g),
gap AS (SELECT grain, chrom, gene_id, end_pos AS start_pos, lead(start_pos) OVER (PARTITION BY grain, chrom, gene_id ORDER BY start_pos) AS end_pos FROM per)
SELECT grain, chrom, gene_id, 'period' AS kind, start_pos, end_pos FROM per
UNION ALL SELECT grain, chrom, gene_id, 'gap', start_pos, end_pos FROM gap WHERE end_pos IS NOT NULL AND (grain = 'gene' OR end_pos - start_pos <= 1000000)
"""
_KEYED = "WITH r AS (SELECT rec_id, any_value(signature) AS signature, any_value(chrom_id) AS chrom_id, any_value(total_evidence) AS total, any_value(sample_evidence_arr) AS arr FROM pnir WHERE signature IS NOT NULL AND chrom_id IS NOT NULL GROUP BY rec_id)"

SQL = {
    "p1_found": _LINES + "SELECT 'fusion_raw' AS src, line_id, reason FROM fusion WHERE reason IS NOT NULL UNION ALL SELECT 'manifest_raw', line_id, reason FROM manifest WHERE reason IS NOT NULL",
    "p1_valid_fusion": _LINES + "SELECT line_id, left_chr, left_pos::BIGINT AS left_pos, right_chr, right_pos::BIGINT AS right_pos, idstring, note FROM fusion WHERE reason IS NULL",
    "p1_valid_manifest": _LINES + "SELECT line_id, series, file_no, f[1] AS sample, f[2] AS path, len(f)::INT AS n_fields FROM manifest WHERE reason IS NULL",
    "p2_found": _DRIFT,
    "p3_found": _PERIODS,
    "p5_found": _KEYED + " SELECT signature, chrom_id FROM r GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM r)",
    "p5_records": _KEYED
    + """, c AS (SELECT signature, chrom_id, i, sum(v) AS v FROM (SELECT signature, chrom_id, unnest(arr) AS v, generate_subscripts(arr, 1) AS i FROM r) GROUP BY ALL),
v AS (SELECT signature, chrom_id, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i) AS s FROM c GROUP BY ALL),
n AS (SELECT signature, chrom_id, count(*) AS n_records, coalesce(sum(total), 0)::BIGINT AS total_evidence FROM r GROUP BY ALL)
SELECT signature, chrom_id, n_records, total_evidence, coalesce(s, '') AS sample_evidence FROM n LEFT JOIN v USING (signature, chrom_id)""",
}
