"""Operators on general problems against plain Python over whole small tables, and their defined cases."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import drift, hotkeys, lines, packed, periods
from cohortloom.session import table
from tests import plain
from tests.conftest import rows


def recs(spark, d, name):
    return [r.asDict(recursive=True) for r in table(spark, d, name).collect()]


@pytest.fixture(scope="module", params=["sf0.001"])
def d(request):
    return f"/root/testdata/{request.param}"


def test_failed_lines(spark, d):
    chroms = {r["chrom"]: r["chrom_len"] for r in recs(spark, d, "chrom_map")}
    t = lambda n: table(spark, d, n)
    got = lines.failed_lines(t("fusion_raw"), t("manifest_raw"), t("chrom_map")).collect()
    want = plain.failed(recs(spark, d, "fusion_raw"), recs(spark, d, "manifest_raw"), chroms)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    # none is lost: valid and failed lines are all records
    valid = lines.load_fusion(t("fusion_raw"), t("chrom_map")).count()
    assert valid + sum(r["src"] == "fusion_raw" for r in got) == lines.fusion_records(t("fusion_raw")).count()
    valid = lines.load_manifest(t("manifest_raw")).count()
    assert valid + sum(r["src"] == "manifest_raw" for r in got) == lines.manifest_records(t("manifest_raw")).count()


def test_schema_changes(spark, d):
    got = drift.schema_changes(table(spark, d, "manifest_raw")).collect()
    want = plain.changes(recs(spark, d, "manifest_raw"))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_periods(spark, d):
    got = {tuple(r) for r in periods.all_periods(table(spark, d, "gene"), table(spark, d, "transcript")).collect()}
    genes = [((plain.bare(r["chrom"]),), r["gene_start"], r["gene_end"]) for r in recs(spark, d, "gene")]
    exons = [((plain.bare(r["chrom"]), r["gene_id"]), x and x["s"], x and x["e"]) for r in recs(spark, d, "transcript") for x in r["exons"] or []]
    want = {("chrom", k[0], "", *x) for k, *x in plain.periods(genes, 1_000_000)} | {("gene", k[0], k[1], *x) for k, *x in plain.periods(exons)}
    assert got == want


def test_unpack(spark, d):
    t = lambda n: table(spark, d, n)
    got = packed.unpack_tables(t("gene"), t("sample_chip"), t("transcript")).collect()
    want = set()
    for src, key, col in (("gene", "gene_idx", "splice_sites"), ("sample_chip", "chip_id", "init_string"), ("transcript", "tx_idx", "orig_attrs")):
        for r in recs(spark, d, src):
            want |= {(src, r[key], n, p) for n, p in plain.pieces(r[col] or "", **packed.STYLES[src])}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_hot_keys(spark, d):
    pnir = table(spark, d, "pnir")
    assert {tuple(r) for r in hotkeys.hot_keys(pnir).collect()} == plain.hot(recs(spark, d, "pnir"))
    got = {(r[0], r[1]): [r[2], r[3], r[4]] for r in hotkeys.cohort_records(pnir, chunk_rows=100).collect()}
    assert got == plain.keyed(recs(spark, d, "pnir"))


def test_numbers_in_key_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 7).alias("k"))
    got = hotkeys.number_in_key(df.union(df), ["k"], "rec_id", 16).groupBy("k").agg(F.count("*").alias("n"), F.min("n_in_key"), F.max("n_in_key"), F.countDistinct("n_in_key").alias("u")).collect()
    assert all(r[1] == r["u"] and r[2] == 0 and r[3] == r["n"] - 1 for r in got)


@pytest.mark.parametrize(
    ("line", "why"),
    [
        ("chr1\t10\tX\t20\tid", None),
        ("chr1\t10\tX\t20\tid\r", None),
        (' CHRchr1 \t 010 \tx\t20\t"a\tb"', None),
        ("1\t10\tX\t20\tid\tnote\tmore", "column_count"),
        ('1\t10\tX\t20\t"id', "quoting"),
        ('1\t10\tX\t20\t"id"x', "quoting"),
        ('1\t10\tX\t20\tid "b', None),
        ("1\t10\tX\t2000\tid", "invalid_value"),
        ("1\t99999999999999999999999\tX\t20\tid", "invalid_value"),
        ("1\t10\tX\t20\t  ", "invalid_value"),
        ("1\t10\tX\t20\t", "invalid_value"),
        ("7\t10\tX\t20\tid", "invalid_value"),
        ("", "none"),
        (None, "none"),
        ("# x", "none"),
        ("1\t10\tX\t20\t" + '"' + '""' * 50_000 + '"', None),
        ("\t" * 50_000, "none"),
        ("1\t" * 50_000, "column_count"),
    ],
)
def test_fusion_line_cases(spark, line, why):
    raw = spark.createDataFrame([(1, line), (1, line)], "line_id bigint, raw_line string")
    chroms = spark.createDataFrame([("1", 1000), ("X", 1000)], "chrom string, chrom_len bigint")
    bad = [r["reason"] for r in lines.failed_fusion(raw, chroms).collect()]
    good = lines.load_fusion(raw, chroms).count()
    assert (bad, good) == ([], 0) if why == "none" else ([], 1) if why is None else (bad, good) == ([why], 0)


def test_empty_tables(spark, sf):
    t = lambda n: table(spark, sf, n).limit(0)
    assert rows(lines.failed_lines(t("fusion_raw"), t("manifest_raw"), t("chrom_map"))) == []
    assert rows(drift.schema_changes(t("manifest_raw"))) == []
    assert rows(drift.consistent_table(t("manifest_raw"))) == []
    assert rows(periods.all_periods(t("gene"), t("transcript"))) == []
    assert rows(packed.unpack_tables(t("gene"), t("sample_chip"), t("transcript"))) == []
    assert rows(hotkeys.hot_keys(t("pnir"))) == [] and rows(hotkeys.cohort_records(t("pnir"))) == []


def test_extra_columns_do_not_clash(spark, sf):
    add = lambda df: df.withColumns({c: F.lit("x") for c in ("names", "body", "bin", "pos", "d", "chunk", "bucket", "tokens", "rule", "f")})
    t = lambda n: add(table(spark, sf, n))
    assert lines.failed_lines(t("fusion_raw"), t("manifest_raw"), t("chrom_map")).count() > 0
    assert periods.all_periods(t("gene"), t("transcript")).count() > 0
    assert packed.unpack(t("gene"), "gene_idx", "splice_sites", **packed.STYLES["gene"]).count() > 0
    assert hotkeys.cohort_records(t("pnir")).count() > 0


def test_periods_cross_bins(spark):
    df = spark.createDataFrame([("a", 0, 10 * periods.BIN), ("a", 3, 5), ("a", 12 * periods.BIN, 12 * periods.BIN + 1), ("a", 5, 5), ("a", None, 7), (None, 1, 2), ("", 1, 2)], "k string, s bigint, e bigint")
    got = rows(periods.periods_and_gaps(df.union(df), ["k"], "s", "e"))
    assert got == [("a", "gap", 10 * periods.BIN, 12 * periods.BIN), ("a", "period", 0, 10 * periods.BIN), ("a", "period", 12 * periods.BIN, 12 * periods.BIN + 1)]


@pytest.mark.parametrize(
    ("text", "style", "want"),
    [
        ("a,,b", "gene", [(1, "a"), (3, "b")]),
        (";a;", "gene", [(2, "a")]),
        ('"1,0"- \'x"y\' z', "gene", [(1, "1,0"), (2, 'x"y'), (3, "z")]),
        ('"a""b",c', "gene", [(1, 'a"b'), (2, "c")]),
        ('"a,b', "gene", [(1, '"a'), (2, "b")]),
        ("0.5: : 1", "sample_chip", [(1, "0.5"), (3, "1")]),
        (' k "a;b" ; tag=x|n : 3;free', "transcript", [(1, "k:a;b"), (2, "tag:x"), (3, "n:3"), (4, "free")]),
        ("k = 'it''s'", "transcript", [(1, "k:it's")]),
        ("   ", "gene", []),
        (None, "gene", []),
        ("x" * 100_000 + "," + "," * 50_000 + "y", "gene", [(1, "x" * 100_000), (50_002, "y")]),
    ],
)
def test_unpack_cases(spark, text, style, want):
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    got = sorted((r[1], r[2]) for r in packed.unpack(df, "id", "t", **packed.STYLES[style]).collect())
    assert got == want


def test_all_lines_of_a_sample_count(spark):
    files = {1: ["n\tp\tage", "a\t/a.isoform.gz\t5", "a\t/b.isoform.gz\tx", "b\t/c.isoform.gz\t7", "b\t/c.isoform.gz\t"], 2: ["n\tp\tage", "a\t/a.isoform.gz\t5"]}
    raw = [(100 * k + i, "s", k, i, v) for k, text in files.items() for i, v in enumerate(text, 1)]
    df = spark.createDataFrame(raw, "line_id bigint, series string, file_no int, line_no int, raw_line string")
    assert rows(drift.schema_changes(df)) == [("s", 2, "retyped", "age", "age")]
    got = [(r[1], r[2], r[4]) for r in drift.consistent_table(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a", "5"), (1, "a", "x"), (1, "b", "7"), (1, "b", None), (2, "a", "5")], key=repr)
