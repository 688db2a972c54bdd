"""The commands on small files, the index, and what must not be lost."""

import gzip

import pytest
from pyspark.sql import functions as F

from cohortloom import api, session
from cohortloom.operators import build, lines, packed
from cohortloom.sources import gtf, tables
from tests.conftest import rows

GTF = """chr1\t.\tgene\t101\t600\t.\t+\t.\tgene_id "G1"; gene_name "N1"; gene_type "protein_coding";
chr1\t.\ttranscript\t101\t600\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\t.\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\t.\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\t.\texon\t501\t600\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr2\t.\tgene\t1001\t1200\t.\t+\t.\tgene_id "G2"; gene_name "N2"; gene_type "protein_coding";
chr2\t.\ttranscript\t1001\t1200\t.\t+\t.\tgene_id "G2"; transcript_id "T2";
chr2\t.\texon\t1001\t1200\t.\t+\t.\tgene_id "G2"; transcript_id "T2";
chr9\t.\ttranscript\t1\t9\t.\t+\t.\tgene_id "G9"; transcript_id "T9";
chr9\t.\texon\t1\t9\t.\t+\t.\tgene_id "G9"; transcript_id "T9";
"""
SAM = {
    "a": ["r1\t0\tchr1\t101\t60\t100M100N100M100N100M\t*\t0\t0\t*\t*", "r2\t0\tchr1\t103\t60\t98M100N100M100N99M\t*\t0\t0\t*\t*\tSA:Z:chr2,1001,+,200M,60,0;", "r3\t0\tchr1\t301\t60\t100M100N100M\t*\t0\t0\t*\t*"],
    "b": ["r4\t0\tchr2\t1001\t60\t200M\t*\t0\t0\t*\t*\tSA:Z:chr1,101,+,100M,60,0;", "r5\t0\tchr2\t1050\t60\t20M\t*\t0\t0\t*\t*"],
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cohort")
    (d / "g.gtf").write_text(GTF)
    listed = ["name\tpath\tTissue"]
    for s, text in SAM.items():
        (d / f"{s}.sam").write_text("\n".join(text))
        api.write_profile(api.profile_alignments(spark, str(d / f"{s}.sam"), rname=True), str(d / s))
        listed.append(f"{s}\t{d / s}\tskin")
    (d / "manifest").write_text("\n".join(listed))
    return api.build_index(*api.merge_profiles(spark, str(d / "manifest")), str(d / "index")), api.read_transcripts(spark, str(d / "g.gtf")), gtf.genes(gtf.read_gtf(spark, str(d / "g.gtf"))), d


def test_isoform_command(index):
    idx, tx, _, d = index
    got = {(r["trans_id"], r["sample_id"]): r for r in api.query_isoform(idx, tx, info=True).collect()}
    assert got["T1", 0]["fsm"] == 2 and got["T1", 0]["info"] == "RN=r1,RN=r2" and got["T1", 0]["em_shown"] > 0 or got["T1", 0]["em_shown"] == 0
    assert got["T2", 1]["fsm"] == 1 and got["T2", 1]["em_shown"] > 0 and got["T9", None]["detected"] == "no:no:no" and got["T9", None]["confidence"] == 0
    api.write_isoform(idx, api.query_isoform(idx, tx), str(d / "out"))
    parts = sorted((d / "out").glob("part-*.gz"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode().splitlines()
    assert text[0].startswith("##[SAMPLE]a") and text[2] == "##[DBINFO]a:3,b:2" and text[3].startswith("#chrom\tstart") and text[3].endswith("FORMAT\ta\tb")
    assert [x.split("\t")[5] for x in text[4:]] == ["T1", "T2", "T9"]


def test_other_commands(spark, index):
    idx, tx, genes, _ = index
    hit = api.query_splice(idx, "chr1:200,300").collect()
    assert sorted((r["evidence"], r["n_exons"]) for r in hit) == [(2, 3)] and api.query_splice(idx, "chr1:200,300", min_read=3).count() == 0
    assert [tuple(r)[5:] for r in api.query_fusion_breakpoints(idx, "1:200,2:1000").collect()] == [(2, 2)]
    assert api.query_fusion_region(idx, "1:100-600,2:1000-1200").count() == 2
    found = api.discover_fusions(idx, genes, require_both=False).collect()
    assert [(r["gene_a"], r["gene_b"], r["total_evidence"]) for r in found] == [("N1", "N2", 2)]
    assert rows(api.view(idx, "chromosomes")) == [("1", 2), ("2", 2)] and api.open_index(spark, idx.path).n_samples == 2
    assert api.query_isoform(idx, tx.limit(0)).count() == 0
    for bad in (lambda: api.view(idx, "x"), lambda: api.query_isoform(idx, tx, flank=-1), lambda: api.query_isoform(idx, tx, em_damping_factor=0)):
        with pytest.raises(ValueError):
            bad()


def test_meta_is_validated(spark, tmp_path):
    df = spark.createDataFrame([("a", str(tmp_path)), ("b", str(tmp_path / "none"))], "name string, path string")
    assert tables.missing_paths(df) == [str(tmp_path / "none")]
    with pytest.raises(ValueError, match="do not exist"):
        tables.validate_meta(df)
    with pytest.raises(ValueError, match="more than once"):
        tables.validate_meta(df.union(df))
    assert tables.validate_meta(df.filter("name = 'a'")).columns == ["name"]


@pytest.mark.parametrize("kind", ["string", "bigint", "date"])
def test_row_numbers_of_any_key(spark, kind):
    df = spark.range(0, 500, 1, 8).select(F.when(F.col("id") % 5 > 0, F.col("id") % 100).cast("string").alias("k"), "id")
    df = df.select((F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind)).alias("k"), "id")
    got = sorted(tables.number_rows(df, "k").collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in got] == list(range(1, 501)) and len({r["id"] for r in got}) == 500
    keys = [r["k"] for r in got]
    assert keys == sorted(keys[:400]) + [None] * 100


def test_manifests_with_a_line_like_the_header(spark, tmp_path):
    (tmp_path / "one").write_text("n\tp\tT\nx\t/x\t1\nn\tp\tT\n")
    (tmp_path / "two").write_text("name path Age Age\ny /y 7 8\n")
    got = tables.read_manifest(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()
    assert {(r["name"], r["path"], tuple(r["attrs"].items())) for r in got} == {("x", "/x", (("T", "1"),)), ("n", "p", (("T", "T"),)), ("y", "/y", (("Age", "7"),))}
    assert sorted(r["sample_id"] for r in got) == [0, 1, 2]


def test_long_positions_and_lines_without_offset(spark):
    chroms = spark.createDataFrame([(1, "1", 9_223_372_036_854_775_807)], "chrom_id int, chrom string, chrom_len bigint")
    raw = spark.createDataFrame([(1, "1\t9223372036854775806\t1\t5\tid"), (2, "1\t9223372036854775808\t1\t5\tid"), (None, "1\t5\t1\t5\tid"), (None, "1\t5\t1\t5\tid")], "line_id bigint, raw_line string")
    assert [r["line_id"] for r in lines.load_fusion(raw, chroms).collect()] == [1]
    assert rows(lines.failed_fusion(raw, chroms)) == [(2, "invalid_value"), (None, "invalid_value")]


def test_skeletons_beyond_the_broadcast(spark):
    texts = ["a,b", "a,b", "a;b|c", '"a,b",c', "x"] * 300 + [",".join("abc"[: i % 3 + 1] for i in range(n)) for n in range(2, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").withColumn("skeleton", packed.skeleton(F.col("t"), ",;|- ", ""))
    often = df.groupBy("skeleton").agg(F.count("*").alias("often"))
    rules = often.mapInPandas(packed._rules(",;|- ", ""), f"skeleton string, often bigint, rule {packed.RULE}")
    a = packed.split_join(df, rules, len(texts))
    b = df.join(rules.drop("often"), "skeleton")
    assert sorted(map(str, a.select("id", "rule").collect())) == sorted(map(str, b.select("id", "rule").collect())) and a.count() == len(texts)


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Session())


def test_reads_as_a_bag(spark):
    reads = spark.createDataFrame([(1, "1", "+", [(1, 5)])] * 3, "sample_id int, chrom string, strand string, exons array<struct<s:bigint,e:bigint>>")
    one = build.collapse(build.with_signature(reads))
    assert [r["n"] for r in one.collect()] == [3] and build.profiles(one).first()["evidence"] == 3 and build.read_shapes(one).first()["n"] == 3
