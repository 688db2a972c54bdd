"""Readers and writers on small files, by round trips and by hand."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import alignments, gtf, profile_text, tables
from cohortloom.streaming import ingest
from tests.conftest import rows

GTF = """# made up
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1";
chr1\tx\tgene\t101\t400\t.\t+\t.\tgene_id "G1"; gene_name "N1"; gene_type "protein_coding";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\ttranscript\t101\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr2\tx\ttranscript\t1\t50\t.\t.\t.\tgene_id "G2"; transcript_id "T2";
short line
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_gtf(spark, tmp_path, zipped):
    path = tmp_path / ("a.gtf.gz" if zipped else "a.gtf")
    path.write_bytes(gzip.compress(GTF.encode()) if zipped else GTF.encode())
    df = gtf.read_gtf(spark, str(path))
    tx = gtf.transcripts(df).collect()
    assert len(tx) == 1 and tx[0]["start"] == 100 and [tuple(x) for x in tx[0]["exons"]] == [(100, 200), (300, 400)] and [tuple(x) for x in tx[0]["sj"]] == [(200, 300)] and tx[0]["gene_id"] == "G1"
    g = gtf.genes(df).collect()
    assert [(r["gene_name"], r["gene_type"], r["sites"]) for r in g] == [("N1", "protein_coding", [100, 200, 300, 400])]
    reads = gtf.transcripts_as_reads(gtf.transcripts(df), 3).collect()
    assert [(p["k"], p["v"]) for p in reads[0]["info"]] == [("TID", "T1"), ("GID", "G1")]
    path.write_text("") if not zipped else path.write_bytes(gzip.compress(b""))
    assert gtf.transcripts(gtf.read_gtf(spark, str(path))).count() == 0


RECORDS = [("r1", 0, "chr1", 99, 60, "50M100N20M5I30M", "chr2,101,+,30M20N10M,60,0;"), ("r2", 16, "chr1", 9, 60, "10M", None), ("r3", 4, None, -1, 0, "*", None), ("r4", 256, "chr1", 9, 60, "10M", None), ("r5", 2048, "chr1", 9, 60, "10M", None), ("r6", 0, "chr1", 9, 1, "10M", None)]


def bam(path):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, chrom, pos, mapq, cigar, sa in RECORDS:
        ops = [] if cigar == "*" else [(int(n), "MIDNSHP=X".index(o)) for n, o in __import__("re").findall(r"(\d+)([MIDNSHP=X])", cigar)]
        tags = b"NMC\1" + b"XBBs" + struct.pack("<i2h", 2, 1, 2) + (b"SAZ" + sa.encode() + b"\0" if sa else b"")
        body = struct.pack("<iiBBHHHiiii", 0 if chrom else -1, pos, len(name) + 1, mapq, 0, len(ops), flag, 3, -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\x12\x40" + b"\xff" * 3 + tags
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    path.write_bytes(gzip.compress(out[:half]) + gzip.compress(out[half:]))


def test_alignments(spark, tmp_path):
    bam(tmp_path / "a.bam")
    lines = ["@HD\tVN:1"] + ["\t".join([n, str(f), c or "*", str(p + 1), str(q), g, "*", "0", "0", "ACG", "***", "NM:i:1"] + ([f"SA:Z:{s}"] if s else [])) for n, f, c, p, q, g, s in RECORDS]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    a, b = alignments.read_bam(spark, [str(tmp_path / "a.bam")]), alignments.read_sam(spark, str(tmp_path / "a.sam"))
    assert [r[1:] for r in rows(a) if r[3]] == [r[1:] for r in rows(b) if r[3] != "*"]
    reads = {tuple(map(tuple, r["exons"])): r for r in alignments.profile_alignments(a, rname=True).collect()}
    assert {r["info"][0]["v"] for r in alignments.profile_alignments(a, rname=True).collect()} == {"r1", "r2", "r5"}
    assert [tuple(s) for s in reads[(99, 149), (249, 299)]["supp"]] == [("2", 100, 130, "+"), ("2", 150, 160, "+")]
    assert alignments.profile_alignments(a, use_secondary=True).count() == 4


def test_profile_text(spark, tmp_path):
    lines = ["1\t2", profile_text.HEADER, "17\t2\t1\t100-200,300-400\t90-450:+:2%5%9%+,2%20%30%-:RN=a;TID=b=c|91-450:-::", "18446744073709551615\t1\t2\t5-9\t5-9:+:"]
    (tmp_path / "s.isoform").write_text("\n".join(lines))
    df = profile_text.read_profiles(spark, str(tmp_path / "s.isoform"))
    r = {int(x["sig"]): x for x in df.collect()}
    assert [tuple(j) for j in r[17]["sj"]] == [(100, 200), (300, 400)] and r[17]["reads"][0]["info"][1]["v"] == "b=c" and r[17]["reads"][1]["supp"] == [] and len(r) == 2
    profile_text.write_profile(df.drop("path"), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).collect()
    assert [x[0] for x in again][:2] == lines[:2]
    assert rows(profile_text.parse(spark.read.text(str(tmp_path / "out")))) == rows(df.drop("path"))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("n\tp\tTissue\na\t/x\tskin\n\nb\t/y\tgut\na\t/z\tgill\n")
    m = tables.read_manifest(spark, str(tmp_path / "m.tsv")).collect()
    assert [(r["sample_id"], r["name"], r["path"], r["attrs"]) for r in m] == [(0, "a", "/x", {"Tissue": "skin"}), (1, "b", "/y", {"Tissue": "gut"})]
    (tmp_path / "bad.tsv").write_text("n\tp\tTissue\na\t/x\n")
    with pytest.raises(Exception, match="does not fit"):
        tables.read_manifest(spark, str(tmp_path / "bad.tsv")).collect()
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert rows(tables.duplicate_samples(df)) == [("a", 2)]


def test_split_manifest(spark):
    shards = lambda n, size: [r["shard"] for r in tables.split_manifest(spark.range(n), "id", size).orderBy("id").collect()]
    assert shards(4, 2) == [1, 1, 2, 2] and shards(5, 2) == [1, 1, 2, 2, 3] and shards(1000, 100) == [i // 100 + 1 for i in range(1000)]
    with pytest.raises(ValueError):
        shards(1, 0)


def test_query_strings():
    assert tables.parse_junction("chr1:200,100") == ("1", 100, 200)
    assert tables.parse_breakpoints("chr1:5, chrX:7") == ("1", 5, "X", 7)
    assert tables.parse_regions("1:5-9,2:1-1") == ("1", 5, 9, "2", 1, 1)
    for bad in ("1:5", "1:a,b", "1:9-5,2:1-2", ""):
        with pytest.raises(ValueError):
            tables.parse_regions(bad)


def test_result_table(spark, tmp_path):
    df = spark.createDataFrame([("t1", "a", "1:2"), ("t2", "b", "3:4"), ("t1", "b", "5:6")], "tx string, sample string, cell string")
    w = tables.wide(df, ["tx"], "sample", "cell", ["a", "b"], "0:0")
    tables.write_result_table(w, ["tx"], ["a", "b"], {"a": 7, "b": 9}, "COUNT:CPM", str(tmp_path / "r"), ["x y"])
    back, totals, keys, samples = tables.read_result_table(spark, str(tmp_path / "r"))
    assert totals == {"a": 7, "b": 9} and keys == ["tx"] and samples == ["a", "b"]
    assert rows(back) == [("t1", "a", "1:2"), ("t1", "b", "5:6"), ("t2", "a", "0:0"), ("t2", "b", "3:4")]
    with pytest.raises(Exception, match="both tables"):
        tables.merge_results(df, df, ["tx"]).collect()


def test_stream(spark, tmp_path):
    row = lambda s, n: spark.createDataFrame([("p", s, "1", [(1, 2)], n)], "pid string, sample_id int, chrom string, sj array<struct<d:bigint,a:bigint>>, evidence bigint")
    schema = "pid string, sample_id int, chrom string, sj array<struct<d:bigint,a:bigint>>, evidence bigint"
    for s, n in ((0, 2), (1, 3), (0, 4)):
        row(s, n).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_batches(ingest.stream_profiles(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["sample_id"], r["evidence"]) for r in ingest.cohort_profile(spark, str(tmp_path / "out")).collect()) == [(0, 6), (1, 3)]


def test_merge_isoform(spark):
    schema = "tx string, min_read int, positives string, sample string, cell string"
    a = spark.createDataFrame([("t1", 1, "1:1:0/2", "a", "0:4:0:4:0:0"), ("t1", 1, "1:1:0/2", "b", "0:0:0:0:0:0"), ("t2", 1, "0:0:0/2", "a", "0:0:0:0:0:0"), ("t2", 1, "0:0:0/2", "b", "0:0:0:0:0:0")], schema)
    b = spark.createDataFrame([("t1", 1, "1:0:1/1", "c", "0:2:0:0:0:2"), ("t2", 1, "0:0:0/1", "c", "0:0:0:0:0:0")], schema)
    totals = {"a": 1000, "b": 1000}, {"c": 500}
    got = tables.merge_isoform(a, b, ["tx", "min_read"], *totals).collect()
    head = {(r["tx"], r["detected"], r["positives"], round(r["confidence"], 6)) for r in got}
    # two of three samples, both with 4000 counts per million; g = 2 * (1 * 4 + 2 * 2) / (3 * 6) - 4 / 3
    assert head == {("t1", "yes:yes:yes", "2:1:1/3", round(2 / 3 * 4000 * (1 - (16 / 18 - 4 / 3)), 6)), ("t2", "no:no:no", "0:0:0/3", 0.0)}
    assert len(got) == 6 and {r["cell"] for r in got if (r["tx"], r["sample"]) == ("t1", "c")} == {"0:2:0:0:0:2"}
    with pytest.raises(Exception, match="do not align"):
        tables.merge_isoform(a, b.filter("tx = 't1'"), ["tx", "min_read"], *totals).collect()
    with pytest.raises(ValueError, match="both tables"):
        tables.merge_isoform(a, a, ["tx", "min_read"], totals[0], totals[0])


def test_regions_and_names():
    assert tables.region_query("1", 100, 200, "2", 5, 8) == ("1", 150, 50, "2", 6, 1)
    assert tables.is_single_bp(5, 5, 7, 7) and not tables.is_single_bp(5, 5, 7, 8)
    assert tables.trim_prefix("chrchr1", "chr") == "1" and tables.trim_prefix("chr1", None) == "chr1" and tables.add_prefix("1", "chr") == "chr1"
    assert [tables.add_gz_suffix(p) for p in ("file.txt", "file.txt.gz", "file", "file.")] == ["file.txt.gz", "file.txt.gz", "file.gz", "file.gz"]
