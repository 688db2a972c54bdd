"""Queries that must take their whole tables; plain loops over the small tables give what is expected."""

from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import functions as F

from cohortloom.operators.rangejoin import cross_keys, lots
from cohortloom.plans import reference
from cohortloom.plans.projection import Cohort
from tests.conftest import rows
from tests.oracle import compare, views


def test_range_scan_looks_up_every_transcript(spark, sf):
    c = Cohort(spark, sf)
    by_chrom = defaultdict(list)
    for r in c.site.select("chrom", "pos", "pid", "kind").collect():
        by_chrom[r["chrom"]].append((r["pos"], r["pid"], r["kind"]))
    for v in by_chrom.values():
        v.sort()
    want = set()
    for t in c.tx.select("tx_idx", "chrom", "start", "end").collect():
        at = by_chrom[t["chrom"]]
        lo, hi = bisect_left(at, (t["start"],)), bisect_right(at, (t["end"] + 1,))
        want |= {(t["tx_idx"], pid, kind) for _, pid, kind in at[lo:hi]}
    got = rows(reference.QUERIES["ref_j3_range_scan"](spark, sf))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(tx_idx % 20 for tx_idx, _, _ in got)


def test_range_scan_is_written_out_by_many_tasks(spark, sf):
    n = [r["count"] for r in reference.QUERIES["ref_j3_range_scan"](spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) > 2 and max(n) < 0.6 * sum(n)


def test_range_scan_of_repeated_transcripts(spark, sf, tmp_path):
    part = spark.read.parquet(f"{sf}/part.parquet")
    again = part.filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 2)
    odd = part.filter("p_partkey < 5").withColumn("p_brand", F.lit(None).cast("string"))
    part.unionByName(again).unionByName(part.filter("p_partkey % 5 = 0")).unionByName(odd).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_partkey < 60").write.parquet(f"{tmp_path}/lineitem.parquet")
    why = compare(spark, views(tmp_path), str(tmp_path), reference.QUERIES["ref_j3_range_scan"], reference.SQL["ref_j3_range_scan"])
    assert why is None


def test_lots_of_a_hot_key(spark):
    a = spark.createDataFrame([("hot", i) for i in range(1000)] + [("hot", 7), ("x", 1), ("only a", 2), (None, 3)], "k string, v long")
    b = spark.createDataFrame([("hot", "p", 1), ("hot", None, 2), ("hot", "p", 1), ("x", "q", 3), ("only b", "r", 4), (None, "s", 5)], "k string, w string, u int")
    cut = lots(a, "k", "_a", 64).select(F.size("_a").alias("n")).collect()
    assert max(r["n"] for r in cut) <= 64 and sum(r["n"] for r in cut) == a.count()
    assert rows(cross_keys(a, b, "k")) == rows(a.join(b, "k").select("v", "w", "u"))
    assert not rows(cross_keys(a.limit(0), b, "k"))


def test_segments_of_every_transcript(spark, sf):
    tx = Cohort(spark, sf).tx.select("tx_idx", "chrom", "start", "end").collect()
    points = defaultdict(set)
    for t in tx:
        points[t["chrom"]] |= {t["start"], t["end"]}
    points = {k: sorted(v) for k, v in points.items()}
    want = []
    for t in tx:
        at = points[t["chrom"]]
        at = at[bisect_left(at, t["start"]) : bisect_right(at, t["end"])]
        want += [(t["chrom"], a, b, t["tx_idx"]) for a, b in zip(at, at[1:])]
    got = rows(reference.QUERIES["ref_w2_elementary_segments"](spark, sf))
    assert got == sorted(want, key=repr)
    assert any(r[3] % 10 for r in got)
