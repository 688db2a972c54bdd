"""Operators of cohort analysis on cases worked out by hand, and against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortloom.functions import genome as g
from cohortloom.operators import build, em, fusion, match, splice, stats
from cohortloom.operators.rangejoin import flank_join, interval_join, range_join
from tests.conftest import rows

PAIRS = "array<struct<d:bigint,a:bigint>>"
EXONS = "array<struct<s:bigint,e:bigint>>"


def one(spark, column):
    v = spark.range(1).select(column.alias("v")).first()["v"]
    return [tuple(x) if isinstance(x, Row) else x for x in v] if isinstance(v, list) else tuple(v) if isinstance(v, Row) else v


def arr(pairs, kind):
    a, b = ("d", "a") if kind == PAIRS else ("s", "e")
    return F.array(*(F.struct(F.lit(x).cast("bigint").alias(a), F.lit(y).cast("bigint").alias(b)) for x, y in pairs)).cast(kind)


@pytest.mark.parametrize(("exons", "want"), [([(100, 200), (300, 400), (500, 600)], [(200, 300), (400, 500)]), ([(100, 200)], [(100, 200)]), ([], [])])
def test_junctions(spark, exons, want):
    assert one(spark, build.junctions(arr(exons, EXONS))) == want


def test_cigar_and_sa(spark):
    assert one(spark, build.cigar_exons(F.lit(100), F.lit("10S50M100N20M5I30M"))) == [(100, 150), (250, 300)]
    assert one(spark, build.cigar_exons(F.lit(5), F.lit("*"))) == []
    assert one(spark, build.sa_segments(F.lit("chr2,101,+,30M20N10M,60,0;"))) == [("2", 100, 130, "+"), ("2", 150, 160, "+")]
    assert one(spark, build.sa_segments(F.lit(None).cast("string"))) == []


def test_names_and_ranges(spark):
    names = ["chr1", "CHRX", "ChrUn_a", "7", " chrChr16 ", None]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(g.bare_chrom("c")).collect()] == ["1", "X", "UN_A", "7", "16", None]
    lit = lambda x: F.lit(x).cast("bigint")
    assert [one(spark, g.clamped_diff(lit(a), lit(b))) for a, b in ((5, 8), (8, 5), (2**40, 0))] == [-3, 3, 2147483647]
    assert [one(spark, g.overlaps(*map(F.lit, x))) for x in ((1, 5, 5, 9), (1, 4, 5, 9))] == [True, False]
    assert one(spark, g.overlaps(F.lit(float("nan")), F.lit(5.0), F.lit(1.0), F.lit(9.0))) is False
    assert [one(spark, g.cpm(lit(a), lit(b))) for a, b in ((5, 2_000_000), (0, 10), (3, 0))] == [2.5, 0.0, 0.0]


def test_sorted_segments(spark):
    seg = lambda p, c, s: F.struct(F.lit(p).alias("is_supp"), F.lit(c).alias("chrom"), F.lit(s).alias("s"), F.lit(s + 1).alias("e"), F.lit("+").alias("strand"))
    got = one(spark, F.transform(build.sorted_segments(F.array(seg(True, "1", 1), seg(False, "2", 9), seg(False, "2", 3))), lambda x: F.struct(x["is_supp"], x["s"])))
    assert got == [(False, 3), (False, 9), (True, 1)]


READS = f"sample_id int, chrom string, strand string, exons {EXONS}"


def test_build_conserves_evidence(spark):
    data = [(1, "1", "+", [(100, 200)]), (1, "1", "+", [(100, 200)]), (2, "1", "-", [(90, 200)]), (1, "1", "+", [(90, 200), (300, 400)]), (2, "1", "+", [(300, 410), (95, 200)]), (1, "1", "+", []), (2, "1", "+", None)]
    reads = build.with_signature(spark.createDataFrame(data, READS))
    prof, shapes = build.profiles(reads), build.read_shapes(reads)
    pnir = build.cohort(prof, shapes)
    got = {str([tuple(j) for j in r["sj"]]): (r["total_evidence"], r["n_samples"], r["is_mono"]) for r in pnir.collect()}
    assert got == {"[(100, 200)]": (2, 1, True), "[(90, 200)]": (1, 1, True), "[(200, 300)]": (2, 2, False)}
    site = build.site_postings(pnir, shapes)
    assert {(r["pos"], r["kind"]) for r in site.collect()} == {(200, "sj"), (300, "sj"), (100, "sj"), (90, "sj"), (90, "term"), (95, "term"), (100, "term"), (200, "term"), (400, "term"), (410, "term")}


def test_a_junction_and_a_span_share_a_signature(spark):
    data = [(1, "1", "+", [(100, 200)]), (1, "1", "+", [(50, 100), (200, 300)])]
    reads = build.with_signature(spark.createDataFrame(data, READS))
    pnir = build.cohort(build.profiles(reads), build.read_shapes(reads)).collect()
    assert len(pnir) == 1 and not pnir[0]["is_mono"]


def test_range_joins_agree_with_plain_ones(spark):
    rng = random.Random(3)
    q = [(i, rng.choice("AB"), rng.randint(0, 3000), rng.randint(0, 400)) for i in range(60)] + [(99, None, 5, 5)]
    p = [(i, rng.choice("AB"), rng.randint(0, 3000), rng.randint(0, 300)) for i in range(200)]
    qd = spark.createDataFrame([(i, c, a, a + n) for i, c, a, n in q], "q int, chrom string, qs bigint, qe bigint")
    pd = spark.createDataFrame([(i, c, a, a + n) for i, c, a, n in p], "p int, chrom string, ps bigint, pe bigint")
    for flank in (0, 10, 200):
        got = sorted((r["q"], r["p"]) for r in flank_join(qd, pd.withColumnRenamed("ps", "pos"), "qs", "pos", flank).collect())
        assert got == sorted((i, j) for i, c, a, _ in q for j, d, b, _ in p if c == d and abs(a - b) <= flank)
    got = sorted((r["q"], r["p"]) for r in range_join(qd, pd.withColumnRenamed("ps", "pos"), F.col("qs"), F.col("qe"), "pos", 128).collect())
    assert got == sorted((i, j) for i, c, a, n in q for j, d, b, _ in p if c == d and a <= b <= a + n)
    got = sorted((r["q"], r["p"]) for r in interval_join(qd, pd, "qs", "qe", "ps", "pe", 128).collect())
    assert got == sorted((i, j) for i, c, a, n in q for j, d, b, m in p if c == d and a <= b + m and b <= a + n)


def test_full_match(spark):
    tx = spark.createDataFrame([(1, "1", [(200, 300)], False)], f"tx_idx int, chrom string, sj {PAIRS}, is_mono boolean")
    post = [("1", 205, "a", 2), ("1", 295, "a", 2), ("1", 205, "b", 4), ("1", 295, "b", 4), ("1", 400, "b", 4), ("1", 500, "b", 4), ("1", 189, "c", 2), ("1", 300, "c", 2)]
    site = spark.createDataFrame([(*x, "sj") for x in post * 2], "chrom string, pos bigint, pid string, n_sites int, kind string")
    hits = match.site_hits(match.tx_sites(tx), site, 10)
    assert rows(match.full_matches(hits, tx)) == [(1, "a")]
    assert rows(match.partial_matches(hits)) == [(1, "a"), (1, "b")]
    assert rows(match.full_matches(match.site_hits(match.tx_sites(tx), site.limit(0), 10), tx)) == []


@pytest.mark.parametrize(
    ("ref", "rec", "want"),
    [
        ([(1000, 1100), (1200, 1300), (1400, 1500)], [(1205, 1295), (1400, 1500)], (True, 1, 2)),
        ([(1000, 1100), (1200, 1300), (1400, 1500)], [(1000, 1100), (1400, 1500)], (False, 0, 1)),
        ([(1000, 1100)], [(1000, 1100), (1200, 1300)], (False, -1, 0)),
        ([(1000, 1100)], [(1011, 1100)], (False, -1, 0)),
        ([(1000, 1100), (1200, 1300)], [(1200, 1300)], (True, 1, 1)),
    ],
)
def test_chain(spark, ref, rec, want):
    assert one(spark, match.chain(arr(ref, PAIRS), arr(rec, PAIRS), 10)) == want


@pytest.mark.parametrize(("strand", "left", "right", "ok"), [("+", 995, 19000, True), ("+", 985, 19000, False), ("+", 1000, 11000, False), ("-", 9000, 19000, True), ("-", 9001, 19000, False)])
def test_windows(spark, strand, left, right, ok):
    assert one(spark, match.within_ends(F.lit(left), F.lit(right), F.lit(1000), F.lit(20000), F.lit(strand))) is ok


def test_groups_and_segments(spark):
    df = spark.createDataFrame([(1, "1", 1, 10), (2, "1", 5, 8), (3, "1", 10, 12), (4, "1", 20, 30), (5, "2", 1, 2)], "id int, chrom string, start bigint, end bigint")
    assert rows(match.overlap_groups(df).select("id", "group_id")) == [(1, 1), (2, 1), (3, 1), (4, 20), (5, 1)]
    df = spark.createDataFrame([("1", 1, 5, 0), ("1", 3, 7, 1), ("1", 1, 10, 2), ("1", 4, 4, 3)], "chrom string, start bigint, end bigint, id int").filter("id < 3")
    got = {}
    for r in match.elementary_segments(df, "chrom", "start", "end", "id").collect():
        got.setdefault((r["seg_start"], r["seg_end"]), set()).add(r["id"])
    assert got == {(1, 3): {0, 2}, (3, 5): {0, 1, 2}, (5, 7): {1, 2}, (7, 10): {2}}


def test_at_least(spark):
    hits = spark.createDataFrame([("q", 1, "p", 3), ("q", 2, "p", 3)], "q string, q_pos bigint, pid string, n int")
    assert [match.at_least(hits, "q", k, F.col("n")).count() for k in (1, 2, 3, 0)] == [1, 1, 0, 0]


def test_unclaimed_depends_on_order(spark):
    tx = spark.createDataFrame([(1, "1", 0, 10, 0), (2, "1", 5, 20, 0), (3, "1", 100, 200, 100)], "tx_idx int, chrom string, start bigint, end bigint, group_id bigint")
    part = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "tx_idx int, pid string")
    fsm = spark.createDataFrame([(2, "x")], "tx_idx int, pid string")
    assert rows(match.unclaimed(part, fsm, tx)) == [(1, "x"), (3, "x")]


def test_confidence(spark):
    df = spark.createDataFrame([("t", 999, 10000), ("t", 0, 20000), ("t", 0, 30000), ("t", 0, 40000), ("z", 0, 5)], "k string, x bigint, t bigint")
    got = {r["k"]: r["confidence"] for r in stats.confidence(df, "k", "x", "t", 4).collect()}
    assert math.isclose(got["t"], 43706.25) and got["z"] == 0.0


def test_em_by_hand():
    once = em.Settings(max_iter=1)
    w = np.array([0.25])
    assert np.isclose(em.solve(w, [np.array([0])], np.array([[10.0]]), once), 3.07).all()
    assert np.isclose(em.solve(np.array([0.25, 0.25]), [np.array([0, 1])], np.array([[10.0]]), once), 1.57).all()
    assert em.solve(np.array([0.0]), [np.array([0])], np.array([[10.0]]), once).sum() == 0


def plain_em(weight, member, cov, opts):
    """Loops over transcripts, classes and samples, written apart from the array version."""
    n, m = len(weight), len(cov[0]) if cov else 0
    alive = [[any(t in c and cov[k][s] > 0 for k, c in enumerate(member)) and weight[t] > 0 for s in range(m)] for t in range(n)]
    a = [[opts.start if alive[t][s] else 0.0 for s in range(m)] for t in range(n)]
    for _ in range(opts.max_iter):
        new = [[0.0] * m for _ in range(n)]
        for s in range(m):
            for k, c in enumerate(member):
                total = sum(a[t][s] * weight[t] for t in c)
                for t in c:
                    if total > 0:
                        new[t][s] += cov[k][s] * a[t][s] * weight[t] / total
        worst = 0.0
        for t in range(n):
            for s in range(m):
                v = opts.damping * new[t][s] + (1 - opts.damping) * a[t][s] if alive[t][s] else 0.0
                if alive[t][s]:
                    worst = max(worst, abs(v - a[t][s]) / (1 if abs(a[t][s]) < 1e-6 else abs(a[t][s])))
                a[t][s] = v
        if worst <= opts.conv_min_diff:
            break
    return a


def test_em_against_plain_loops():
    rng = random.Random(5)
    for _ in range(30):
        n, k, s = rng.randint(1, 5), rng.randint(1, 6), rng.randint(1, 3)
        weight = [rng.choice([0.0, 0.25, 0.2, 1 / 7]) for _ in range(n)]
        member = [sorted(rng.sample(range(n), rng.randint(1, n))) for _ in range(k)]
        cov = [[rng.choice([0, 0, 3, 11]) for _ in range(s)] for _ in range(k)]
        opts = em.Settings(max_iter=rng.choice([1, 5, 100]))
        got = em.solve(np.array(weight), [np.array(c) for c in member], np.array(cov, dtype=float), opts)
        want = np.array(plain_em(weight, member, cov, opts))
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_a_group_settles_as_a_whole():
    """Mono- and multi-exon transcripts of a group iterate together, and atoms stand for several transcripts."""
    one = lambda *cids: [{"cid": c, "k": k} for c, k in cids]
    cls = pd.DataFrame({"members": [one(("a", 2)), one(("a", 1), ("b", 1)), one(("mono:m", 1))], "sample_id": [0, 0, 0], "cov": [40.0, 7.0, 1000.0]})
    info = pd.DataFrame([("a", 2, 2, 0, 3), ("a", 2, 2, 1, 2), ("b", 1, 1, 0, 1), ("mono:m", 0, 1, 0, 1)], columns=["cid", "n_sj", "covered", "atom", "times"])
    got = {(r.cid, r.atom): r.em for r in em.solve_group(cls, info, em.Settings()).itertuples()}
    w = [1 / 4] * 5 + [1 / 3, 1.0]
    want = plain_em(w, [[0, 1, 2, 3, 4], [0, 1, 2, 5], [6]], [[40.0], [7.0], [1000.0]], em.Settings())
    assert np.allclose([got["a", 0], got["a", 1], got["b", 0], got["mono:m", 0]], [want[0][0], want[3][0], want[5][0], want[6][0]], rtol=1e-9)
    alone = plain_em([1.0], [[0]], [[1000.0]], em.Settings())[0][0]
    assert not math.isclose(alone, plain_em([1 / 4], [[0]], [[7.0]], em.Settings())[0][0])
    # a chain whose junctions are not all covered takes no part
    info.loc[info.cid == "b", "covered"] = 0
    assert "b" not in set(em.solve_group(cls, info, em.Settings()).cid)


def test_matches_by_chain_agree_with_plain_ones(spark):
    rng = random.Random(9)
    chain = lambda: sorted({(100 * i + rng.choice([0, 0, 4, 30]), 100 * i + 50 + rng.choice([0, 0, 7, 25])) for i in rng.sample(range(5), rng.randint(1, 4))})
    refs, recs = {f"c{i}": (rng.choice("AB"), chain()) for i in range(25)}, {f"p{i}": (rng.choice("AB"), chain()) for i in range(60)}
    chains = spark.createDataFrame([(k, c, s) for k, (c, s) in refs.items()], f"cid string, chrom string, sj {PAIRS}")
    pnir = spark.createDataFrame([(k, c, s, 2 * len(s)) for k, (c, s) in recs.items()], f"pid string, chrom string, sj {PAIRS}, n_sites int")
    site = pnir.select("chrom", F.explode(g.junction_sites(F.col("sj"))).alias("pos"), "pid", "n_sites", F.lit("sj").alias("kind"))
    full, run = set(), set()
    for c, (x, ref) in refs.items():
        for p, (y, rec) in recs.items():
            if x != y:
                continue
            have, want = {v for j in rec for v in j}, {v for j in ref for v in j}
            if len(ref) == len(rec) and all(any(abs(h - q) <= 10 for h in have) for q in want):
                full.add((c, p))
            near = lambda a, b: abs(a[0] - b[0]) <= 10 and abs(a[1] - b[1]) <= 10
            first = next((i for i, t in enumerate(ref) if near(t, rec[0])), None)
            if first is not None and len(rec) <= len(ref) and first + len(rec) <= len(ref) and all(near(ref[first + i], r) for i, r in enumerate(rec)):
                run.add((c, p, first, len(rec)))
    assert set(rows(match.full_chain_matches(chains, pnir, site, 10))) == full and full
    assert set(rows(match.run_matches(chains, pnir, 10))) == run and run
    assert match.full_chain_matches(chains.limit(0), pnir, site, 10).count() == 0 and match.run_matches(chains, pnir.limit(0), 10).count() == 0


def test_first_junction_is_strict(spark):
    at = lambda d, flank=10: one(spark, splice.first_junction(arr([(d, 300)], PAIRS), F.lit(200), F.lit(300), flank))
    assert at(209) == 1 and at(210) is None and at(200, 0) is None


def test_mate_overlap(spark):
    supp = lambda s, e: F.array(F.struct(F.lit("1").alias("chrom"), F.lit(s).alias("s"), F.lit(e).alias("e")))
    assert [one(spark, fusion.any_near(supp(*x), F.lit("1"), F.lit(490), F.lit(510))) for x in ((480, 490), (480, 489), (510, 600), (511, 600))] == [True, False, True, False]


def test_discovery_needs_both_directions_unless_told(spark):
    gene = spark.createDataFrame([("a", "A", "protein_coding", "1", 0, 1000, [100, 200]), ("b", "B", "protein_coding", "2", 0, 1000, [500, 600]), ("x", "X", "lncRNA", "1", 0, 1000, [100])], "gene_id string, gene_name string, gene_type string, chrom string, start bigint, end bigint, sites array<bigint>")
    cand = lambda k, c, m, sc, s: (k, 0, c, m, sc, s, 2)
    schema = "cand string, sample_id int, main_chrom string, main array<bigint>, supp_chrom string, supp array<bigint>, n bigint"
    both = spark.createDataFrame([cand("1", "1", [100, 200], "2", [500, 600]), cand("2", "2", [500, 600], "1", [100, 200])], schema)
    pairs = fusion.gene_pairs(both, gene)
    assert [(r["gene_a"], r["gene_b"], r["total_evidence"], r["two_strand"]) for r in fusion.clusters(both, pairs).collect()] == [("A", "B", 4, True)]
    half = both.filter("cand = '1'")
    assert fusion.clusters(half, pairs.filter("cand = '1'")).count() == 0
    assert [r["two_strand"] for r in fusion.clusters(half, pairs.filter("cand = '1'"), require_both=False).collect()] == [False]
