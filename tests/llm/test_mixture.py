"""The flow against enumeration, and what the mixture must keep."""

from itertools import product

import pytest

from cohortloom.llm import mixture


def test_quotas_spread_what_is_left():
    q = mixture.quotas(1000, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2000, "b": 2000, "c": 40})
    assert q == {"a": 600, "b": 360, "c": 40}
    assert mixture.quotas(100, {"a": 1.0}, {"a": 30}) == {"a": 30}
    assert mixture.quotas(0, {"a": 1.0}, {"a": 30}) == {"a": 0}
    assert mixture.quotas(10, {}, {}) == {}


def test_route_is_cheapest():
    patterns = [("a", ("a",), 4, {"a": 4}), ("a,b", ("a", "b"), 2, {"a": 2, "b": 2}), ("b", ("b",), 1, {"b": 1})]
    quota, repeat = {"a": 5, "b": 4}, {"a": 2, "b": 3}
    got = mixture.route(patterns, quota, repeat)

    def cost(x):
        total = 0
        for key, _, tokens, _ in patterns:
            use = sum(v for (k, _), v in x.items() if k == key)
            r = 1
            while use > 0:
                total += r * min(use, tokens)
                use -= tokens
                r += 1
        return total

    arcs = [(k, s, by[s] * repeat[s]) for k, ss, _, by in patterns for s in ss]
    best = min(
        cost({(k, s): v for (k, s, _), v in zip(arcs, pick)})
        for pick in product(*(range(c + 1) for _, _, c in arcs))
        if all(sum(v for (_, s, _), v in zip(arcs, pick) if s == x) == quota[x] for x in quota)
    )
    assert cost(got) == best and all(sum(v for (_, s), v in got.items() if s == x) == quota[x] for x in quota)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text of document {i} " + "word " * (i % 7), "A " if i % 3 else "b") for i in range(300)]
    rows += [(1000 + i, f"text of document {i} " + "word " * (i % 7), "b") for i in range(0, 60, 2)]
    rows += [(5, rows[5][1], "A "), (2000, None, "a"), (2001, "", "a"), (2002, "x", None), (2003, "x", "other")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix(spark, docs):
    target = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 3), ("none", 0.1, 5), ("null", None, 1)], "source string, target_share double, max_repeat int")
    got = mixture.mix(docs, target).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert max(r["copies"] for r in got if r["source"] == "b") <= 3 and max(r["copies"] for r in got if r["source"] == "a") <= 2
    used = {s: sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == s) for s in "ab"}
    sized = mixture._sized(docs, mixture._targets(target), f"{mixture.bpe.TOKENIZERS}/{mixture.bpe.VOCABULARY}").collect()
    total, longest = sum(r["n_tokens"] for r in sized), max(r["n_tokens"] for r in sized)
    most_b = 3 * sum(r["n_tokens"] for r in sized if r["source"] == "b")
    want_b = min(most_b, total * 2 / 3)
    assert abs(used["b"] - want_b) <= 3 * longest and abs(used["a"] - (total - want_b)) <= 3 * longest
    report = {r["source"]: r for r in mixture.mix_report(docs, target).collect()}
    assert report["none"]["actual_tokens"] == 0 and {s: report[s]["actual_tokens"] for s in "ab"} == used
    assert sorted(map(tuple, mixture.mix(docs, target).collect())) == sorted(map(tuple, got))


def test_empty(spark, docs):
    target = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    assert mixture.mix(docs.limit(0), target).collect() == []
    assert mixture.mix(docs, target.limit(0)).collect() == []
    assert mixture.mix_report(docs.limit(0), target).collect()[0]["actual_share"] == 0.0


def test_texts_shared_by_two_sources_are_used_alike(spark):
    rows = [(i + 1000 * k, f"text number {i} of the two", s) for k, s in enumerate("ab") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = spark.createDataFrame([("a", 0.25, 3), ("b", 0.25, 3), ("c", 0.5, 1)], "source string, target_share double, max_repeat int")
    used = {}
    for r in mixture.mix(df, target).collect():
        used[r["doc_id"] % 1000] = used.get(r["doc_id"] % 1000, 0) + r["copies"]
    assert set(used.values()) == {2} and len(used) == 400
    report = {r["source"]: r["actual_share"] for r in mixture.mix_report(df, target).collect()}
    assert abs(sum(report.values()) - 1) < 1e-5 and report["c"] == 0 and abs(report["a"] - 0.5) < 0.01


def test_copies_of_a_hot_text_share_its_uses(spark):
    rows = [(i, "the same text again", "a") for i in range(500)] + [(1000 + i, f"another text {i}", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source string, target_share double, max_repeat int")
    got = [r["copies"] for r in mixture.mix(df, target).collect() if r["source"] == "a"]
    assert max(got) <= 3 and max(got) - min(got) <= 1 and len(got) == 500


def test_shares_are_of_what_is_used(spark):
    df = spark.createDataFrame([(i, f"text {i}", "a" if i < 10 else "b") for i in range(40)], "doc_id bigint, text string, source string")
    target = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 0)], "source string, target_share double, max_repeat int")
    got = {r["source"]: r["actual_share"] for r in mixture.mix_report(df, target).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_flow_of_many_patterns_ends_soon():
    import random
    import time

    rng, names = random.Random(5), [f"s{i}" for i in range(200)]
    patterns = []
    for i in range(4000):
        ss = tuple(sorted(rng.sample(names, rng.randint(1, 3))))
        n = rng.randint(1, 10**6)
        patterns.append((str(i), ss, n, {s: n * rng.randint(1, 2) for s in ss}))
    most = {s: sum(b.get(s, 0) for _, _, _, b in patterns) * 4 for s in names}
    share = {s: rng.random() for s in names}
    scale, total = sum(share.values()), sum(sum(b.values()) for _, _, _, b in patterns)
    quota = mixture.quotas(total, {s: v / scale for s, v in share.items()}, most)
    began = time.time()
    got = mixture.route(patterns, quota, dict.fromkeys(names, 4))
    assert time.time() - began < 60
    filled = dict.fromkeys(names, 0)
    for (_, s), f in got.items():
        filled[s] += f
    assert filled == quota
