"""Mixing sources to target weights: a min-cost flow over membership patterns.

Documents are grouped by text. A text's membership pattern is the set of targeted sources in which it
occurs, with its number of copies in each. Only the patterns' token sums reach the driver: at most
MAX_PATTERNS rows, a bound that is checked. On them a flow network is solved: the root feeds the
patterns, where the r-th use of a pattern's texts costs r (convex, so texts are repeated only where
nothing else is left); a pattern feeds the sources in which it occurs, each copy at most max_repeat
times; a source takes its quota. Quotas that max_repeat leaves open are given to the sources that can
still take more, in proportion to their shares.

Texts are then selected per pattern, for all its sources at once: they lie in the order of a seeded
hash on a circle as long as their tokens, and the sources take stretches of it one after the other, as
long as their flows. So the uses of two texts of a pattern differ by one at most over all sources
together, as the flow has it. Places on the circle are prefix sums over hash ranges, so that no group
meets in one task. A source's uses of a text are dealt to its copies in turn; copies are numbered over
hash ranges as well, so a text that a third of all documents repeat is spread.

Defined cases. Sources compare without surrounding blanks, in lower case. Documents without a
source or of a source without a target are left out. Null and empty texts have no tokens and are
left out. A doc_id delivered twice counts once (the smallest source, text hash and size). A source
without documents gets nothing. Targets that are null or not above 0 are ignored; max_repeat below 1
or null counts as 0. The mixture's size is met to within one text per pattern and source.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import bpe

#: Most rows (sources of patterns) that the driver takes; more raise an error. See README for the time this takes.
MAX_PATTERNS = 50_000
#: Ranges of the seeded hash over which tokens are summed before a cut is searched.
RANGES = 4096


def plain_name(c):
    return F.lower(F.regexp_replace(c, r"\A\s+|\s+\z", ""))


class Network:
    """Min-cost flow by the primal-dual method; integer capacities and costs >= 0.

    Each phase finds distances by reduced cost and then sends all that the shortest paths can carry
    (blocking flows over levels), so the number of phases is that of different path costs. An arc may
    be convex: its n-th `step` units cost n each; it holds the part that can be used next.
    """

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.convex: dict[int, tuple[int, int, int]] = {}

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        """An arc; returns its number, that of its reverse being one more."""
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def add_convex(self, a: int, b: int, step: int, times: int) -> None:
        """The n-th step units cost n each, up to `times` steps; later steps are added when they come into reach."""
        if times > 0 and step > 0:
            self.convex[self.add(a, b, step, 1)] = (a, step, times)

    def flow(self, arc: int) -> int:
        return self.cap[arc + 1]

    def run(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        to, cap, cost, out = self.to, self.cap, self.cost, self.out
        while True:
            dist: list[int | None] = [None] * n
            dist[s], heap, done = 0, [(0, s)], [False] * n
            while heap:
                d, u = heapq.heappop(heap)
                if done[u]:
                    continue
                done[u] = True
                for k in out[u]:
                    if cap[k] > 0:
                        v = to[k]
                        nd = d + cost[k] + potential[u] - potential[v]
                        if dist[v] is None or nd < dist[v]:
                            dist[v] = nd
                            heapq.heappush(heap, (nd, v))
            if dist[t] is None:
                return total
            far = dist[t]
            for v in range(n):
                potential[v] += far if dist[v] is None else min(dist[v], far)
            total += self._saturate(s, t, potential)
            for k, (a, step, times) in list(self.convex.items()):
                if cap[k] == 0:
                    del self.convex[k]
                    if cost[k] < times:
                        self.convex[self.add(a, to[k], step, cost[k] + 1)] = (a, step, times)

    def _saturate(self, s: int, t: int, potential: list[int]) -> int:
        """Largest flow over arcs of reduced cost 0."""
        to, cap, cost, out, total = self.to, self.cap, self.cost, self.out, 0
        while True:
            level = [-1] * len(out)
            level[s], queue = 0, [s]
            for u in queue:
                for k in out[u]:
                    v = to[k]
                    if cap[k] > 0 and level[v] < 0 and cost[k] + potential[u] - potential[v] == 0:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[t] < 0:
                return total
            at = [0] * len(out)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    push = min(cap[k] for k in path)
                    total += push
                    for k in path:
                        cap[k] -= push
                        cap[k ^ 1] += push
                    cut = next(i for i, k in enumerate(path) if cap[k] == 0)
                    u = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs = out[u]
                while at[u] < len(arcs):
                    k = arcs[at[u]]
                    v = to[k]
                    if cap[k] > 0 and level[v] == level[u] + 1 and cost[k] + potential[u] - potential[v] == 0:
                        break
                    at[u] += 1
                if at[u] < len(arcs):
                    path.append(k)
                    u = v
                elif not path:
                    break
                else:
                    k = path.pop()
                    u = to[k ^ 1]
                    at[u] += 1


def quotas(total: int, share: dict[str, float], most: dict[str, int]) -> dict[str, int]:
    """Tokens of each source: its share of the total, or all that max_repeat allows; what is left open goes to the others by share."""
    got = {s: 0 for s in share}
    free, left = set(share), total
    while free and left > 0:
        weight = sum(share[s] for s in free)
        full = {s for s in free if most.get(s, 0) <= left * share[s] / weight}
        if not full:
            for s in sorted(free):
                got[s] = int(left * share[s] / weight)
            return got
        for s in full:
            got[s] = most.get(s, 0)
            left -= got[s]
        free -= full
    return got


def route(patterns: list[tuple[str, tuple[str, ...], int, dict[str, int]]], quota: dict[str, int], repeat: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens that each source takes from each pattern.

    patterns: key, sources, tokens of the distinct texts, tokens of the documents by source.
    """
    names = sorted(quota)
    net = Network(2 + len(patterns) + len(names))
    root, sink = 0, 1
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    arcs = {}
    for i, (key, sources, tokens, by) in enumerate(patterns):
        node = 2 + i
        net.add_convex(root, node, tokens, sum(-(-by[s] * repeat[s] // max(tokens, 1)) for s in sources if s in at))
        for s in sources:
            if s in at and by[s] * repeat[s] > 0:
                arcs[key, s] = net.add(node, at[s], by[s] * repeat[s], 0)
    for s in names:
        net.add(at[s], sink, quota[s], 0)
    net.run(root, sink)
    return {k: f for k, a in arcs.items() if (f := net.flow(a)) > 0}


def _sized(documents: DataFrame, targets: DataFrame, path: str | None) -> DataFrame:
    """doc_id, source, text_key, n_tokens of the documents of targeted sources, each doc_id once, written once."""
    names = [r["source"] for r in targets.collect()]
    docs = documents.withColumn("source", plain_name(F.col("source"))).filter(F.col("source").isin(names) & (F.length("text") > 0))
    docs = docs.select("doc_id", "source", F.md5("text").alias("text_key"), "text")
    df = bpe.count_tokens(docs, ["doc_id", "source", "text_key"], path)
    one = df.groupBy("doc_id").agg(F.min(F.struct("source", "text_key", "n_tokens")).alias("d"))
    return durable(one.select("doc_id", "d.*"))


def _targets(mix_target: DataFrame) -> DataFrame:
    t = mix_target.select(plain_name(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"))
    t = t.filter((F.col("source") != "") & (F.col("target_share") > 0))
    return t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))


@dataclass
class Plan:
    """A mixture before it is selected: documents, texts with their pattern, flows, and what each source should get."""

    docs: DataFrame
    texts: DataFrame
    flows: dict[tuple[str, str], int]
    goal: dict[str, tuple[float, int]]


def plan(documents: DataFrame, mix_target: DataFrame, path: str | None = None) -> Plan:
    """Tokenizes the documents once and routes tokens of patterns to sources."""
    targets = _targets(mix_target)
    goal = {r["source"]: (r["target_share"], r["max_repeat"]) for r in targets.collect()}
    scale = sum(share for share, _ in goal.values()) or 1.0
    docs = _sized(documents, targets, path)
    # two steps: a text that many documents repeat is reduced to one row a source before its sources meet
    copies = docs.groupBy("text_key", "source").agg(F.count("*").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.min("doc_id").alias("doc_id"))
    texts = copies.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("source", "copies", "doc_id"))).alias("members"), F.max("n_tokens").alias("n_tokens"))
    pattern = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["source"], m["copies"])), ",")
    texts = durable(texts.withColumn("pattern", pattern))
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.first(F.transform("members", lambda m: F.struct(m["source"], m["copies"]))).alias("members"))
    rows = sums.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS or sum(len(r["members"]) for r in rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources of membership patterns")
    patterns = [(r["pattern"], tuple(m["source"] for m in r["members"]), r["tokens"], {m["source"]: m["copies"] * r["tokens"] for m in r["members"]}) for r in sorted(rows, key=lambda r: r["pattern"])]
    by_source = {s: sum(b.get(s, 0) for _, _, _, b in patterns) for s in goal}
    quota = quotas(sum(by_source.values()), {s: share / scale for s, (share, _) in goal.items()}, {s: n * goal[s][1] for s, n in by_source.items()})
    flows = route(patterns, quota, {s: n for s, (_, n) in goal.items()})
    return Plan(docs, texts, flows, {s: (goal[s][0], quota[s]) for s in goal})


def text_uses(p: Plan, seed: int) -> DataFrame:
    """text_key, source, copies, doc_id (the smallest), n_tokens and uses (above 0) of each text by each source."""
    spark = p.docs.sparkSession
    begin: dict[str, int] = {}
    stretches = []
    for (pattern, source), f in sorted(p.flows.items()):
        stretches.append((pattern, source, begin.get(pattern, 0), f))
        begin[pattern] = begin.get(pattern, 0) + f
    plan_rows = spark.createDataFrame(stretches, "pattern string, source string, begin bigint, flow bigint")
    h = F.xxhash64("text_key", F.lit(seed))
    df = p.texts.withColumn("order_key", h).withColumn("part", F.pmod(F.shiftright(h, 20), F.lit(RANGES)).cast("int"))
    sums = df.groupBy("pattern", "part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES rows a pattern
    carry = sums.withColumn("carry", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("around", F.sum("n").over(Window.partitionBy("pattern"))).drop("n")
    within = Window.partitionBy("pattern", "part").orderBy("order_key", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(carry, ["pattern", "part"]).withColumn("twice_middle", (F.col("carry") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))) * 2 + F.col("n_tokens"))
    df = df.select("text_key", "pattern", "n_tokens", "around", "twice_middle", F.explode("members").alias("m"))
    df = df.select("text_key", "pattern", "n_tokens", "around", "twice_middle", "m.*").join(F.broadcast(plan_rows), ["pattern", "source"])
    # how often the middle of the text comes by before a place x on the circle, in whole numbers
    passed = lambda x: F.expr(f"(2 * ({x}) - twice_middle + 2 * around - 1) div (2 * around)")
    uses = passed("begin + flow") - passed("begin")
    return df.select("text_key", "source", "copies", "doc_id", "n_tokens", uses.cast("bigint").alias("uses")).filter("uses > 0")


def selected(p: Plan, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, copies: how many times the mixture uses each document."""
    uses = durable(text_uses(p, seed))
    single = uses.filter("copies = 1").select("doc_id", "source", "n_tokens", F.col("uses").alias("copies"))
    many = uses.filter("copies > 1").select("text_key", "source", "n_tokens", "uses", F.col("copies").alias("of"))
    docs = p.docs.select("doc_id", "source", "text_key", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)).cast("int").alias("part"))
    counts = docs.groupBy("text_key", "source", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("text_key", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES rows a text: a repeated text is spread over as many keys
    plans = counts.join(many, ["text_key", "source"]).withColumn("carry", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("text_key", "source", "part").orderBy("doc_id")
    numbered = docs.join(plans, ["text_key", "source", "part"]).withColumn("no", F.col("carry") + F.row_number().over(within) - 1)
    dealt = F.floor(F.col("uses") / F.col("of")) + (F.col("no") < F.col("uses") % F.col("of")).cast("bigint")
    shared = numbered.select("doc_id", "source", "n_tokens", dealt.alias("copies")).filter("copies > 0")
    return single.unionByName(shared)


def report(p: Plan, mixture: DataFrame) -> DataFrame:
    """source, target_share, quota_tokens, actual_tokens, actual_share, n_documents, max_copies of each targeted source; shares are of the mixture's own size."""
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("max_copies"))
    goals = mixture.sparkSession.createDataFrame([(s, float(a), int(q)) for s, (a, q) in sorted(p.goal.items())], "source string, target_share double, quota_tokens bigint")
    df = goals.join(used, "source", "left").fillna(0, ["actual_tokens", "n_documents", "max_copies"])
    # one row a source
    size = F.sum("actual_tokens").over(Window.partitionBy())
    return df.withColumn("actual_share", F.when(size > 0, F.round(F.col("actual_tokens") / size, 6)).otherwise(0.0))


def mix(documents: DataFrame, mix_target: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """The mixture: doc_id, source, n_tokens, copies (how many times the document is used)."""
    return selected(plan(documents, mix_target, path), seed)


def mix_report(documents: DataFrame, mix_target: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """The report on a mixture; use plan, selected and report to get both from one tokenization."""
    p = plan(documents, mix_target, path)
    return report(p, selected(p, seed))
