"""Mixing sources to target shares of tokens, with capped repetition.

Documents are aggregated by membership pattern (the set of sources that may give them); a minimum-cost flow routes the
tokens of the patterns to the sources' quotas, where each further copy of a document costs more than the one before. The
flow has one node for each pattern and source, whatever the number of documents, and is solved on the driver. Documents
are then selected in a seeded order: all of a pattern for each whole copy, and for the rest those up to a cut in that order,
found from a histogram of the order, so no source is sorted or gathered in one task.

The total defaults to the largest at which every source that has tokens reaches its share, so the scarcest source decides
the size of the mix. With a total given, quotas beyond the caps stay unfilled and the report shows it; the total WHOLE
stands for all tokens of documents that may be taken, so that scarce sources stop at their caps and none shrinks the rest.
Documents without a source, or with one that has no target, stay out. Null and empty texts have no tokens and are not
taken. Repeated document ids count once. Without documents or targets the mix is empty, and the report lists the targets with nothing.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY_DIR, token_counts
from lectern.session import cut

SEED = 20
#: The total that stands for all tokens of the corpus with a source that has a share and copies.
WHOLE = "whole"
#: Parts of the seeded order in the histogram, and membership patterns that the driver routes at most.
PARTS, MOST_PATTERNS = 4096, 20_000


def min_cost_flow(supply: dict, arcs: list[tuple], quota: dict) -> dict:
    """{(pattern, source): tokens}: a flow of most tokens at least cost. supply: tokens of a pattern; arcs: (pattern, source, copies).

    The k-th copy of a pattern's tokens to a source costs 2k - 1, so the cost is convex and copies spread evenly. Successive
    shortest paths with potentials.
    """
    graph, to, cap, cost = defaultdict(list), [], [], []

    def arc(u, v, c, w):
        graph[u].append(len(to)), to.append(v), cap.append(c), cost.append(w)
        graph[v].append(len(to)), to.append(u), cap.append(0), cost.append(-w)

    named = {}
    for p, s, copies in arcs:
        for k in range(1, copies + 1):
            named[len(to)] = (p, s)
            arc(("p", p), ("s", s), supply[p], 2 * k - 1)
    for p in supply:
        arc("from", ("p", p), supply[p] * max([c for q, _, c in arcs if q == p], default=0) * len(quota), 0)
    for s, q in quota.items():
        arc(("s", s), "to", q, 0)
    potential = defaultdict(int)
    while True:
        dist, via, heap, n = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                v = to[e]
                if cap[e] and d + cost[e] + potential[u] - potential[v] < dist.get(v, 1 << 60):
                    dist[v], via[v], n = d + cost[e] + potential[u] - potential[v], e, n + 1
                    heapq.heappush(heap, (dist[v], n, v))
        if "to" not in dist:
            break
        for v, d in dist.items():
            potential[v] += d
        path, v = [], "to"
        while v != "from":
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    out = defaultdict(int)
    for e, (p, s) in named.items():
        out[p, s] += cap[e ^ 1]
    return dict(out)


def sized(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR, seed: int = SEED) -> DataFrame:
    """(key, pattern ARRAY, n_tokens, place): one row for each document with sources; place in [0, 1) is its seeded order."""
    many = documents.schema[source].dataType.typeName() == "array"
    pattern = F.array_sort(F.array_distinct(F.array_compact(F.col(source)))) if many else F.array_compact(F.array(F.col(source)))
    docs = documents.select(F.col(key), pattern.alias("pattern"), F.col(text)).filter(F.size("pattern") > 0)
    counted = token_counts(docs, [key, "pattern"], text, tokenizer, directory).filter("n_tokens > 0")
    return counted.dropDuplicates([key]).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40)))


class Mix:
    """A plan for one set of documents and targets: selected() and shares()."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, key: str = "doc_id", **how):
        self.key, self.docs = key, cut(sized(documents, key, **how))
        self.targets = {r["source"]: (float(r["target_share"]), max(0, int(r["max_repeats"] or 0))) for r in targets.filter("source is not null and target_share is not null").distinct().collect()}
        groups = self.docs.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
        if len(groups) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
        arcs = [(tuple(g["pattern"]), s, self.targets[s][1]) for g in groups for s in g["pattern"] if s in self.targets and self.targets[s][1]]
        self.supply = {p: n for g in groups if (p := tuple(g["pattern"])) in {a[0] for a in arcs} for n in [int(g["n"])]}
        reach = {s: sum(self.supply[p] * c for p, t, c in arcs if t == s) for s in self.targets}
        if total_tokens == WHOLE:
            total_tokens = sum(n for p, n in self.supply.items() if any(s in self.targets and min(self.targets[s]) > 0 for s in p))
        self.total = total_tokens if total_tokens is not None else self._largest(arcs, reach)
        self.flow = min_cost_flow(self.supply, arcs, {s: round(self.total * share) for s, (share, _) in self.targets.items() if reach[s]})

    def _largest(self, arcs: list, reach: dict) -> int:
        """The largest total whose quotas the flow fills; sources with nothing to give are left out of account."""
        able = {s: self.targets[s][0] for s in reach if reach[s] and self.targets[s][0] > 0}
        if not able:
            return 0
        high = int(min(reach[s] / share for s, share in able.items()))
        if all(len(p) == 1 for p in self.supply):
            return high
        low = 0
        while high - low > max(1, high // 10_000):
            mid = (low + high + 1) // 2
            quota = {s: round(mid * share) for s, share in able.items()}
            if sum(min_cost_flow(self.supply, arcs, quota).values()) == sum(quota.values()):
                low = mid
            else:
                high = mid
        return low

    def selected(self) -> DataFrame:
        """(key, source, n_tokens, copies) of the documents in the mix."""
        spark = self.docs.sparkSession
        rest = [(list(p), s, f // self.supply[p], f % self.supply[p]) for (p, s), f in self.flow.items() if f]
        plan = spark.createDataFrame(rest, "pattern array<string>, source string, whole bigint, rest bigint")
        # at most one row for each pattern and source: bounded by MOST_PATTERNS and the targets
        part = F.least(F.floor(F.col("place") * PARTS), F.lit(PARTS - 1))
        docs = self.docs.withColumn("part", part)
        heights = docs.groupBy("pattern", "part").agg(F.sum("n_tokens").alias("n"))
        below = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        heights = heights.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
        open_part = heights.join(F.broadcast(plan), "pattern").filter("before < rest and rest <= before + n").select("pattern", "source", F.col("part").alias("open"), "before")
        plan = plan.join(open_part, ["pattern", "source"], "left")
        chosen = docs.join(F.broadcast(plan), "pattern").withColumn("at", F.expr("case when rest = 0 or part > open then 0 when part < open then 1 else null end"))
        inside = Window.partitionBy("pattern", "source").orderBy("place", self.key).rowsBetween(Window.unboundedPreceding, -1)
        edge = chosen.filter("at is null").withColumn("run", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        # the document across the edge is taken if that comes nearer to the quota than leaving it
        edge = edge.withColumn("at", F.expr("cast(run + n_tokens / 2 <= rest as int)")).drop("run")
        both = chosen.filter("at is not null").unionByName(edge)
        return both.select(self.key, "source", "n_tokens", (F.col("whole") + F.col("at")).cast("int").alias("copies")).filter("copies > 0")

    def shares(self, selected: DataFrame | None = None) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, most_copies), one row for each target."""
        spark = self.docs.sparkSession
        got = (self.selected() if selected is None else selected).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
        every = got.agg(F.sum("tokens").alias("all"))
        targets = spark.createDataFrame([(s, t[0]) for s, t in self.targets.items()], "source string, target_share double")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        # `every` is one row
        return targets.join(got, "source", "left").join(F.broadcast(every)).select("source", "target_share", (zero("tokens") / F.greatest(zero("all"), F.lit(1))).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_copies").alias("most_copies"))
