"""Union-find over links held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, lookup


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component of the links (a, b). Nodes without a link are not listed.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each one shuffle per step and written to
    the shared folder; they end when a round changes nothing, after about log n rounds; an error is raised if they don't within most_rounds. No component is held in
    one task: a node of many links is joined with its one least neighbour, which is broadcast or spread.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = lookup(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        kept = lookup(large, cut(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(kept.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
