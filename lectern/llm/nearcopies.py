"""Near-copies: rows of texts whose sets of word shingles are similar, without comparing all pairs.

similar_pairs() gives all pairs of rows; copy_groups() one row for each text with its group and number of links.
Candidates come from the Gray-ordered index (grayindex), or with exact=True from a join of prefixes that misses none; each is then
checked exactly on whole texts.
Nulls, empty texts and texts of fewer words than a shingle have no shingle: they are in no pair, and alone in
copy_groups. Equal texts are similar with 1. Repeated keys count as rows of their own only if their key differs.
Empty tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import grayindex, shingles
from lectern.llm.links import components
from lectern.session import cut, keep_matching, lookup, spread

#: Rows of a class that meet those of another in one task.
PART = 2000


def nodes_of(texts: DataFrame, key: str, text: str = "text", width: int = 3, with_text: bool = False) -> DataFrame:
    """(node, key[, text]) of every row with a shingle; rows with equal sets of shingles have equal nodes."""
    src = spread(texts.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")))
    kind = src.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS):
                part = batch.slice(at, shingles.SLICE_ROWS)
                row, node, _ = shingles.signatures(*shingles.shingle_sets(part.column(1).to_pylist(), width), 0)
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column(0).take(take), *([part.column(1).take(take)] if with_text else [])], names=["node", key, *(["text"] if with_text else [])])

    return src.mapInArrow(run, f"node bigint, `{key}` {kind}" + (", text string" if with_text else ""))


def _verify(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS // 2):
                part = batch.slice(at, shingles.SLICE_ROWS // 2)
                n = part.num_rows
                rows, h = shingles.shingle_sets(part.column(2).to_pylist() + part.column(3).to_pylist(), width)
                size = np.bincount(rows, minlength=2 * n)
                pair = np.where(rows < n, rows, rows - n).astype(np.uint64)
                both = np.sort((pair << np.uint64(56)) | h)
                twice = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(56)).astype(np.int64), minlength=n)[:n] if len(both) else np.zeros(n)
                union = size[:n] + size[n:] - twice
                # the comparison of whole numbers, so that ties at the threshold are exact
                keep = (union > 0) & (twice * 1_000_000 >= round(least * 1_000_000) * union)
                at_keep = pa.array(np.flatnonzero(keep))
                sim = twice[keep] / np.maximum(union[keep], 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at_keep), part.column(1).take(at_keep), pa.array(sim.astype(float))], names=["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, members: DataFrame, key: str, width: int, least: float) -> DataFrame:
    """(a, b, similarity) of the candidate node pairs whose texts reach `least`. members: (node, key, text), of which each node's first row is read."""
    texts = members.groupBy("node").agg(F.min_by("text", key).alias("text"))
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verify(width, least), "a bigint, b bigint, similarity double")


def class_links(texts: DataFrame, key: str, text: str = "text", width: int = 3, least: float = 0.7, exact: bool = False) -> DataFrame:
    """(a, b, similarity): links between classes of equal sets of shingles, each pair once.

    The index misses a pair of similarity s with (1 - s^ROWS)^KEYS. exact finds all: candidates then come from a join of prefixes, which costs more shuffle.
    """
    if exact:
        pairs = cut(grayindex.candidate_pairs(grayindex.prefix_keys(texts, text, width, least), 64))
    else:
        pairs = cut(grayindex.candidate_pairs(grayindex.index_keys(texts, text, width)))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return verified(pairs, keep_matching(nodes_of(texts, key, text, width, with_text=True), wanted, "node"), key, width, least)


def _in_parts(members: DataFrame, sizes: DataFrame, part: int) -> DataFrame:
    """members (node, key) with the part of their node that they fall in, and how many parts it has. sizes: (node, parts) of nodes with more than one."""
    parts = F.coalesce("parts", F.lit(1))
    return lookup(members, sizes, "node", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def similar_pairs(texts: DataFrame, key: str, text: str = "text", width: int = 3, least: float = 0.7, exact: bool = False, part: int = PART) -> DataFrame:
    """(key_a, key_b) with key_a < key_b: every pair of rows of similarity `least` or more, equal texts included.

    The rows of a class of more than `part` are parted, and the parts of classes meet in tasks of their own, each of at most part * part pairs.
    """
    links = cut(class_links(texts, key, text, width, least, exact)).select("a", "b")
    members = nodes_of(texts, key, text, width)
    repeated = members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(repeated)
    members = cut(keep_matching(members, wanted, "node").toDF("node", "key"))
    sizes = cut(members.groupBy("node").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).filter("parts > 1"))
    if sizes.isEmpty():
        one, two = members.toDF("a", "x"), members.toDF("b", "y")
        across = links.join(one, "a").join(two, "b").select("x", "y")
        within = members.toDF("node", "x").join(members.toDF("node", "y"), "node").filter("x < y").select("x", "y")
    else:
        placed = cut(_in_parts(members, sizes, part).select("node", "part", "parts", "key"))
        count = lambda x: F.sequence(F.lit(0), F.coalesce(x, F.lit(1)) - 1)
        cells = links
        for end, of in (("a", "pa"), ("b", "pb")):
            cells = lookup(cells, sizes.toDF(end, "parts"), end, "left").withColumn(of, F.explode(count(F.col("parts")))).drop("parts")
            cells = cut(cells)
        across = cells.join(placed.select(F.col("node").alias("a"), F.col("part").alias("pa"), F.col("key").alias("x")), ["a", "pa"]).join(placed.select(F.col("node").alias("b"), F.col("part").alias("pb"), F.col("key").alias("y")), ["b", "pb"]).select("x", "y")
        low = placed.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).select("node", "part", "other", F.col("key").alias("x"))
        high = placed.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("part")))).select("node", F.col("low").alias("part"), F.col("part").alias("other"), F.col("key").alias("y"))
        within = low.join(high, ["node", "part", "other"]).filter("part < other or x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).filter(f"`{key}_a` < `{key}_b`").distinct()


def copy_groups(texts: DataFrame, key: str, text: str = "text", width: int = 3, least: float = 0.7, exact: bool = False) -> DataFrame:
    """(key, group_id, n_links) for every row: its group's smallest key and the number of other classes its class is linked to."""
    links = cut(class_links(texts, key, text, width, least, exact).select("a", "b"))
    members = nodes_of(texts, key, text, width)
    first = members.groupBy("node").agg(F.min(key).alias("first"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    group = components(links).toDF("node", "component")
    by_node = cut(first.join(group, "node", "left").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least_key = cut(by_node.groupBy("component").agg(F.min("first").alias("group_id")))
    named = cut(lookup(by_node, least_key, "component").select("node", "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    # a class may hold most rows: its one row of names is broadcast or spread
    found = lookup(members, named, "node").select(F.col(key).alias("_k"), "group_id", "n_links")
    every = texts.select(F.col(key)).distinct()
    return every.join(found, every[key] == found["_k"], "left").select(F.col(key), F.coalesce("group_id", F.col(key)).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")).distinct()
