"""Vectors: unit length, exact search by blocks, and positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, spread

#: Vectors in a block of the table and of the queries.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Digits that similarities are rounded to before they are ranked, so that ties fall alike everywhere.
DIGITS = 6
#: Bytes of query blocks that are broadcast at once.
QUERY_BYTES = 64 << 20


def l2_normalize(v: Column) -> Column:
    """Unit length, in double; a zero vector stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def check_dimension(vectors: DataFrame, vector: str, dimension: int | None = None) -> int:
    """The one dimension of all vectors; an error if there are several, or if it is another than the table's."""
    r = vectors.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if r["low"] != r["high"] or dimension is not None and r["low"] not in (None, dimension):
        raise ValueError(f"dimensions {r['low']} to {r['high']}, the table has {dimension}")
    return r["low"]


def _pack(vectors: DataFrame, key: str, vector: str, size: int, normalized: bool) -> DataFrame:
    """(dim, ids ARRAY<BIGINT>, data BINARY): blocks of vectors of one task each, of unit length; a zero vector stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                starts = np.concatenate(([0], np.cumsum(sizes)))[rows]
                m = flat[starts[:, None] + np.arange(d)]
                if not normalized:
                    m = m / np.where((norm := np.sqrt(np.einsum("ij,ij->i", m, m))) > 0, norm, 1.0)[:, None]
                for at in range(0, len(rows), size):
                    part = slice(at, at + size)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[rows[part]].tolist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(m[part], np.float64).tobytes()], pa.binary())], names=["dim", "ids", "data"])

    src = spread(vectors.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull()))
    return src.mapInArrow(run, "dim int, ids array<bigint>, data binary")


def _meet(t: DataFrame, q: DataFrame) -> DataFrame:
    """Every block of the table with every block of the queries of its dimension, once.

    The blocks of queries are written and counted. Up to QUERY_BYTES they are broadcast, and the table isn't moved. Beyond,
    blocks meet on a grid: a query block goes to one row and all columns, a table block to one column and all rows, so
    each cell is a task of its own and holds no more than its share of either.
    """
    q = cut(q)
    size = q.agg(F.coalesce(F.sum(F.length("qdata")), F.lit(0)).alias("n")).first()["n"]
    if size <= QUERY_BYTES:
        return t.join(F.broadcast(q), "dim").select("qids", "qdata", "ids", "data")
    rows = -(-size // QUERY_BYTES)
    columns = max(1, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = q.withColumn("_row", F.pmod(F.xxhash64("qids"), F.lit(rows))).withColumn("_column", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))))
    t = t.withColumn("_column", F.pmod(F.xxhash64("ids"), F.lit(columns))).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
    return t.join(q, ["_row", "_column", "dim"]).select("qids", "qdata", "ids", "data")


def top_k(queries: DataFrame, table: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "vector_pos", vector: str = "embedding", normalized: bool = False) -> DataFrame:
    """(query_key, key, score, vec_rank): the k nearest by cosine for each query, ties by key; fewer where the table has fewer.

    Blocks of queries meet blocks of the table, each pair is one matrix product that keeps k for each query, and only those are shuffled.
    """
    q = _pack(queries, query_key, vector, QUERY_BLOCK, normalized).toDF("dim", "qids", "qdata")
    t = _pack(table, key, vector, BLOCK, normalized)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qs, ids = np.array(r["qids"], np.int64), np.array(r["ids"], np.int64)
                order = np.argsort(ids, kind="stable")
                s = np.round(np.frombuffer(r["qdata"]).reshape(len(qs), -1) @ np.frombuffer(r["data"]).reshape(len(ids), -1)[order].T, DIGITS) + 0.0
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)), pa.array(ids[order][best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["q", "v", "score"])

    pairs = _meet(t, q).mapInArrow(run, "q bigint, v bigint, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    return pairs.withColumn("vec_rank", F.row_number().over(w)).filter(F.col("vec_rank") <= k).select(F.col("q").alias(query_key), F.col("v").alias(key), "score", "vec_rank")


def number_rows(new: DataFrame, order: list[str], first: int = 0, key: str = "vector_pos") -> DataFrame:
    """new with the numbers first, first + 1, ... in `key`, in the given order; rows that tie in all of `order` follow each other in any order.

    Rows are spread by ranges of the order and written once with their range and their place in it. Both the counts of the
    ranges and the numbers come from what was written, so they can't disagree; no task sorts all rows.
    """
    if key in new.columns:
        new = new.drop(key)
    parts = cut(new.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    # one row for each partition
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(F.broadcast(counts.select("_part", (F.lit(first) + before - F.col("_first")).alias("_shift"))), "_part")
    return placed.withColumn(key, (F.col("_place") + F.col("_shift")).cast("bigint")).drop("_part", "_place", "_shift")


def next_positions(old: DataFrame, new: DataFrame, order: list[str], key: str = "vector_pos") -> DataFrame:
    """new with positions that follow the highest of old, in the given order; from 0 where old is empty."""
    highest = old.agg(F.max(key)).first()[0]
    return number_rows(new, order, 0 if highest is None else int(highest) + 1, key)


def latest_positions(table: DataFrame, uid: str = "uid", key: str = "vector_pos") -> DataFrame:
    """(uid, position): the mapping of each uid to its last position."""
    return table.groupBy(uid).agg(F.max(key).alias("position"))
