"""A table of vectors with positions: versions that are committed at once, its dimension and next position kept beside it.

    PATH/parts/ID          rows, written once and never changed
    PATH/versions/N.json   what version N consists of: parts, dimension, next position, number of the last batch of each stream

A version counts from the moment its small file is there, and the file of a number can be made only once: of two writers that
meet, one fails and changes nothing. A writer that dies leaves parts that no version names; vacuum() removes them. Readers
take the newest version. The dimension is told by the version, so that no append reads old vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.vectors import check_dimension, number_rows
from lectern.session import cut
from lectern.versions import Versions

_EMPTY = {"parts": [], "dimension": None, "next": 0, "batches": {}}


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number of the last version or -1, description of the newest whole one)."""
    number, state = Versions(spark, path).current()
    return number, state or dict(_EMPTY)


def exists(spark: SparkSession, path: str) -> bool:
    return current(spark, path)[0] >= 0


def load(spark: SparkSession, path: str, columns: Sequence[str] = ("vector_pos",), dimension: int | None = None) -> DataFrame:
    """The rows of the newest version. An error if there is no table or none with rows, if a column is missing, or if its dimension is another than asked for."""
    number, state = current(spark, path)
    if number < 0 or not state["parts"]:
        raise FileNotFoundError(f"no vector table with rows at {path}")
    if dimension is not None and dimension != state["dimension"]:
        raise ValueError(f"dimension {dimension}, the table has {state['dimension']}")
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/parts/{p}" for p in state["parts"]])
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"the table at {path} has no {', '.join(missing)}")
    return rows


def append(path: str, rows: DataFrame, vector: str = "embedding", upsert: bool = False, order: Sequence[str] = ("uid",), stream: str | None = None, batch: int | None = None) -> int:
    """Rows appended with positions that go on from the highest, in `order`, or the table made of them; gives the number of the version.

    All vectors must have one dimension, that of the table; nothing is written otherwise. upsert drops older rows of the same
    uid; positions are never given twice. No rows change nothing. stream and batch: a batch of a stream that is there already is not written again.
    """
    spark = rows.sparkSession
    number, state = current(spark, path)
    if stream is not None and state["batches"].get(stream, -1) >= batch:
        return number
    rows = cut(rows)
    n = rows.count()
    if not n:
        return number
    if rows.filter(F.col(vector).isNull()).limit(1).count():
        raise ValueError("a row has no vector")
    dimension = check_dimension(rows, vector, state["dimension"])
    placed = number_rows(rows, list(order), state["next"])
    kept = None
    if upsert and state["parts"]:
        kept = load(spark, path).join(rows.select("uid").distinct(), "uid", "left_anti")
    new = uuid.uuid4().hex
    (placed if kept is None else kept.unionByName(placed, allowMissingColumns=True)).write.parquet(f"{path}/parts/{new}")
    batches = state["batches"] | ({stream: batch} if stream is not None else {})
    parts = [new] if kept is not None else [*state["parts"], new]
    Versions(spark, path).commit(number + 1, {"parts": parts, "dimension": dimension, "next": state["next"] + n, "batches": batches})
    return number + 1


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the parts that the newest version doesn't name, and older versions; gives their names. Not to be run beside a writer or a reader of an older version."""
    return Versions(spark, path).clean("parts", set(current(spark, path)[1]["parts"]))
