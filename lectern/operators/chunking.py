"""Overlapping chunks whose ends are moved on to the next blank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import spread

#: Size, overlap and reach of a chunk in code points.
SIZE, OVERLAP, REACH = 800, 200, 50
SLICE_ROWS = 2000


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """[start, end) of each chunk. An end stops at a space or line feed within reach; the next start lies `overlap` before the end.

    As the walk goes on until a start is past the text, a text longer than the overlap ends with a chunk of its last `overlap` code points.
    """
    n, start = len(text), 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            stop = min(n, end + reach)
            marks = [x for x in (text.find(" ", end, stop), text.find("\n", end, stop)) if x >= 0]
            end = min(marks, default=stop)
        yield start, end
        start = end - overlap if end - overlap > start else start + size


def chunk(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, reach: int = REACH, drop_tail: bool = False) -> DataFrame:
    """(key, pos, chunk_id, text, start, end), one row for each chunk; null and empty texts have none.

    Each text is a row of its own, so the work spreads without a shuffle. drop_tail leaves out the last chunk where it lies within the one before.
    """
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).filter("_t is not null and _t <> ''"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows, pos, texts, starts, ends = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    before = 0
                    for k, (s, e) in enumerate(spans(t, size, overlap, reach)):
                        if drop_tail and k and e <= before:
                            continue
                        rows.append(i), pos.append(k), texts.append(t[s:e]), starts.append(s), ends.append(e)
                        before = e
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array([f"chunk_{k}" for k in pos], pa.string()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "pos", "chunk_id", "text", "start", "end"])

    return src.mapInArrow(run, f"`{key}` {src.schema['_k'].dataType.simpleString()}, pos int, chunk_id string, text string, start int, end int")
