"""Sections of a leaflet, by listed headings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import spread

#: Beginnings of folded lines that open a section, fixed values.
HEADINGS = ("conservacion", "advertencias", "composicion")
_FOLD = str.maketrans("áéíóúñ", "aeioun")
SLICE_ROWS = 1000


def sections_of(text: str, headings: tuple[str, ...] = HEADINGS) -> list[tuple[str, str]]:
    """(title, body) of a text's sections, in the order of the first occurrence of each title; of several with one title the last counts."""
    found: dict[str, str] = {}
    title, body = None, []

    def close() -> None:
        if title is not None and body:
            found[title] = "\n".join(body)

    for line in text.split("\n"):
        clean = line.strip().lower().translate(_FOLD)
        if clean.startswith(headings):
            close()
            title, body = clean.split()[0], []
        else:
            body.append(line)
    close()
    return list(found.items())


def split_sections(documents: DataFrame, headings: tuple[str, ...] = HEADINGS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, title, body): what stands under each title, in the order of its first occurrence. One pass over the texts, without a shuffle.

    The title is the heading line's first word, folded. Text before the first heading is dropped; a section without a line is none; of several with one title the last counts.
    Null texts have none; repeated rows give repeated sections.
    """
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).filter("_t is not null"))
    heads = tuple(headings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                row, number, titles, bodies = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for n, (title, body) in enumerate(sections_of(t, heads), 1):
                        row.append(i), number.append(n), titles.append(title), bodies.append(body)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(titles, pa.string()), pa.array(bodies, pa.string())], names=[key, "ord", "title", "body"])

    return src.mapInArrow(run, f"`{key}` {src.schema['_k'].dataType.simpleString()}, ord int, title string, body string")
