"""Reading and writing of documents, mentions, chunks and question sets, with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as tx


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, text) of binary documents; extract gives the texts of a document's pages, an empty one for a page without text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages = [x or "" for x in extract(content)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.string())], names=["path", "page_no", "text"])

    return files.mapInArrow(run, "path string, page_no int, text string")


def join_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): the pages of a document in order, each followed by a blank line."""
    page = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page.alias("t")))), lambda x: x["t"]), "").alias("text"))


def pages_to_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], to: str | None = None) -> DataFrame:
    """(document_id, text): the pages of binary documents extracted, put together and cleaned, and written as well if `to` is given. The file's name without extension is the document."""
    text = join_pages(read_pages(spark, path, extract))
    name = tx.stem(F.element_at(F.split("path", "/"), -1))
    return write_texts(text.select(name.alias("document_id"), tx.normalize(F.col("text")).alias("text")), to)


def plain_pages(content: bytes) -> list[str]:
    """Pages of a plain text, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of whole UTF-8 files; every kind of line end becomes a line feed, the name without extension the id."""
    raw = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value")
    return raw.select(tx.stem(F.col("file_name")).alias("document_id"), tx.universal_newlines(F.col("value")).alias("text"))


def parse_entities(raw: F.Column) -> F.Column:
    """Mentions from JSON that is an envelope with `entities` or a bare array; anything else gives null."""
    return F.coalesce(F.from_json(raw, schemas.ENVELOPE)["entities"], F.from_json(F.when(raw.rlike(r"^\s*\["), raw), schemas.ENTITIES))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value")
    return raw.select(tx.stem(F.col("file_name")).alias("document_id"), parse_entities(F.col("value")).alias("entities"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON array files; the file's name without extension is the document."""
    return spark.read.schema(schemas.CHUNK).json(path, multiLine=True).select(tx.stem(F.col("_metadata.file_name")).alias("document_id"), "*")


def read_qa(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(dataset, question, answer) of JSON array files; a missing file is an error."""
    return spark.read.schema(schemas.QA_PAIR).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("dataset"), "*")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; letters outside ASCII stay, empty maps and nulls in fields too."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_envelopes(entities: DataFrame, path: str) -> None:
    write_json(entities.select("input_file", "output_file", "entities"), path)


def write_qa_csv(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """question and answer, quoted and escaped, with a header; blanks at both ends stay."""
    pairs.select("question", "answer").write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_texts(documents: DataFrame, path: str | None) -> DataFrame:
    """Writes if there is a path, and gives the documents (then as written) back either way."""
    if not path:
        return documents
    documents.write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path)
