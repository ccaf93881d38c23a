"""Documents into a vector table: cleaned, chunked, tagged, clipped, embedded, numbered; at once or as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import Settings
from lectern.functions import text as tx
from lectern.operators import entities, providers, vectors, vectortable
from lectern.operators.chunking import chunk

#: Positions rise by document and, in it, by place.
ORDER = ("document_id", "start", "chunk_id")


def index_chunks(chunks: DataFrame, embed: Callable = providers.HashEmbedder, clip: Callable[[Column], Column] | None = None) -> DataFrame:
    """(document_id, chunk_id, uid, entities, start, end, text, embedding) of chunks (document_id, chunk_id, text, start, end, entities): texts clipped, embedded, vectors of unit length.

    The clipped text is what is kept; the offsets stay. Nothing is shuffled.
    """
    text = tx.clip_words(F.col("text"), Settings.clip_tokens) if clip is None else clip(F.col("text"))
    c = chunks.withColumn("text", text).withColumn("uid", tx.uid(F.col("document_id"), F.col("chunk_id"))).withColumn("_raw", providers.embedding(F.col("text"), embed))
    return c.select("document_id", "chunk_id", "uid", "entities", "start", "end", "text", vectors.l2_normalize(F.col("_raw")).cast("array<float>").alias("embedding"))


def index_rows(documents: DataFrame, embed: Callable = providers.HashEmbedder, tagger: Callable[[], providers.Tagger] | None = None, settings: Settings = Settings(), clip: Callable[[Column], Column] | None = None) -> DataFrame:
    """index_chunks() of documents (document_id, text), whose chunks carry what the tagger finds in the cleaned text."""
    clean = documents.select("document_id", tx.normalize(F.col("text")).alias("text"))
    c = chunk(clean, key="document_id", size=settings.chunk_size, overlap=settings.chunk_overlap, reach=settings.chunk_reach)
    if tagger is None:
        c = c.withColumn("entities", entities.no_entities())
    else:
        c = entities.with_entities(c, entities.mentions(entities.run_tagger(clean, tagger, "document_id"), "document_id"), "document_id")
    return index_chunks(c.drop("pos"), embed, clip)


def index(documents: DataFrame, table: str, embed: Callable = providers.HashEmbedder, tagger: Callable[[], providers.Tagger] | None = None, upsert: bool = False, settings: Settings = Settings()) -> int:
    """Documents appended to the vector table at a path, which is made if there is none; gives the number of its version. No documents change nothing."""
    return vectortable.append(table, index_rows(documents, embed, tagger, settings), upsert=upsert, order=ORDER)


def ingest(spark: SparkSession, source: DataFrame, table: str, checkpoint: str, embed: Callable = providers.HashEmbedder, tagger: Callable[[], providers.Tagger] | None = None, name: str | None = None) -> StreamingQuery:
    """Appends each micro-batch once, with positions: the table keeps the number of the last batch of each stream, so one that comes again after a failure adds nothing.

    name: what the table knows the stream by; the checkpoint's path by default.
    """

    def write(batch: DataFrame, number: int) -> None:
        vectortable.append(table, index_rows(batch, embed, tagger), order=ORDER, stream=name or checkpoint, batch=number)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
