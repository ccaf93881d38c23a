"""Entity mentions: taggers, mentions per chunk, signals of a question."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import spread

#: Code points of a bucket in the range join.
BUCKET = 800
#: Rows of a lexicon up to which it goes to the workers as a whole.
LEXICON_ROWS = 200_000
#: Which entity labels feed which signal, fixed values.
SIGNAL_LABELS = {"meds": ("CHEM",), "doses": ("Dose", "Strength"), "diso": ("DISO",), "forms": ("Form", "Route")}


def mentions(ner: DataFrame, key: str = "doc_id", entities: str = "entities") -> DataFrame:
    """(key, ord, entity_group, word, start): one row for each mention, in order; a null array has none. Rows repeated whole count once."""
    one = ner.select(key, F.col(entities).alias("_e")).distinct()
    return one.select(key, F.posexplode("_e").alias("ord", "_m")).select(key, "ord", "_m.entity_group", "_m.word", "_m.start")


def tag(documents: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", bound: int = LEXICON_ROWS) -> DataFrame:
    """A gazetteer tagger: (key, ord, entity_group, word, start) of the tokens between spaces and line feeds that the lexicon (word, entity_group) has.

    A lexicon of at most `bound` rows, counted first, goes to the workers, and one pass finds its words; nothing is shuffled. A larger one
    is joined: each text's distinct words meet it, and only those that it has are placed. Null texts have no mention.
    """
    lexicon = lexicon.select(F.col("word").cast("string").alias("word"), F.col("entity_group").cast("string").alias("entity_group")).filter("word is not null")
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).filter("_t is not null"))
    kind = src.schema["_k"].dataType.simpleString()
    rows = lexicon.limit(bound + 1).collect()
    if len(rows) <= bound:
        names: dict[str, list] = {}
        for r in rows:
            names.setdefault(r["word"], []).append(r["entity_group"])
        return src.mapInArrow(_tagging(key, lambda batch: (batch, names)), _tagged(key, kind))
    words = src.withColumn("_w", F.explode(F.array_distinct(F.split("_t", r"[ \n]", -1)))).select("_k", "_w")
    # equal texts of one key are told apart by nothing, and needn't be: a key's words are those of all its rows
    own = words.join(lexicon, words["_w"] == lexicon["word"]).groupBy("_k").agg(F.collect_list(F.struct("word", "entity_group")).alias("_l"))
    return src.join(own.withColumn("_l", F.array_distinct("_l")), "_k").select("_k", "_t", "_l").mapInArrow(_tagging(key, _own_words), _tagged(key, kind))


def _tagged(key: str, kind: str) -> str:
    return f"`{key}` {kind}, ord int, entity_group string, word string, start int"


def _own_words(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[dict]]:
    """The words of each row's own list."""
    every = []
    for words in batch.column(2).to_pylist():
        own: dict[str, list] = {}
        for x in words:
            own.setdefault(x["word"], []).append(x["entity_group"])
        every.append(own)
    return batch, every


def _tagging(key: str, lexicon: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, names = lexicon(batch)
            row, number, group, word, start = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = names[i] if isinstance(names, list) else names
                tokens = t.replace("\n", " ").split(" ")
                if own.keys().isdisjoint(tokens):
                    continue
                at = 0
                for n, w in enumerate(tokens):
                    if w in own:
                        for g in own[w]:
                            row.append(i), number.append(n), group.append(g), word.append(w), start.append(at)
                    at += len(w) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(group, pa.string()), pa.array(word, pa.string()), pa.array(start, pa.int32())], names=[key, "ord", "entity_group", "word", "start"])

    return run


def run_tagger(documents: DataFrame, make: Callable[[], Callable[[str], list[dict]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entities, error): the mentions that a model finds in each text. make() gives, in a worker, a function from a text to mentions.

    A text on which it fails, and a null text, has no mentions; what failed is told in error and doesn't end the run.
    """
    src = documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            found, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    got, error = [{k: m.get(k) for k in ("entity_group", "word", "start")} for m in (find(t) if t else [])], None
                except Exception as e:  # noqa: BLE001 - whatever a model raises
                    got, error = [], f"{type(e).__name__}: {e}"
                found.append(got), errors.append(error)
            kind = pa.list_(pa.struct([("entity_group", pa.string()), ("word", pa.string()), ("start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(errors, pa.string())], names=[key, "entities", "error"])

    return src.mapInArrow(run, f"`{key}` {src.schema['_k'].dataType.simpleString()}, entities array<struct<entity_group:string,word:string,start:int>>, error string")


def assign(chunks: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions whose start lies in [start, end] of a chunk, both ends included: (key, pos, entity_group, words), words in the order of the mentions.

    The range join is an equality on document and bucket: a chunk is met in each bucket that it touches, a mention in its own, so no large document comes into one task.
    """
    c = chunks.select(key, "pos", F.col("start").alias("_from"), F.col("end").alias("_to")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / BUCKET), F.floor(F.col("_to") / BUCKET))))
    m = found.withColumn("_b", F.floor(F.col("start") / BUCKET))
    met = c.join(m, [key, "_b"]).filter("start between _from and _to")
    return met.groupBy(key, "pos", "entity_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("words"))


def with_entities(chunks: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with an entities map; one without a mention has an empty map."""
    maps = assign(chunks, found.filter("entity_group is not null"), key).groupBy(key, "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_group", "words")))).alias("entities"))
    return chunks.drop("entities").join(maps, [key, "pos"], "left").withColumn("entities", F.coalesce("entities", no_entities()))


def no_entities() -> Column:
    """An empty map of mentions."""
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))


def signals(entities: Column) -> Column:
    """A struct of word lists by signal, in lower case; a missing word counts as empty, repeats and order stay, other labels drop out."""
    e = F.coalesce(entities, F.array().cast("array<struct<entity_group:string,word:string,start:int>>"))
    of = lambda labels: F.transform(F.filter(e, lambda x: x["entity_group"].isin(*labels)), lambda x: F.lower(F.coalesce(x["word"], F.lit(""))))
    return F.struct(*[of(labels).alias(name) for name, labels in SIGNAL_LABELS.items()])
