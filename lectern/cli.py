"""The pipelines as commands, and a shell that answers questions.

    python -m lectern.cli pages FILES OUT             binary documents into cleaned texts (--extract module:function, plain text by default)
    python -m lectern.cli index TEXTS TABLE           texts into a vector table (--lexicon words to tag, --upsert)
    python -m lectern.cli ask TABLE                   answers questions one after another (--lexicon)
    python -m lectern.cli evaluate TABLE QA...        evaluates answers to question sets (--full)
    python -m lectern.cli make-qa TEXTS OUT           makes a question set from sections (--trial)

TEXTS is parquet of (document_id, text) or a folder of text files; a lexicon is a CSV file of word,entity_group. Models are named by
--embedder, --chat and --tokens as module:name, something that is called without arguments; without them the built-in ones that need no network
are used. Settings come from the environment or from --env FILE.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Settings, read_env_file
from lectern.operators import answer, evaluate, providers, qa, sections, vectortable
from lectern.session import local_session, ship
from lectern.sources import io
from lectern.streaming import ingest

LEAVE = {"salir", "exit", "q"}


def named(name: str | None, default: Callable) -> Callable:
    """What module:attribute names."""
    if not name:
        return default
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def tagger_of(lexicon: str | None) -> Callable[[], providers.Tagger] | None:
    """A tagger by a file of words; the file is read here once, and goes to the workers."""
    if not lexicon:
        return None
    import csv

    with open(lexicon, encoding="utf-8", newline="") as f:
        rows = [(r[0], r[1]) for r in csv.reader(f) if len(r) > 1]
    return lambda: providers.LexiconTagger(rows)


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    if any(n.endswith(".parquet") for n in (os.listdir(path) if os.path.isdir(path) else [path])):
        return spark.read.parquet(path).select("document_id", "text")
    return io.read_texts(spark, path)


def show(result) -> str:
    """A result row as text: the answer, its status, and the passages it rests on."""
    out = [result["answer"] or "", f"[{result['status']}]"]
    if result["status"] == "answered":
        out += [f"{h['document_id']} {h['chunk_id']} {h['score']:.3f}\n{(h['text'] or '').strip()}\n" for h in result["hits"]]
    elif result["status"] == "failed":
        out.append(result["error"])
    else:
        out.append(answer.REFUSED_NOTE)
    return "\n".join(out)


def ask(spark: SparkSession, table: str, settings: Settings, embed: Callable, chat: Callable, tagger: Callable | None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """Reads questions until one of LEAVE; blank lines are passed over. What a question mentions is tagged, so that hits are reranked by it."""
    rows = vectortable.load(spark, table, ("vector_pos", "document_id", "chunk_id", "text", "embedding"))
    while (line := read("> ").strip()).lower() not in LEAVE:
        if line:
            question = spark.createDataFrame([(1, line)], "query_id bigint, question string")
            found = answer.retrieve(question, rows, settings.top_k, settings.fetch_k, embed, tagger)
            write(show(answer.answer(found, chat, settings.answer_temperature, settings.answer_tokens).first()))


def questions_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(query_id, dataset, question, truth) of question sets, numbered over all of them; a file that is missing is an error."""
    sets = io.read_qa(spark, paths).filter("question is not null")
    return sets.select(F.xxhash64("dataset", "question", "answer").alias("query_id"), "dataset", "question", F.col("answer").alias("truth")).dropDuplicates(["query_id"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--env", help="file of NAME=VALUE lines")
    for name in ("embedder", "chat", "tokens"):
        top.add_argument(f"--{name}", help="module:name of the model")
    what = top.add_subparsers(dest="command", required=True)
    c = what.add_parser("pages")
    c.add_argument("files"), c.add_argument("out"), c.add_argument("--extract")
    c = what.add_parser("index")
    c.add_argument("texts"), c.add_argument("table"), c.add_argument("--lexicon"), c.add_argument("--upsert", action="store_true")
    c = what.add_parser("ask")
    c.add_argument("table"), c.add_argument("--lexicon")
    c = what.add_parser("evaluate")
    c.add_argument("table"), c.add_argument("qa", nargs="+"), c.add_argument("--lexicon"), c.add_argument("--full", action="store_true")
    c = what.add_parser("make-qa")
    c.add_argument("texts"), c.add_argument("out"), c.add_argument("--trial", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    settings = Settings.of({**os.environ, **(read_env_file(a.env) if a.env else {})})
    spark = spark or local_session()
    ship(spark)
    embed = named(a.embedder, providers.HashEmbedder)
    chat = named(a.chat, lambda: providers.Extractive(answer.ABSTENTION))
    if a.command == "pages":
        done = io.pages_to_documents(spark, a.files, named(a.extract, io.plain_pages), a.out)
        print(f"{done.count()} documents written to {a.out}")
    elif a.command == "index":
        version = ingest.index(texts_of(spark, a.texts), a.table, embed, tagger_of(a.lexicon), a.upsert, settings)
        state = vectortable.current(spark, a.table)[1]
        print(f"version {version} of {a.table}: {state['next']} positions given, dimension {state['dimension']}")
    elif a.command == "ask":
        ask(spark, a.table, settings, embed, chat, tagger_of(a.lexicon))
    elif a.command == "evaluate":
        questions = questions_of(spark, a.qa)
        found = answer.retrieve(questions, vectortable.load(spark, a.table), settings.top_k, settings.fetch_k, embed, tagger_of(a.lexicon)).join(questions.select("query_id", "dataset", "truth"), "query_id")
        print(evaluate.report(evaluate.summary(evaluate.evaluate(found, chat, full=a.full, tokens=named(a.tokens, providers.HashEmbedder)))))
    else:
        parts = sections.split_sections(texts_of(spark, a.texts), key="document_id")
        pairs = qa.build(parts, chat, qa.PAIRS_IN_TEST if a.trial else qa.PAIRS, settings.accept_from, key="document_id")
        io.write_json(pairs.select("question", "answer"), f"{a.out}/json")
        made = spark.read.schema("question string, answer string").json(f"{a.out}/json")
        io.write_qa_csv(made, f"{a.out}/csv")
        print(f"{made.count()} pairs written to {a.out}")


if __name__ == "__main__":
    main(sys.argv[1:])
