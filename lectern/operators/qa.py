"""Question and answer sets made from sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import parsing
from lectern.operators import providers
from lectern.session import cut

#: Pairs asked for, in a trial too, and the most tokens of the two replies.
PAIRS, PAIRS_IN_TEST = 10, 3
PAIR_TOKENS, CHECK_TOKENS = 2000, 200


def scored_pairs(sections: DataFrame, make: Callable[[], providers.Chat], n: int = PAIRS, key: str = "doc_id", with_source: bool = False) -> DataFrame:
    """(key, title, question, answer, score, error): the pairs that a model makes of each section, with the score that its check gives.

    The check sees question and answer only; with_source shows it the section too. Replies that are no JSON give no pair. A section on which
    the model fails has one row without a pair, with the error; a check that fails scores 0.0 and says why.
    """
    ask = F.concat(F.lit(f'Haz exactamente {n} pares de pregunta y respuesta solo con este texto. Devuelve un JSON [{{"question": "...", "answer": "..."}}].\nSECCIÓN: '), F.col("title"), F.lit("\nTEXTO:\n"), F.col("body"))
    # made once, as both branches and the check read the replies
    made = cut(sections.select(key, "title", "body", providers.chat(ask, make, most_tokens=PAIR_TOKENS).alias("_c")))
    pairs = made.withColumn("_p", F.explode(parsing.qa_pairs(F.col("_c.reply")))).select(key, "title", "body", "_p.question", "_p.answer")
    source = [F.lit("\n<C>"), F.coalesce("body", F.lit("")), F.lit("</C>")] if with_source else []
    check = F.concat(F.lit('¿Es fiel la respuesta? Devuelve solo {"faithful": true o false, "score": número} {score}\n<A>'), F.col("answer"), F.lit("</A>\n<B>"), F.col("question"), F.lit("</B>"), *source)
    scored = pairs.withColumn("_v", providers.chat(check, make, most_tokens=CHECK_TOKENS)).select(key, "title", "question", "answer", parsing.validation_score(F.col("_v.reply")).alias("score"), F.col("_v.error").alias("error"))
    none = F.lit(None).cast("string")
    failed = made.filter("_c.error is not null").select(key, "title", none.alias("question"), none.alias("answer"), F.lit(None).cast("double").alias("score"), F.col("_c.error").alias("error"))
    return scored.unionByName(failed)


def build(sections: DataFrame, make: Callable[[], providers.Chat], n: int = PAIRS, least: float = 0.6, key: str = "doc_id", with_source: bool = False) -> DataFrame:
    """(key, title, question, answer, score) of the pairs that a model makes of each section and then finds faithful."""
    return scored_pairs(sections, make, n, key, with_source).filter("question is not null").filter(parsing.accepted(F.col("score"), least)).drop("error")
