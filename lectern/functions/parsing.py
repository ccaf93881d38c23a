"""Scores and pairs out of model replies.

NaN, Infinity and objects with a repeated key are no JSON here and score 0.0; text around or after an object matters as said at each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _score(json: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), "$.score", "double"), F.lit(0.0))


def judge_score(reply: Column) -> Column:
    """The score of the first, shortest {...} in a reply, held to [0, 1]; 0.0 where there is none."""
    found = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*?\}", 0), F.lit(""))
    # the default lies innermost, as least and greatest pass over nulls
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _score(found)))


def validation_score(reply: Column) -> Column:
    """The score of a reply that is one JSON object and nothing else, not held to a range; otherwise 0.0."""
    whole = F.coalesce(reply, F.lit("")).rlike(r"(?s)^\s*\{.*\}\s*\z")
    return F.when(whole, _score(reply)).otherwise(F.lit(0.0))


def qa_pairs(reply: Column) -> Column:
    """The pairs between the first [ and the last ]; empty where that is no JSON array. Items without question or answer are left out."""
    found = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string>>")
    return F.coalesce(F.filter(found, lambda x: x["question"].isNotNull() & x["answer"].isNotNull()), F.array().cast("array<struct<question:string,answer:string>>"))


def accepted(score: Column, least: float = 0.6) -> Column:
    return (score >= least) & ~F.isnan(score)
