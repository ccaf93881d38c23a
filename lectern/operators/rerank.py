"""Rerank of hits by what the question mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a mention found in a passage, fixed values.
WEIGHTS = {"meds": 2, "diso": 1, "forms": 1}


def rerank_score(signals: Column, text: Column) -> Column:
    """Weighted mentions that the passage holds, as parts of its lower-cased text; repeats count again, an empty word is in every passage. Null where there is no signal but doses."""
    low = F.lower(F.coalesce(text, F.lit("")))
    size = lambda n: F.coalesce(F.size(signals[n]), F.lit(0))
    total = sum((w * F.size(F.filter(signals[n], lambda x: F.contains(low, x))) for n, w in WEIGHTS.items()), F.lit(0))
    return F.when(sum((size(n) for n in WEIGHTS), F.lit(0)) > 0, total.cast("int"))


def rerank(hits: DataFrame, k: int = 5, query_key: str = "query_id", score: str = "score", rerank_column: str = "rerank_score", rank: str = "vec_rank") -> DataFrame:
    """hits with final_rank: by rerank score, then similarity, then the rank before; at most k for each question. Nothing is filtered out by its score."""
    w = Window.partitionBy(query_key).orderBy(F.coalesce(rerank_column, F.lit(0)).desc(), F.desc(score), rank)
    return hits.withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= k)
