"""Evaluation of answers: judged scores, scores of token vectors, means by dataset and over all, in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import parsing
from lectern.functions import text as tx
from lectern.operators import answer as answering
from lectern.operators import providers
from lectern.schemas import METRICS
from lectern.session import cut


def summary(rows: DataFrame, dataset: str = "dataset", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(dataset, is_total, n, mean of each metric): a row for each dataset, and one over all questions (not a mean of means). Nulls and NaN don't count in a mean, but their rows do in n; no rows give the total row with n = 0."""
    return rows.groupingSets([[F.col(dataset)], []], F.col(dataset)).agg(F.grouping(dataset).cast("int").alias("is_total"), F.count("*").alias("n"), *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics])


def report(rows: DataFrame) -> str:
    """A summary as text, a block for each dataset and one for all questions, in three decimals."""
    out = []
    for r in rows.orderBy("is_total", "dataset").toLocalIterator():
        out.append(f"{'all questions' if r['is_total'] else r['dataset']} (n = {r['n']})")
        out += [f"  {m}: {'-' if r[m] is None else format(r[m], '.3f')}" for m in METRICS]
    return "\n".join(out)


def _judge(what: str, a: Column, b: Column, *more: Column) -> Column:
    parts = [F.lit(f'{what} Responde solo con un JSON: {{"score": número entre 0 y 1}} {{score}}\n<A>'), F.coalesce(a, F.lit("")), F.lit("</A>\n<B>"), F.coalesce(b, F.lit("")), F.lit("</B>\n")]
    return F.concat(*parts, *[x for m in more for x in (F.coalesce(m, F.lit("")), F.lit("\n"))])


def bert_score(candidate: Column, reference: Column, make: Callable[[], providers.TokenEmbedder] = providers.HashEmbedder, baseline: tuple[float, float, float] | None = None) -> Column:
    """A struct (precision, recall, f1) of token vectors: each token's greatest cosine with the other text's tokens, in the mean.

    baseline: what unrelated texts score, for precision, recall and F1; scores are rescaled so that it becomes 0 and 1 stays 1. A text without a token scores 0 (before rescaling).
    """

    @F.pandas_udf("precision double, recall double, f1 double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        model = make()
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(m) else m
        out = np.zeros((len(a), 3))
        for i, (x, y) in enumerate(zip(model.embed_tokens(a.fillna("").tolist()), model.embed_tokens(b.fillna("").tolist()))):
            if len(x) and len(y):
                s = unit(np.asarray(x, float)) @ unit(np.asarray(y, float)).T
                p, r = s.max(1).mean(), s.max(0).mean()
                out[i] = p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0
        if baseline is not None:
            low = np.array(baseline)
            out = (out - low) / (1 - low)
        return pd.DataFrame(out, columns=["precision", "recall", "f1"])

    return run(candidate, reference)


def evaluate(retrieved: DataFrame, make: Callable[[], providers.Chat], truth: str = "truth", full: bool = False, tokens: Callable[[], providers.TokenEmbedder] = providers.HashEmbedder, baseline: tuple[float, float, float] | None = None) -> DataFrame:
    """retrieved with answer, metrics, num_chunks and errors (ARRAY<STRING>).

    The answer comes from the context alone, without abstention or grounding check; with full from the whole way of an answer, with both.
    A judge that fails gives no score (null, which no mean counts) and its error; so does a failed answer.
    """
    hits = F.col("hits")
    context = F.array_join(F.transform(hits, lambda h: h["text"]), "\n\n")
    if full:
        said = answering.answer(retrieved, make).select("query_id", "answer", "error")
        rows = retrieved.drop("answer", "error").join(said, "query_id")
    else:
        prompt = F.concat(F.lit("Responde solo con el contexto.\n<Q>"), F.coalesce("question", F.lit("")), F.lit(f"</Q>\n{providers.CONTEXT_OPEN}\n"), context, F.lit(f"\n{providers.CONTEXT_CLOSE}"))
        rows = retrieved.withColumn("_c", providers.chat(prompt, make)).withColumn("answer", tx.strip(F.col("_c.reply"))).withColumn("error", F.col("_c.error")).drop("_c")
    # asked once, whatever reads the answer below
    rows = cut(rows)
    q, t, a = F.col("question"), F.col(truth), F.col("answer")
    shown = F.to_json(hits)
    asked = {
        "faithfulness": _judge("¿Es fiel la respuesta A a la verdad B?", a, t, q),
        "answer_relevance": _judge("¿Trata la respuesta B de la pregunta A?", q, a),
        "context_relevance": _judge("¿Trata el contexto B de la pregunta A?", q, context),
        "context_precision": _judge("¿Cuánto del contexto B sirve para la verdad A?", t, shown, q),
        "context_recall": _judge("¿Está la verdad A en el contexto B?", t, shown, q),
    }
    failed = F.col("error").isNotNull()
    for name, p in asked.items():
        rows = rows.withColumn(f"_{name}", providers.chat(F.when(~failed, p), make))
    rows = rows.withColumn("_s", bert_score(a, t, tokens, baseline))
    scores = [F.when(F.col(f"_{n}.reply").isNotNull(), parsing.judge_score(F.col(f"_{n}.reply"))).alias(n) for n in asked]
    bert = [F.when(~failed, F.col(f"_s.{n}")).alias(f"bert_{n}") for n in ("precision", "recall", "f1")]
    told = F.array_compact(F.array("error", *[F.col(f"_{n}.error") for n in asked])).alias("errors")
    return rows.select(*retrieved.drop("answer", "error").columns, "answer", *scores, *bert, F.size("hits").alias("num_chunks"), told)
