"""Queries over the test tables for every operator of this package, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import answers, encodings, incremental, mixing, nearcopies, scans, splitting, subjects, tokens
from lectern.session import scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(_t(spark, d, "documents"), only_found=True).select("doc_id").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(_t(spark, d, "documents"))


def p1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many of the clean texts that are spoiled are found and restored, by the way in which they were."""
    return encodings.repair_accuracy(_t(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(_t(spark, d, "chunks")).select("document_id", "chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(_t(spark, d, "chunks"))


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together from its pieces again, how many of them are too long, and how many don't share 200 code points with the one before."""
    p = splitting.oversized_pieces(_t(spark, d, "chunks")).withColumn("piece", F.col("piece").cast("int"))
    both = p.groupBy("document_id", "chunk_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text", "start", "end"))).alias("p"))
    new = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.lit(splitting.OVERLAP + 1), F.length(x["text"]))))
    apart = F.size(F.filter("p", lambda x, i: (i > 0) & (F.coalesce(F.get("p", i - 1)["end"] - x["start"], F.lit(-1)) != splitting.OVERLAP)))
    long = F.size(F.filter("p", lambda x: (F.length(x["text"]) > splitting.LIMIT) | (F.length(x["text"]) != x["end"] - x["start"])))
    return both.select("document_id", "chunk_id", F.md5(F.array_join(new, "")).alias("whole"), long.cast("bigint").alias("too_long"), apart.cast("bigint").alias("apart"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The oversized texts as files cut by byte ranges: code points that the pieces cover, pieces that are too long, places where two don't share 200."""
    at = scratch(spark, "files")
    _t(spark, d, "chunks").filter("length(text) > 850").select("text").write.text(at)
    p = splitting.file_pieces(spark, at, range_size=1 << 16)
    one = p.groupBy("file").agg(F.max("end").alias("n"), F.sum((F.col("end") - F.col("start")) - F.when(F.col("piece") > 0, splitting.OVERLAP).otherwise(0)).alias("covered"), F.sum((F.length("text") > splitting.LIMIT).cast("int")).alias("too_long"))
    return one.agg(F.sum("covered").alias("covered"), F.sum("n").alias("code_points"), F.sum("too_long").alias("too_long"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.similar_pairs(_t(spark, d, "metadata"), "vector_pos")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.copy_groups(_t(spark, d, "metadata"), "vector_pos")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.read_scans(_t(spark, d, "documents"), repair=False).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.read_scans(_t(spark, d, "documents"))


def p4_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many words of clean texts that are made noisy the repair gives back."""
    return scans.repair_accuracy(_t(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.not_accepted(_t(spark, d, "metadata"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defect_rows(_t(spark, d, "qa_pairs"))


def p6_defects(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs trigger each rule; a pair counts for every rule that it triggers."""
    found = answers.scored(_t(spark, d, "qa_pairs").dropDuplicates(["qa_id"]))
    return found.select(F.explode("defects").alias("defect")).groupBy("defect").agg(F.count("*").alias("pairs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(_t(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for, as digests."""
    return tokens.decoded(tokens.token_ids(_t(spark, d, "documents"))).select("doc_id", F.md5("text").alias("text"))


def p7_reuse(spark: SparkSession, d: str) -> DataFrame:
    return tokens.chunk_reuse(_t(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), total_tokens=mixing.WHOLE)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selected()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(_t(spark, d, "documents"), _t(spark, d, "subject_labels"), _t(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and subject."""
    by = _subjects(spark, d).join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return by.groupBy("source", "subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 3).alias("mean_share"))


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall on labels that the model hasn't seen."""
    return subjects.held_out_accuracy(_t(spark, d, "documents"), _t(spark, d, "subject_labels"), _t(spark, d, "subjects"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_repaired, p1_accuracy, p2_found, p2_pieces, p2_rejoined, p2_files, p3_found, p3_groups, p4_found, p4_repaired, p4_accuracy, p5_found, p6_found, p6_defects, p7_ids, p7_decoded, p7_reuse, p8_mix, p8_shares, p9_found, p9_composition, p9_accuracy)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT document_id, chunk_id FROM chunks WHERE length(text) > 850",
        "p2_rejoined": "SELECT document_id, chunk_id, md5(text) AS whole, 0::BIGINT AS too_long, 0::BIGINT AS apart FROM (SELECT DISTINCT document_id, chunk_id, text, coalesce(\"start\", 0) AS s FROM chunks WHERE length(text) > 850)",
        "p2_files": "SELECT sum(length(text) + 1)::BIGINT AS covered, sum(length(text) + 1)::BIGINT AS code_points, 0::BIGINT AS too_long FROM chunks WHERE length(text) > 850",
        "p3_found": f"WITH {_PAIRS} SELECT x AS vector_pos_a, y AS vector_pos_b FROM p",
        "p3_groups": f"""
            WITH RECURSIVE {_PAIRS},
            k AS (SELECT vector_pos, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY vector_pos),
            b AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
            l AS (SELECT i.k, count(DISTINCT j.k) AS n FROM b JOIN k i ON i.vector_pos = x JOIN k j ON j.vector_pos = y WHERE i.k <> j.k GROUP BY i.k),
            r AS (SELECT DISTINCT vector_pos AS x, vector_pos AS y FROM metadata UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
            g AS (SELECT x, min(y) AS group_id FROM r GROUP BY x)
            SELECT x AS vector_pos, group_id, coalesce(n, 0) AS n_links FROM g LEFT JOIN k ON k.vector_pos = x LEFT JOIN l ON l.k = k.k""",
        "p5_found": f"""
            WITH RECURSIVE {_PAIRS},
            o AS (SELECT vector_pos, row_number() OVER (ORDER BY coalesce(batch_id, -1), vector_pos) AS k FROM metadata WHERE vector_pos IN (SELECT x FROM p UNION SELECT y FROM p)),
            e AS (SELECT greatest(i.k, j.k) AS late, list(least(i.k, j.k)) AS early FROM p JOIN o i ON i.vector_pos = x JOIN o j ON j.vector_pos = y GROUP BY 1),
            r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
                SELECT r.k + 1, CASE WHEN list_has_any(coalesce(early, []), kept) THEN kept ELSE list_append(kept, r.k + 1) END FROM r LEFT JOIN e ON late = r.k + 1 WHERE r.k < (SELECT max(k) FROM o)),
            f AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1)
            SELECT vector_pos FROM o, f WHERE NOT list_contains(kept, k)""",
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
    }


#: Pairs of similar passages by brute force: s holds their shingles, p the pairs.
_PAIRS = """
            w AS (SELECT vector_pos, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM metadata WHERE text IS NOT NULL),
            s AS (SELECT DISTINCT vector_pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i) WHERE len(w) >= 3),
            n AS (SELECT vector_pos, count(*) AS n FROM s GROUP BY vector_pos),
            c AS (SELECT a.vector_pos AS x, b.vector_pos AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.vector_pos < b.vector_pos GROUP BY 1, 2),
            p AS (SELECT x, y FROM c JOIN n p ON p.vector_pos = x JOIN n q ON q.vector_pos = y WHERE c * 10 >= 7 * (p.n + q.n - c))"""
