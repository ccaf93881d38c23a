"""Queries of the core over the test tables, with the SQL that says the same.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.functions import parsing
from lectern.functions import text as tx
from lectern.operators import answer, chunking, entities, evaluate, providers, qa, rerank, sections, vectors, vectortable
from lectern.session import scratch, spread
from lectern.sources import io

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- text

_NOISY = r"""'  ' || text || chr(8203) || 'ﬁn' || chr(10) || chr(10) || chr(10) || chr(10) || 'a   b' || chr(1) || chr(160)"""


@query(rf"""
    WITH t AS (SELECT doc_id, {_NOISY} AS x FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(x,
        '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
        '\n{{3,}}', E'\n\n', 'g'), ' {{2,}}', ' ', 'g'), '^[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ''), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '') AS text
    FROM t""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """All cleaning steps but composition, on texts with noise added. The appended ligature keeps the repair of Latin-1 from applying to any."""
    noisy = F.concat(F.lit("  "), "text", F.lit("​ﬁn\n\n\n\na   b\x01\xa0"))
    return _t(spark, d, "documents").select("doc_id", tx.normalize(noisy, compose=False).alias("text"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771))) AS text FROM documents")
def nfc_normalize(spark: SparkSession, d: str) -> DataFrame:
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    return _t(spark, d, "documents").select("doc_id", tx.nfc(apart).alias("text"))


_LATIN = "coalesce(CASE WHEN regexp_full_match({0}, '(?s)[\\x{{00}}-\\x{{FF}}]*') THEN TRY(decode(unhex(array_to_string(list_transform(string_split({0}, ''), lambda c: printf('%02X', unicode(c))), '')))) END, {0})"
_AS_LATIN = "array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: chr(('0x' || h)::INT)), '')"


@query(f"SELECT doc_id, {_LATIN.format('text')} AS text, {_LATIN.format('read_wrong')} AS undone FROM (SELECT doc_id, text, {_AS_LATIN} AS read_wrong FROM documents WHERE text <> '')")
def undo_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """The repair on the texts as they are, and on each of them read as Latin-1, where it gives the text back."""
    t = _t(spark, d, "documents").filter("text <> ''")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.select("doc_id", tx.undo_mojibake(F.col("text")).alias("text"), tx.undo_mojibake(wrong).alias("undone"))


@query("SELECT eval_id, qa_id, printf('%.3f', faithfulness) AS three, printf('%.2f', faithfulness / 8) AS two FROM (SELECT DISTINCT eval_id, qa_id, faithfulness FROM eval_metrics) WHERE faithfulness IS NOT NULL AND NOT isnan(faithfulness)")
def display_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores as they are shown: rounded on their exact binary value."""
    e = _t(spark, d, "eval_metrics").select("eval_id", "qa_id", "faithfulness").distinct().filter("faithfulness is not null and not isnan(faithfulness)")
    return e.select("eval_id", "qa_id", F.replace(tx.fixed(F.col("faithfulness"), 3), F.lit(","), F.lit("")).alias("three"), F.replace(tx.fixed(F.col("faithfulness") / 8, 2), F.lit(","), F.lit("")).alias("two"))


_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PAGE_SQL = "'<html><style>p {a: b}</style><!-- x -->' || chr(10) || '<p class=\"a\">' || text || '</p>&amp;lt;&nbsp;<script>if (a<b) 1</script ></html>'"
for _pattern in (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", r"(?s)<[^>]*>"):
    _PAGE_SQL = f"regexp_replace({_PAGE_SQL}, '{_pattern}', ' ', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _PAGE_SQL = f"replace({_PAGE_SQL}, '{_name}', '{_sign}')"


@query(f"SELECT doc_id, trim(regexp_replace({_PAGE_SQL}, '{_BLANKS}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def html_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of pages; each text is set into a page first."""
    page = F.concat(F.lit('<html><style>p {a: b}</style><!-- x -->\n<p class="a">'), "text", F.lit("</p>&amp;lt;&nbsp;<script>if (a<b) 1</script ></html>"))
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", tx.html_text(page).alias("text"))


_TOKENS = r"""list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce(answer, '')), '.,;:()[]"''¿?¡!' || chr(10) || chr(9), '                '), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))"""


@query(f"SELECT qa_id, list_aggregate(list_sort({_TOKENS}), 'string_agg', ' ') AS tokens, len({_TOKENS}) AS n FROM (SELECT DISTINCT * FROM qa_pairs)")
def token_set(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "qa_pairs").distinct()
    return q.select("qa_id", F.nullif(F.array_join(F.array_sort(tx.token_set(F.col("answer"))), " "), F.lit("")).alias("tokens"), F.size(tx.token_set(F.col("answer"))).cast("bigint").alias("n"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS text FROM documents WHERE text IS NOT NULL")
def clip_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", tx.clip_words(F.col("text"), 50).alias("text"))


@query("SELECT document_id || '_' || chunk_id AS uid, regexp_replace(document_id || '.txt', '\\.[^.]*$', '') AS stem, count(*) AS n FROM chunks GROUP BY 1, 2")
def uid_build(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "chunks")
    return c.groupBy(tx.uid(F.col("document_id"), F.col("chunk_id")).alias("uid"), tx.stem(F.concat("document_id", F.lit(".txt"))).alias("stem")).agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, string_agg(line || chr(10) || chr(10), '' ORDER BY pos) AS text FROM l GROUP BY doc_id""")
def join_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages put together; here the lines of a document stand for its pages."""
    pages = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"))
    return io.join_pages(pages, "doc_id")


# --- chunks and entities

_CHUNKS = """
    WITH RECURSIVE s AS (
        SELECT doc_id, text, 0 AS pos, 0 AS b, length(text) AS n FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, text, pos + 1, CASE WHEN e - 200 > b THEN e - 200 ELSE b + 800 END, n FROM (
            SELECT *, CASE WHEN b + 800 >= n THEN n ELSE b + 800 + length(regexp_extract(substring(text, b + 801, 50), '^[^ \\n]*')) END AS e FROM s)
        WHERE (CASE WHEN e - 200 > b THEN e - 200 ELSE b + 800 END) < n),
    c AS (SELECT doc_id, pos, b, CASE WHEN b + 800 >= n THEN n ELSE b + 800 + length(regexp_extract(substring(text, b + 801, 50), '^[^ \\n]*')) END AS e, text FROM s)
"""


@query(_CHUNKS + "SELECT doc_id, pos, 'chunk_' || pos AS chunk_id, substring(text, b + 1, e - b) AS text, b AS \"start\", e AS \"end\" FROM c")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_t(spark, d, "documents"))


@query(_CHUNKS + "SELECT doc_id, count(*) AS chunks, sum(e - b)::BIGINT AS chars, max(e - b) AS longest FROM c GROUP BY doc_id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("text")
    return chunking.chunk(_t(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(size).alias("chars"), F.max(size).alias("longest"))


_MENTIONS = """m AS (SELECT doc_id, i - 1 AS ord, e[i].entity_group AS entity_group, e[i].word AS word, e[i]."start" AS "start"
    FROM (SELECT DISTINCT doc_id, entities AS e FROM ner_entities WHERE entities IS NOT NULL), unnest(range(1, len(e) + 1)) AS r(i))"""


@query(f"WITH {_MENTIONS} SELECT * FROM m")
def ner_mentions(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentions(_t(spark, d, "ner_entities"))


@query(f"""{_CHUNKS}, {_MENTIONS}
    SELECT c.doc_id, c.pos, m.entity_group, string_agg(m.word, '|' ORDER BY m.ord, m.word) AS words, count(*) AS n FROM c JOIN m ON c.doc_id = m.doc_id AND m."start" BETWEEN c.b AND c.e
    GROUP BY ALL""")
def assign_entities(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk(_t(spark, d, "documents"))
    got = entities.assign(c, entities.mentions(_t(spark, d, "ner_entities")))
    words = F.filter("words", lambda x: x.isNotNull())
    return got.select("doc_id", "pos", "entity_group", F.when(F.size(words) > 0, F.array_join(words, "|")).alias("words"), F.size("words").cast("bigint").alias("n"))


@query(f"""{_CHUNKS}, {_MENTIONS}, g AS (SELECT c.doc_id, c.pos, count(DISTINCT m.entity_group) AS kinds FROM c LEFT JOIN m ON c.doc_id = m.doc_id AND m."start" BETWEEN c.b AND c.e GROUP BY ALL)
    SELECT kinds, count(*) AS chunks FROM g GROUP BY kinds""")
def chunk_entity_maps(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk(_t(spark, d, "documents")).select("doc_id", "pos", "start", "end")
    got = entities.with_entities(c, entities.mentions(_t(spark, d, "ner_entities")))
    return got.groupBy(F.size("entities").cast("bigint").alias("kinds")).agg(F.count("*").alias("chunks"))


def _signal(labels: str) -> str:
    return f"array_to_string(list_transform(list_filter(coalesce(entities, []), lambda e: e.entity_group IN ({labels})), lambda e: lower(coalesce(e.word, ''))), '|')"


@query(f"""SELECT doc_id, {_signal("'CHEM'")} AS meds, {_signal("'Dose', 'Strength'")} AS doses, {_signal("'DISO'")} AS diso, {_signal("'Form', 'Route'")} AS forms FROM ner_entities""")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "ner_entities").select("doc_id", entities.signals(F.col("entities")).alias("s"))
    return s.select("doc_id", *[F.array_join(f"s.{n}", "|").alias(n) for n in entities.SIGNAL_LABELS])


_LEXICON = (("Según", "REF"), ("mg", "UNIT"), ("with", "REF"), ("dosis", "TERM"))


@query(f"""
    WITH w AS (SELECT doc_id, t[i] AS word, i - 1 AS ord, CAST(coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x) + 1)), 0) AS INT) AS "start"
        FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]') AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS r(i))
    SELECT doc_id, ord, entity_group, word, "start" FROM w JOIN (VALUES {', '.join(map(str, _LEXICON))}) AS l(word, entity_group) USING (word)""")
def tag_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.tag(_t(spark, d, "documents"), spark.createDataFrame(_LEXICON, "word string, entity_group string"))


_HEADS = ("composi", "conserva", "adverten", "resum", "warnings", "storage")


_SECTIONS_SQL = f"""WITH l AS (SELECT doc_id, i AS pos, t[i] AS line, translate(lower(trim(t[i], ' ' || chr(9) || chr(160))), 'áéíóúñ', 'aeioun') AS clean FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS r(i)),
    h AS (SELECT *, regexp_matches(clean, '^({'|'.join(_HEADS)})') AS head FROM l),
    r AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h),
    s AS (SELECT doc_id, run, max(CASE WHEN head THEN regexp_extract(clean, '^\\S+') END) AS title, string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos) AS body, count(*) FILTER (NOT head) AS n FROM r WHERE run > 0 GROUP BY doc_id, run HAVING count(*) FILTER (NOT head) > 0),
    k AS (SELECT *, min(run) OVER (PARTITION BY doc_id, title) AS first, max(run) OVER (PARTITION BY doc_id, title) AS last FROM s),
    o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS ord, title, body FROM k WHERE run = last)"""


@query(_SECTIONS_SQL + " SELECT doc_id, ord, title, md5(body) AS body FROM o")
def split_sections(spark: SparkSession, d: str) -> DataFrame:
    s = sections.split_sections(_t(spark, d, "documents"), headings=_HEADS)
    return s.withColumn("body", F.md5("body"))


# --- files


@query(f"WITH {_MENTIONS} SELECT * FROM m UNION ALL SELECT * FROM m")
def parse_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions out of tagger files, which are envelopes or bare arrays; each row of the table is written as both."""
    n = _t(spark, d, "ner_entities").select("doc_id", "entities").filter("entities is not null").distinct()
    envelope = F.to_json(F.struct(F.lit("in").alias("input_file"), F.lit("out").alias("output_file"), "entities"), {"ignoreNullFields": "false"})
    at = scratch(spark, "tagged")
    n.select("doc_id", F.explode(F.array(envelope, F.to_json("entities", {"ignoreNullFields": "false"}))).alias("raw")).write.parquet(at)
    back = spark.read.parquet(at).select("doc_id", io.parse_entities(F.col("raw")).alias("entities"))
    return back.select("doc_id", F.posexplode("entities").alias("ord", "m")).select("doc_id", "ord", "m.entity_group", "m.word", "m.start")


@query("SELECT md5(question) AS question, md5(answer) AS answer, count(*) AS n FROM qa_pairs WHERE question <> '' AND answer <> '' AND NOT contains(question || answer, chr(13)) GROUP BY 1, 2")
def qa_csv(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as CSV and read back, whatever quotes and line ends they hold."""
    at = scratch(spark, "csv")
    io.write_qa_csv(_t(spark, d, "qa_pairs").filter("question <> '' and answer <> '' and not contains(question || answer, '\r')"), at)
    back = spark.read.csv(at, schema="question string, answer string", header=True, escape='"', multiLine=True)
    return back.groupBy(F.md5("question").alias("question"), F.md5("answer").alias("answer")).agg(F.count("*").alias("n"))


@query("SELECT document_id, chunk_id, md5(text) AS text, coalesce(\"start\", -1) AS \"start\", coalesce(\"end\", -1) AS \"end\", coalesce(cardinality(entities)::BIGINT, -1) AS kinds FROM chunks")
def chunks_json(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read back with their fixed schema; nulls and empty maps stay apart."""
    at = scratch(spark, "json")
    io.write_json(_t(spark, d, "chunks").select("document_id", "chunk_id", "text", "start", "end", "entities"), at)
    back = spark.read.schema(T.StructType([T.StructField("document_id", T.StringType()), *schemas.CHUNK.fields])).json(at)
    number = lambda c: F.coalesce(c, F.lit(-1))
    return back.select("document_id", "chunk_id", F.md5("text").alias("text"), number(F.col("start")).alias("start"), number(F.col("end")).alias("end"), number(F.when(F.col("entities").isNotNull(), F.size("entities"))).cast("bigint").alias("kinds"))


# --- vectors

_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))"
_TOP = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS vector_pos, q.label AS q_label, v.label AS v_label, round({_COS}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_pos) AS vec_rank FROM s QUALIFY vec_rank <= 5)"""


def _top(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return vectors.top_k(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "vector_pos"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(vectors.inner_product(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query("SELECT min(len(embedding)) AS dimension, count(*) AS n FROM embeddings")
def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.agg(F.lit(vectors.check_dimension(e, "embedding")).cast("bigint").alias("dimension"), F.count("*").alias("n"))


@query(_TOP + " SELECT query_id, vector_pos, score, vec_rank FROM t")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


@query(_TOP + ", r AS (SELECT *, 2 * (q_label = v_label)::INT AS rerank_score FROM t) SELECT query_id, vector_pos, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, vec_rank) AS final_rank FROM r")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hits reranked; that labels are equal stands for a mention of the question in the passage."""
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    hits = _top(spark, d).join(e.toDF("query_id", "q"), "query_id").join(e.toDF("vector_pos", "v"), "vector_pos")
    return rerank.rerank(hits.withColumn("rerank_score", 2 * (F.col("q") == F.col("v")).cast("int"))).select("query_id", "vector_pos", "rerank_score", "final_rank")


def _weigh(name: str, labels: str, weight: int) -> str:
    return f"{weight} * len(list_filter(list_transform(list_filter(coalesce(n.entities, []), lambda e: e.entity_group IN ({labels})), lambda e: lower(coalesce(e.word, ''))), lambda w: contains(lower(coalesce(c.text, '')), w)))"


@query(f"""
    WITH n AS (SELECT DISTINCT doc_id, entities FROM ner_entities), c AS (SELECT DISTINCT doc_id, chunk_id, text FROM chunks)
    SELECT c.doc_id, c.chunk_id, CASE WHEN len(list_filter(coalesce(n.entities, []), lambda e: e.entity_group IN ('CHEM', 'DISO', 'Form', 'Route'))) > 0
        THEN {_weigh('meds', "'CHEM'", 2)} + {_weigh('diso', "'DISO'", 1)} + {_weigh('forms', "'Form', 'Route'", 1)} ELSE -1 END AS rerank_score
    FROM c JOIN n ON c.doc_id = n.doc_id""")
def rerank_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of passages against the mentions of their document; -1 stands for no score."""
    n = _t(spark, d, "ner_entities").select("doc_id", "entities").distinct().select("doc_id", entities.signals(F.col("entities")).alias("s"))
    c = _t(spark, d, "chunks").select("doc_id", "chunk_id", "text").distinct()
    return c.join(n, "doc_id").select("doc_id", "chunk_id", F.coalesce(rerank.rerank_score(F.col("s"), F.col("text")), F.lit(-1)).cast("bigint").alias("rerank_score"))


@query("""
    WITH b AS (SELECT coalesce(max(vector_pos), -1) + 1 AS base FROM metadata WHERE batch_id = 1)
    SELECT base + row_number() OVER (ORDER BY batch_id, m.vector_pos) - 1 AS vector_pos, uid, m.vector_pos AS old FROM metadata m, b WHERE batch_id > 1""")
def index_append(spark: SparkSession, d: str) -> DataFrame:
    """Positions of later batches if they were appended to the first."""
    m = _t(spark, d, "metadata")
    new = m.filter("batch_id > 1").select("batch_id", F.col("vector_pos").alias("old"), "uid")
    return vectors.next_positions(m.filter("batch_id = 1"), new, ["batch_id", "old"]).select("vector_pos", "uid", "old")


@query("""
    WITH m AS (SELECT uid, text, vector_pos AS old, batch_id > 1 AS later FROM metadata),
    p AS (SELECT *, row_number() OVER (ORDER BY later, uid, old) - 1 AS vector_pos FROM m)
    SELECT vector_pos, uid, old, text FROM p WHERE later OR uid IS NULL OR uid NOT IN (SELECT uid FROM m WHERE later AND uid IS NOT NULL)""")
def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """A written vector table: the first load, then all later batches, which replace the rows of their uids."""
    m = _t(spark, d, "metadata").select("uid", F.col("vector_pos").alias("old"), "text", "batch_id")
    m = spread(m).withColumn("embedding", providers.embedding(F.col("text")))
    at = scratch(spark, "vectors")
    vectortable.append(at, m.filter("batch_id = 1").drop("batch_id"), order=("uid", "old"))
    vectortable.append(at, m.filter("batch_id > 1").drop("batch_id"), order=("uid", "old"), upsert=True)
    return vectortable.load(spark, at).select("vector_pos", "uid", "old", "text")


@query("SELECT uid, max(vector_pos) AS position FROM metadata GROUP BY uid")
def mapping_latest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.latest_positions(_t(spark, d, "metadata"))


@query("SELECT uid, count(*) AS n FROM (SELECT document_id || '_' || chunk_id AS uid FROM chunks UNION ALL SELECT uid FROM metadata) GROUP BY uid")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "chunks").select(tx.uid(F.col("document_id"), F.col("chunk_id")).alias("uid"))
    return c.unionByName(_t(spark, d, "metadata").select("uid")).groupBy("uid").agg(F.count("*").alias("n"))


# --- answers and evaluation

_PLAIN = """translate(lower({}), '.,;:()[]"''¿?¡!' || chr(10) || chr(9), '                ')"""
_SETS = r"list_distinct(list_filter(regexp_split_to_array({}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> ''))"
_A, _Q_ = _SETS.format(_PLAIN.format("answer")), _SETS.format(_PLAIN.format("question"))


@query(f"SELECT qa_id, CASE WHEN len({_A}) > 0 THEN round(len(list_intersect({_A}, {_Q_})) / len({_A}), 6) END AS ratio, coalesce(len(list_intersect({_A}, {_Q_})) / nullif(len({_A}), 0) > 0.3, false) AS grounded FROM (SELECT DISTINCT * FROM qa_pairs)")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "qa_pairs").distinct()
    return q.select("qa_id", F.round(answer.grounding_ratio(F.col("answer"), F.col("question")), 6).alias("ratio"), answer.grounded(F.col("answer"), F.col("question")).alias("grounded"))


@query(f"""
    WITH w AS (SELECT DISTINCT qa_id, document_id, unnest({_A}) AS token FROM (SELECT DISTINCT * FROM qa_pairs) WHERE document_id IS NOT NULL),
    c AS (SELECT DISTINCT document_id, unnest({_SETS.format(_PLAIN.format('text'))}) AS token FROM chunks)
    SELECT qa_id, count(*) AS tokens, count(c.token) AS found, count(c.token) / count(*) > 0.3 AS grounded FROM w LEFT JOIN c ON w.document_id = c.document_id AND w.token = c.token GROUP BY qa_id""")
def grounding_in_leaflet(spark: SparkSession, d: str) -> DataFrame:
    """Grounding of each answer in all passages of its leaflet, by a join of tokens, so a leaflet of many passages is never put together in one row."""
    q = _t(spark, d, "qa_pairs").distinct().filter("document_id is not null")
    a = q.select("qa_id", "document_id", F.explode(tx.token_set(F.col("answer"))).alias("token")).distinct()
    c = spread(_t(spark, d, "chunks").select("document_id", "text")).select("document_id", F.explode(tx.token_set(F.col("text"))).alias("token")).distinct().withColumn("hit", F.lit(1))
    by = a.join(c, ["document_id", "token"], "left").groupBy("qa_id").agg(F.count("*").alias("tokens"), F.count("hit").alias("found"))
    return by.withColumn("grounded", F.col("found") / F.col("tokens") > answer.GROUNDED)


@query(f"""
    SELECT qa_id, CASE WHEN question IS NULL THEN 'no_context' WHEN answer = '{answer.ABSTENTION}' THEN 'abstained'
        WHEN NOT coalesce(len(list_intersect({_A}, {_Q_})) / nullif(len({_A}), 0) > 0.3, false) THEN 'invalidated' ELSE 'answered' END AS status
    FROM (SELECT DISTINCT qa_id, question, CASE WHEN qa_id % 7 = 0 THEN '{answer.ABSTENTION}' ELSE answer END AS answer FROM qa_pairs)""")
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each pair; every seventh answer is replaced by the abstention, as the table has none."""
    q = _t(spark, d, "qa_pairs").select("qa_id", "question", F.when(F.col("qa_id") % 7 == 0, answer.ABSTENTION).otherwise(F.col("answer")).alias("answer")).distinct()
    n = F.col("question").isNotNull().cast("int")
    return q.select("qa_id", answer.status(n, F.col("answer"), answer.grounded(F.col("answer"), F.col("question"))).alias("status"))


_EDGE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


_SHOWN = "CASE WHEN vector_pos % 1000 = 0 THEN '0.0' ELSE rtrim(printf('%.3f', (vector_pos % 1000) / 1000.0), '0') END"


@query(f"""
    SELECT document_id, string_agg('(pasaje ' || i || ', de ' || document_id || ', parte ' || coalesce(chunk_id, '?') || ', parecido ' || {_SHOWN} || ')' || chr(10) || regexp_replace(regexp_replace(coalesce(text, ''), '^{_EDGE}', ''), '{_EDGE}$', '') || chr(10), chr(10) ORDER BY i) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY vector_pos) AS i FROM metadata QUALIFY i <= 5) GROUP BY document_id""")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    """The context of the first five passages of each leaflet: a top five, as of a question, with scores that stand for its own."""
    from pyspark.sql import Window

    m = _t(spark, d, "metadata").withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("vector_pos"))).filter("i <= 5")
    hits = m.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "document_id", "chunk_id", "text", (F.col("vector_pos") % 1000 / 1000.0).alias("score")))).alias("hits"))
    return hits.select("document_id", answer.context_block(F.col("hits")).alias("block"))


_LISTED = lambda labels: f"coalesce(nullif(array_to_string(list_transform(list_filter(coalesce(entities, []), lambda e: e.entity_group IN ({labels})), lambda e: lower(coalesce(e.word, ''))), ', '), ''), 'ninguno')"


@query(f"""
    SELECT doc_id, 'Pregunta: <Q>¿' || document_id || '?</Q>' || chr(10) || 'Medicamentos: ' || {_LISTED("'CHEM'")} || chr(10) || 'Patologías y síntomas: ' || {_LISTED("'DISO'")} || chr(10) || 'Formas y vías: ' || {_LISTED("'Form', 'Route'")}
        || chr(10) || chr(10) || '<contexto>' || chr(10) || document_id || chr(10) || '</contexto>' || chr(10) || chr(10) || 'Responde de forma clara y breve.' AS prompt FROM ner_entities""")
def user_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that name what a question mentions; the name of the leaflet stands for question and context."""
    n = _t(spark, d, "ner_entities")
    return n.select("doc_id", answer.user_prompt(F.concat(F.lit("¿"), "document_id", F.lit("?")), F.col("document_id"), entities.signals(F.col("entities"))).alias("prompt"))


_LEX = (("dosis", "TERM"), ("dose", "TERM"), ("medicamento", "CHEM"), ("días", "TIME"), ("days", "TIME"))


@query(f"""
    SELECT qa_id, CAST(len(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'), lambda w: lower(w) IN ({', '.join(repr(w) for w, _ in _LEX)}))) AS BIGINT) AS mentions
    FROM (SELECT DISTINCT qa_id, question FROM qa_pairs WHERE question IS NOT NULL)""")
def tag_questions(spark: SparkSession, d: str) -> DataFrame:
    """What questions mention, by a tagger that runs in the workers."""
    q = _t(spark, d, "qa_pairs").select(F.col("qa_id").alias("query_id"), "question").filter("question is not null").distinct()
    got = answer.tag_questions(q, lambda: providers.LexiconTagger(_LEX))
    return got.select(F.col("query_id").alias("qa_id"), F.size("entities").cast("bigint").alias("mentions"))


_MEANS = ", ".join(f"round(avg(CASE WHEN NOT isnan({m}) THEN {m} END), 9) AS {m}" for m in schemas.METRICS)


@query(f"SELECT dataset, grouping(dataset)::INT AS is_total, count(*) AS n, {_MEANS} FROM (SELECT DISTINCT * FROM eval_metrics) GROUP BY GROUPING SETS ((dataset), ())")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means of the values that are there and no NaN, each row once."""
    s = evaluate.summary(_t(spark, d, "eval_metrics").distinct())
    return s.select("dataset", "is_total", "n", *[F.round(m, 9).alias(m) for m in schemas.METRICS])


_LIST = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}.,;:()\[\]\"''¿?¡!]+'), lambda x: x <> '')"
_BUCKETS = "list_transform({}, lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64)"


@query(f"""
    WITH b AS (SELECT qa_id, {_BUCKETS.format(_LIST.format('answer'))} AS a, {_BUCKETS.format(_LIST.format('question'))} AS q FROM (SELECT DISTINCT qa_id, question, answer FROM qa_pairs)),
    s AS (SELECT qa_id, CASE WHEN len(a) > 0 AND len(q) > 0 THEN len(list_filter(a, lambda x: list_contains(q, x))) / len(a) ELSE 0.0 END AS p, CASE WHEN len(a) > 0 AND len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(a, x))) / len(q) ELSE 0.0 END AS r FROM b)
    SELECT qa_id, round((p - 0.1) / 0.9, 6) + 0.0 AS "precision", round((r - 0.1) / 0.9, 6) + 0.0 AS recall, round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END - 0.2) / 0.8, 6) + 0.0 AS f1 FROM s""")
def bert_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of token vectors between answer and question, rescaled; the embedder without a network gives each token the unit vector of its bucket."""
    q = _t(spark, d, "qa_pairs").select("qa_id", "question", "answer").distinct()
    s = spread(q).select("qa_id", evaluate.bert_score(F.col("answer"), F.col("question"), baseline=(0.1, 0.1, 0.2)).alias("s"))
    return s.select("qa_id", *[(F.round(f"s.{n}", 6) + F.lit(0.0)).alias(n) for n in ("precision", "recall", "f1")])


_REPLIES = ('{"score": 0.7}', 'x {"score": 1.5} y', '{"a": {"score": 1}}', '{"score": "0.7"}', '{"score": null}', "{}", "no", '{"score": -1}', 'a {"score":0.2} {"score":0.9}', '{"score":1} xx', '[{"question":"a","answer":"b"}] z', "] [")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _REPLIES)), (F.col("event_id") % len(_REPLIES) + 1).cast("int")).alias("reply"))


_REPLIED = "(SELECT event_id, ([" + ", ".join("'" + r + "'" for r in _REPLIES) + f"])[event_id % {len(_REPLIES)} + 1] AS reply FROM events)"


def _json_score(x: str) -> str:
    return f"coalesce(TRY_CAST(CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.score') END AS DOUBLE), 0.0)"


@query(f"SELECT event_id, greatest(0.0, least(1.0, {_json_score('j')})) AS score FROM (SELECT event_id, regexp_extract(reply, '\\{{.*?\\}}') AS j FROM {_REPLIED})")
def parse_judge_score(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("event_id", parsing.judge_score(F.col("reply")).alias("score"))


@query(f"SELECT event_id, CASE WHEN regexp_full_match(reply, '\\s*\\{{.*\\}}\\s*') THEN {_json_score('reply')} ELSE 0.0 END AS score FROM {_REPLIED}")
def parse_validation_score(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("event_id", parsing.validation_score(F.col("reply")).alias("score"))


_CHECKED = """'{"faithful": true, "score": 0.' || lpad(CAST(eval_id * 37 % 1000 AS VARCHAR), 3, '0') || '}'"""


@query(f"SELECT eval_id FROM (SELECT DISTINCT eval_id, {_CHECKED} AS reply FROM eval_metrics) WHERE {_json_score('reply')} >= 0.6")
def qa_accept_filter(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a check on both sides of the threshold."""
    reply = F.concat(F.lit('{"faithful": true, "score": 0.'), F.lpad((F.col("eval_id") * 37 % 1000).cast("string"), 3, "0"), F.lit("}"))
    checked = _t(spark, d, "eval_metrics").select("eval_id", reply.alias("reply")).distinct()
    return checked.filter(parsing.accepted(parsing.validation_score(F.col("reply")))).select("eval_id")


@query("SELECT qa_id, question, answer FROM (SELECT DISTINCT qa_id, question, answer FROM qa_pairs) WHERE question IS NOT NULL AND answer IS NOT NULL")
def extract_qa_json(spark: SparkSession, d: str) -> DataFrame:
    """Pairs out of replies that hold them in an array between other text; one without question or answer is left out."""
    q = _t(spark, d, "qa_pairs").select("qa_id", "question", "answer").distinct()
    reply = F.concat(F.lit("Aquí: "), F.to_json(F.array(F.struct("question", "answer"))), F.lit("\n} fin"))
    return q.select("qa_id", F.explode(parsing.qa_pairs(reply)).alias("p")).select("qa_id", "p.question", "p.answer")


# --- whole ways, with the deterministic providers


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "metadata").filter("text is not null and text <> ''")
    table = spread(m.select("vector_pos", "document_id", "chunk_id", "text")).select("vector_pos", "document_id", "chunk_id", "text", providers.embedding(F.col("text")).alias("embedding"))
    none = F.array().cast(schemas.ENTITIES)
    drug = F.regexp_extract("question", r"([A-Z][a-z]{6,}(?:-q)?)", 1)
    mention = F.array(F.struct(F.lit("CHEM").alias("entity_group"), drug.alias("word"), F.lit(0).alias("start")))
    q = _t(spark, d, "qa_pairs").filter("qa_id % 50 = 0 and question is not null").dropDuplicates(["qa_id"])
    return answer.retrieve(q.select(F.col("qa_id").alias("query_id"), "question", F.when(drug != "", mention).otherwise(none).alias("entities")), table)


_BAGS = "SELECT {0}, {1} AS b, count(*)::DOUBLE AS c FROM (SELECT {0}, unnest(list_distinct({2})) AS w FROM {3}) GROUP BY ALL"


@query(f"""
    WITH q AS (SELECT DISTINCT qa_id AS query_id, question, regexp_extract(question, '([A-Z][a-z]{{6,}}(?:-q)?)', 1) AS drug FROM qa_pairs WHERE qa_id % 50 = 0 AND question IS NOT NULL),
    m AS (SELECT vector_pos, text FROM metadata WHERE text <> ''),
    x AS ({_BAGS.format('query_id', "('0x' || substr(md5(w), 1, 8))::UBIGINT % 64", _LIST.format('question'), 'q')}),
    y AS ({_BAGS.format('vector_pos', "('0x' || substr(md5(w), 1, 8))::UBIGINT % 64", _LIST.format('text'), 'm')}),
    nx AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM x GROUP BY 1), ny AS (SELECT vector_pos, sqrt(sum(c * c)) AS n FROM y GROUP BY 1),
    s AS (SELECT query_id, vector_pos, sum(x.c * y.c) AS dot FROM x JOIN y USING (b) GROUP BY 1, 2),
    t AS (SELECT query_id, vector_pos, round(dot / nx.n / ny.n, 6) AS score FROM s JOIN nx USING (query_id) JOIN ny USING (vector_pos)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_pos) AS vec_rank FROM t QUALIFY vec_rank <= 5),
    r AS (SELECT k.*, CASE WHEN drug <> '' THEN 2 * contains(lower(text), lower(drug))::INT ELSE -1 END AS rerank_score FROM k JOIN q USING (query_id) JOIN m USING (vector_pos))
    SELECT query_id, vector_pos, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY greatest(rerank_score, 0) DESC, score DESC, vec_rank) AS final_rank FROM r""")
def rag_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits of questions by hashed words, reranked by the drug that they name; -1 stands for no rerank score."""
    h = _retrieved(spark, d).select("query_id", F.explode("hits").alias("h"))
    return h.select("query_id", "h.vector_pos", "h.score", F.coalesce("h.rerank_score", F.lit(-1)).alias("rerank_score"), "h.final_rank")


def _model() -> providers.Extractive:
    return providers.Extractive(answer.ABSTENTION)


@query()
def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    got = answer.answer(_retrieved(spark, d), _model)
    return got.select("query_id", "question", "answer", "status", F.size("hits").alias("n_hits"))


@query()
def rag_evaluation(spark: SparkSession, d: str) -> DataFrame:
    truth = _t(spark, d, "qa_pairs").dropDuplicates(["qa_id"]).select(F.col("qa_id").alias("query_id"), F.col("answer").alias("truth"), "dataset")
    return evaluate.summary(evaluate.evaluate(_retrieved(spark, d).join(truth, "query_id"), _model))


class _Maker:
    """Makes one pair of each section, from its first line; its check scores a pair by the last figure of the answer's length."""

    def reply(self, conversations: list, temperature: float, most_tokens: int | None) -> list[str]:
        import json

        out = []
        for (message,) in conversations:
            p = message["content"]
            if "{score}" in p:
                out.append('{"faithful": true, "score": 0.%d}' % (len(p.split("<A>")[1].split("</A>")[0]) % 10))
            else:
                body = p.split("TEXTO:\n")[-1].strip().split("\n")[0]
                out.append("Aquí: " + json.dumps([{"question": "¿Qué dice la sección?", "answer": body}], ensure_ascii=False) if body else "nada")
        return out


@query(f"""
    {_SECTIONS_SQL}, f AS (SELECT doc_id, title, string_split(regexp_replace(regexp_replace(body, '^{_EDGE}', ''), '{_EDGE}$', ''), chr(10))[1] AS answer FROM o)
    SELECT doc_id, title, '¿Qué dice la sección?' AS question, answer, (length(answer) % 10) / 10.0 AS score FROM f WHERE answer <> '' AND length(answer) % 10 >= 6""")
def qa_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Pairs made of sections, and the ones among them that the check accepts."""
    return qa.build(sections.split_sections(_t(spark, d, "documents"), headings=_HEADS), _Maker)


def entry(spark: SparkSession, d: str) -> DataFrame:
    return rag_answers(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
