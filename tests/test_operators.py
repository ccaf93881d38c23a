import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import versions
from lectern.operators import answer, chunking, entities, evaluate, providers, qa, rerank, sections, vectors, vectortable
from lectern.streaming import ingest

SPANS = [
    ("", []), ("a", [(0, 1)]), ("a" * 200, [(0, 200)]), ("a" * 201, [(0, 201), (1, 201)]), ("a" * 800, [(0, 800), (600, 800)]), ("a" * 801, [(0, 801), (601, 801)]),
    ("a" * 851, [(0, 850), (650, 851), (651, 851)]), ("a" * 1000, [(0, 850), (650, 1000), (800, 1000)]), ("a" * 2000, [(0, 850), (650, 1500), (1300, 2000), (1800, 2000)]),
    ("abcdefghi " * 200, [(0, 809), (609, 1409), (1209, 2000), (1800, 2000)]), ("a" * 800 + " " + "b" * 300, [(0, 800), (600, 1101), (901, 1101)]),
    ("a" * 849 + " " + "b" * 300, [(0, 849), (649, 1150), (950, 1150)]), ("a" * 850 + " " + "b" * 300, [(0, 850), (650, 1151), (951, 1151)]), ("a" * 800 + "\t" + "b" * 300, [(0, 850), (650, 1101), (901, 1101)]),
]


@pytest.mark.parametrize(("text", "want"), SPANS)
def test_spans(text, want):
    assert list(chunking.spans(text)) == want


@given(st.text(alphabet="ab \n", max_size=4000))
@settings(max_examples=60, deadline=None)
def test_span_invariants(t):
    got = list(chunking.spans(t))
    assert all(0 < e - s <= 850 for s, e in got) and all(a[0] < b[0] <= a[1] for a, b in zip(got, got[1:]))
    assert not t or (got[0][0] == 0 and got[-1][1] == len(t))


def test_chunk_rows(spark):
    d = spark.createDataFrame([(1, "a" * 1000, "x"), (2, None, "x"), (3, "", "x"), (4, "😀" * 900, "x")], "doc_id bigint, text string, `end` string")
    rows = sorted(map(tuple, chunking.chunk(d).collect()))
    assert [(r[0], r[2], r[4], r[5]) for r in rows if r[0] == 1] == [(1, "chunk_0", 0, 850), (1, "chunk_1", 650, 1000), (1, "chunk_2", 800, 1000)]
    assert all(len(r[3]) == r[5] - r[4] for r in rows) and {r[0] for r in rows} == {1, 4}
    assert len(chunking.chunk(d, drop_tail=True).filter("doc_id = 1").collect()) == 2
    assert chunking.chunk(d.limit(0)).count() == 0


def test_assign(spark):
    c = spark.createDataFrame([(1, 0, 0, 800), (1, 1, 600, 1000), (2, 0, 0, 10)], "doc_id bigint, pos int, start int, end int")
    n = spark.createDataFrame([(1, [("CHEM", str(s), s) for s in (0, 599, 600, 800, 801, 1000, 1001)]), (1, [("CHEM", str(s), s) for s in (0, 599, 600, 800, 801, 1000, 1001)]), (3, None)], "doc_id bigint, entities array<struct<entity_group:string,word:string,start:int>>")
    got = {(r["doc_id"], r["pos"]): r["entities"] for r in entities.with_entities(c, entities.mentions(n)).collect()}
    assert got == {(1, 0): {"CHEM": ["0", "599", "600", "800"]}, (1, 1): {"CHEM": ["600", "800", "801", "1000"]}, (2, 0): {}}


def test_signals(spark):
    d = spark.createDataFrame([([("CHEM", "Ab", 0), ("CHEM", "Ab", 5), ("Dose", None, 1), ("Route", "Oral", 2), ("X", "y", 3)],), (None,)], "e array<struct<entity_group:string,word:string,start:int>>")
    a, b = (r["s"].asDict() for r in d.select(entities.signals(F.col("e")).alias("s")).collect())
    assert a == {"meds": ["ab", "ab"], "doses": [""], "diso": [], "forms": ["oral"]} and all(v == [] for v in b.values())


def test_tag(spark):
    d = spark.createDataFrame([(1, "uno dos\ntres dos")], "doc_id bigint, text string")
    lex = spark.createDataFrame([("dos", "N")], "word string, entity_group string")
    assert sorted(r["start"] for r in entities.tag(d, lex).collect()) == [4, 13]
    d = spark.createDataFrame([(1, "uno dos\ntres dos", "x"), (2, None, "y"), (3, "", "z"), (4, "dos", "w")], "doc_id bigint, text string, word string")
    lex = spark.createDataFrame([("dos", "N"), ("dos", "M"), ("", "E"), (None, "X")], "word string, entity_group string")
    small, large = (sorted(map(tuple, entities.tag(d, lex, bound=b).collect())) for b in (10, 1))
    assert small == large == sorted([(1, 1, "M", "dos", 4), (1, 1, "N", "dos", 4), (1, 3, "M", "dos", 13), (1, 3, "N", "dos", 13), (3, 0, "E", "", 0), (4, 0, "M", "dos", 0), (4, 0, "N", "dos", 0)])
    assert entities.tag(d.limit(0), lex).count() == 0 and entities.tag(d, lex.limit(0)).count() == 0
    plan = entities.tag(d, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_lexicon_tagger():
    t = providers.LexiconTagger([("ácido fólico", "CHEM"), ("ácido", "X"), ("mg", "Dose")])
    assert [(m["word"], m["entity_group"], m["start"]) for m in t("¿Ácido fólico 5mg o 5 mg de ácido?")] == [("Ácido fólico", "CHEM", 1), ("mg", "Dose", 22), ("ácido", "X", 28)]


def test_tagger(spark):
    def make():
        def find(t):
            if "boom" in t:
                raise ValueError("boom")
            return [{"entity_group": "CHEM", "word": t, "start": 0, "more": 1}]

        return find

    d = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (len(r["entities"]), r["error"]) for r in entities.run_tagger(d, make).collect()}
    assert got == {1: (1, None), 2: (0, "ValueError: boom"), 3: (0, None)}


def test_settings(tmp_path):
    from lectern import config

    (tmp_path / "env").write_text("# c\nA = 'x'\n\nB=\n")
    values = config.read_env_file(str(tmp_path / "env"))
    assert config.required("A", values) == "x"
    with pytest.raises(OSError, match="B"):
        config.required("B", values)
    assert config.read_env_file(str(tmp_path / "none")) == {}


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\nConservación del medicamento\nA\nADVERTENCIAS:\nComposición\nB\nconservacion\nC"), (2, None), (3, "nada")], "doc_id bigint, text string")
    assert [tuple(r) for r in sections.split_sections(d).orderBy("ord").collect()] == [(1, 1, "conservacion", "C"), (1, 2, "composicion", "B")]


def test_vectors(spark):
    e = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None)], "vector_pos bigint, embedding array<float>")
    q = e.filter("vector_pos in (3, 7)").withColumnRenamed("vector_pos", "query_id")
    got = vectors.top_k(q, e, k=3).orderBy("query_id", "vec_rank").collect()
    for qid in (3, 7):
        want = sorted(((-round(math.cos(i - qid), 6), i) for i in range(40)))[:3]
        assert [r["vector_pos"] for r in got if r["query_id"] == qid] == [i for _, i in want]
    assert vectors.top_k(q, e.limit(2), k=5).count() == 4
    assert vectors.top_k(q.limit(0), e).count() == 0
    assert vectors.check_dimension(e.filter("vector_pos < 41"), "embedding") == 2
    with pytest.raises(ValueError, match="dimension"):
        vectors.check_dimension(e.filter("vector_pos < 41"), "embedding", 3)


def test_top_k_on_a_grid(spark, monkeypatch):
    e = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(300)], "vector_pos bigint, embedding array<float>")
    q = e.filter("vector_pos < 90").withColumnRenamed("vector_pos", "query_id")
    want = sorted(vectors.top_k(q, e).collect())
    monkeypatch.setattr(vectors, "QUERY_BYTES", 500)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    assert sorted(vectors.top_k(q, e).collect()) == want


def test_vector_table(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        vectortable.load(spark, p)
    rows = spark.createDataFrame([("u1", [1.0, 0.0]), ("u2", [0.0, 1.0])], "uid string, embedding array<float>")
    assert [vectortable.append(p, x) for x in (rows, rows, rows.limit(0))] == [0, 1, 1]
    assert sorted((r["vector_pos"], r["uid"]) for r in vectortable.load(spark, p).collect()) == [(0, "u1"), (1, "u2"), (2, "u1"), (3, "u2")]
    vectortable.append(p, rows.filter("uid = 'u2'"), upsert=True)
    assert sorted((r["vector_pos"], r["uid"]) for r in vectortable.load(spark, p).collect()) == [(0, "u1"), (2, "u1"), (4, "u2")]
    with pytest.raises(ValueError, match="dimension"):
        vectortable.append(p, spark.createDataFrame([("u2", [1.0])], "uid string, embedding array<float>"))
    with pytest.raises(ValueError, match="no vector"):
        vectortable.append(p, spark.createDataFrame([("u2", None)], "uid string, embedding array<float>"))
    with pytest.raises(ValueError, match="dimension 3"):
        vectortable.load(spark, p, dimension=3)
    with pytest.raises(ValueError, match="text"):
        vectortable.load(spark, p, ("vector_pos", "text"))
    # a batch of a stream counts once
    assert [vectortable.append(p, rows, stream="s", batch=b) for b in (0, 0, 1)] == [3, 3, 4]
    # a version that was begun and not ended isn't read, and a number is given once
    (tmp_path / "t" / "versions" / "5.json").write_text("")
    assert vectortable.load(spark, p).count() == 7 and vectortable.append(p, rows) == 6
    with pytest.raises(versions.Conflict):
        versions.Versions(spark, p).commit(6, {})
    (tmp_path / "t" / "parts" / "left").mkdir()
    assert "left" in vectortable.vacuum(spark, p) and vectortable.load(spark, p).count() == 9


def test_many_positions(spark):
    """Rows enough for the adaptive planner to merge and split partitions; one value holds a third of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    n = 3_000_000
    new = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).alias("k"), "id")
    for columns in (["vector_pos"], ["vector_pos", "k", "id"]):
        got = vectors.next_positions(spark.range(7).withColumnRenamed("id", "vector_pos"), new, ["k", "id"]).select(*columns)
        r = got.agg(F.count("*").alias("n"), F.countDistinct("vector_pos").alias("d"), F.min("vector_pos").alias("low"), F.max("vector_pos").alias("high")).first()
        assert tuple(r) == (n, n, 7, n + 6)


def test_positions(spark):
    old = spark.createDataFrame([(5,)], "vector_pos bigint")
    new = spark.range(100).withColumnRenamed("id", "k")
    got = vectors.next_positions(old, new, ["k"]).orderBy("k").collect()
    assert [r["vector_pos"] for r in got] == list(range(6, 106))
    assert vectors.next_positions(old.limit(0), new, ["k"]).agg(F.min("vector_pos")).first()[0] == 0


def test_rerank(spark):
    s = "struct<meds:array<string>,doses:array<string>,diso:array<string>,forms:array<string>>"
    d = spark.createDataFrame([(1, (["x", "x"], [], ["y"], []), t, 0.5, i) for i, t in enumerate(["none", "X", "has y", "x y"])] + [(2, ([], ["5 mg"], [], []), "5 mg", 0.1, 0), (3, ([""], [], [], []), "a", 0.1, 0)], f"query_id int, s {s}, text string, score double, vec_rank int")
    got = rerank.rerank(d.withColumn("rerank_score", rerank.rerank_score(F.col("s"), F.col("text")))).collect()
    by = {(r["query_id"], r["text"]): (r["rerank_score"], r["final_rank"]) for r in got}
    assert by == {(1, "x y"): (5, 1), (1, "X"): (4, 2), (1, "has y"): (1, 3), (1, "none"): (0, 4), (2, "5 mg"): (None, 1), (3, "a"): (2, 1)}


def test_grounding(spark):
    ten = " ".join("abcdefghij")
    d = spark.createDataFrame([(ten, "a b c"), (ten, "a b c d"), ("", "a"), (None, "a"), (".,!", "a"), ("a", None)], "a string, c string")
    assert [r[0] for r in d.select(answer.grounded(F.col("a"), F.col("c"))).collect()] == [False, True, False, False, False, False]


def test_router(spark):
    d = spark.createDataFrame([(0, None, False), (1, f" {answer.ABSTENTION}\n", False), (1, answer.ABSTENTION + " x", False), (1, "a", True)], "n int, a string, g boolean")
    assert [r[0] for r in d.select(answer.status(F.col("n"), F.col("a"), F.col("g"))).collect()] == ["no_context", "abstained", "invalidated", "answered"]


def test_whole_way(spark):
    table = spark.createDataFrame([(0, "d1", "chunk_0", "La dosis de Alfa es de 5 mg al día."), (1, "d2", "chunk_0", "Beta se guarda en nevera.")], "vector_pos bigint, document_id string, chunk_id string, text string").withColumn("embedding", providers.embedding(F.col("text")))
    q = spark.createDataFrame([(1, "¿Cuál es la dosis de Alfa?", [("CHEM", "Alfa", 0)]), (2, "zzzz qqqq", None)], "query_id bigint, question string, entities array<struct<entity_group:string,word:string,start:int>>")
    make = lambda: providers.Extractive(answer.ABSTENTION)
    got = {r["query_id"]: r for r in answer.answer(answer.retrieve(q, table), make).collect()}
    assert (got[1]["status"], got[1]["answer"]) == ("answered", "La dosis de Alfa es de 5 mg al día.") and got[1]["hits"][0]["document_id"] == "d1"
    assert (got[2]["status"], got[2]["answer"], got[2]["hits"]) == ("abstained", answer.ABSTENTION, [])
    # questions without entities are tagged here, and the mention lifts the passage that has it
    tagger = lambda: providers.LexiconTagger([("beta", "CHEM")])
    hits = answer.retrieve(spark.createDataFrame([(1, "¿Cuál es la dosis de 5 mg, de Beta?")], "query_id bigint, question string"), table, tagger=tagger).first()
    assert [h["document_id"] for h in hits["hits"]] == ["d2", "d1"] and hits["signals"]["meds"] == ["beta"]
    bare = answer.retrieve(q.drop("entities"), table, clip=lambda c: F.substring(c, 1, 5)).filter("query_id = 1").first()
    assert bare["signals"]["meds"] == [] and len(bare["hits"]) == 2
    empty = {r["query_id"]: r["status"] for r in answer.answer(answer.retrieve(q, table.limit(0)), make).collect()}
    assert empty == {1: "no_context", 2: "no_context"}


def failing_model():
    class Failing:
        """Fails on what mentions boom; tells how it was asked. Made here, as workers don't have this module."""

        def reply(self, conversations, temperature, most_tokens):
            if any("boom" in m["content"] for c in conversations for m in c):
                raise RuntimeError("boom")
            return [f"{[m['role'] for m in c]} {temperature} {most_tokens}" for c in conversations]

    return Failing


def test_chat(spark):
    Failing = failing_model()
    d = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "k int, u string")
    got = {r["k"]: tuple(r["c"]) for r in d.select("k", providers.chat(F.col("u"), Failing, F.lit("s"), 0.2, 600).alias("c")).collect()}
    assert got == {1: ("['system', 'user'] 0.2 600", None), 2: (None, "RuntimeError: boom"), 3: (None, None)}
    assert d.filter("k = 1").select(providers.chat(F.col("u"), Failing).alias("c")).first()["c"]["reply"] == "['user'] 0.0 None"


def test_failures_are_told_by_row(spark):
    Failing = failing_model()
    hit = "array<struct<final_rank:int,vector_pos:bigint,document_id:string,chunk_id:string,text:string,score:double,rerank_score:int>>"
    none = ([], [], [], [])
    rows = [(1, "q boom", none, None, [(1, 0, "d", "c", "t", 0.5, None)], "t"), (2, "q", none, None, [(1, 0, "d", "c", "['system', 'user'] 0.2 600", 0.5, None)], "t")]
    found = spark.createDataFrame(rows, f"query_id bigint, question string, signals struct<meds:array<string>,doses:array<string>,diso:array<string>,forms:array<string>>, entities array<string>, hits {hit}, truth string")
    got = {r["query_id"]: r for r in answer.answer(found, Failing).collect()}
    assert (got[1]["status"], got[1]["answer"], got[1]["error"], got[1]["hits"]) == ("failed", None, "RuntimeError: boom", [])
    assert (got[2]["status"], got[2]["error"]) == ("answered", None)
    for full in (False, True):
        got = {r["query_id"]: r for r in evaluate.evaluate(found, Failing, full=full).collect()}
        assert got[1]["errors"] == ["RuntimeError: boom"] and got[1]["faithfulness"] is None and got[1]["bert_f1"] is None
        assert got[2]["errors"] == [] and got[2]["faithfulness"] == 0.0
    s = spark.createDataFrame([(1, "boom", "x"), (2, "t", "x")], "doc_id bigint, title string, body string")
    assert [(r["doc_id"], r["error"]) for r in qa.scored_pairs(s, Failing).collect()] == [(1, "RuntimeError: boom")]


def test_bert_score(spark):
    class Two:
        """Tokens are numbers: angles of vectors of any length."""

        def embed_tokens(self, texts):
            import numpy as np

            return [np.array([[2 * math.cos(float(w)), 2 * math.sin(float(w))] for w in t.split()]).reshape(-1, 2) for t in texts]

    d = spark.createDataFrame([("0 1", "0"), ("0.5", "0 1 1"), ("", "1"), (None, "1"), ("1", None)], "a string, b string")
    got = [tuple(round(x, 9) for x in r[0]) for r in d.select(evaluate.bert_score(F.col("a"), F.col("b"), Two)).collect()]
    p, r = (1 + math.cos(1)) / 2, 1.0
    assert got[0] == tuple(round(x, 9) for x in (p, r, 2 * p * r / (p + r)))
    c = round(math.cos(0.5), 9)
    assert got[1] == (c, c, c) and got[2:] == [(0, 0, 0)] * 3
    low = d.limit(1).select(evaluate.bert_score(F.col("a"), F.col("b"), Two, (0.5, 0.5, 0.5)).alias("s")).first()["s"]
    assert round(low["precision"], 9) == round((p - 0.5) / 0.5, 9) and low["recall"] == 1.0


def test_summary(spark):
    m = evaluate.METRICS
    rows = spark.createDataFrame([("a", *[1.0] * 8), ("a", *[0.0] * 8), ("b", *[None] * 8)], "dataset string, " + ", ".join(f"{x} double" for x in m))
    got = {(r["dataset"], r["is_total"]): (r["n"], r["bert_f1"]) for r in evaluate.summary(rows).collect()}
    assert got == {("a", 0): (2, 0.5), ("b", 0): (1, None), (None, 1): (3, 0.5)}
    assert "all questions (n = 3)" in evaluate.report(evaluate.summary(rows))


def test_summary_nan(spark):
    m = evaluate.METRICS
    nan = float("nan")
    rows = spark.createDataFrame([("a", nan, *[1.0] * 7), ("a", *[0.0] * 8), ("b", *[nan] * 8)], "dataset string, " + ", ".join(f"{x} double" for x in m))
    got = {(r["dataset"], r["is_total"]): (r["n"], r[m[0]], r[m[7]]) for r in evaluate.summary(rows).collect()}
    assert got == {("a", 0): (2, 0.0, 0.5), ("b", 0): (1, None, None), (None, 1): (3, 0.0, 0.5)}


def test_qa(spark):
    class Model:
        def reply(self, conversations, temperature, most_tokens):
            prompts = [c[-1]["content"] for c in conversations]
            return ['{"score": 0.5}' if "{score}" in p and "mala" in p else '{"score": 0.9}' if "{score}" in p else '[{"question": "q", "answer": "buena"}, {"question": "q", "answer": "mala"}]' for p in prompts]

    s = spark.createDataFrame([(1, "t", "b")], "doc_id bigint, title string, body string")
    assert [r["answer"] for r in qa.build(s, Model).collect()] == ["buena"]
    assert qa.build(s.limit(0), Model).count() == 0


def test_section_order():
    assert sections.sections_of("a\nConservación x\nuno\n\nAdvertencias\nComposición\ndos\nConservación y\ntres") == [("conservacion", "tres"), ("composicion", "dos")]
    assert sections.sections_of("") == [] and sections.sections_of("Conservación") == []


def test_stream(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("d1", "hola  mundo"), ("d2", None), ("d3", "ﬁn " * 300)], "document_id string, text string").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("document_id string, text string").parquet(src)
        ingest.ingest(spark, stream, table, str(tmp_path / "cp"), tagger=lambda: providers.LexiconTagger([("mundo", "X")])).awaitTermination()
    rows = sorted(vectortable.load(spark, table).collect(), key=lambda r: r["vector_pos"])
    assert [(r["vector_pos"], r["uid"]) for r in rows] == [(0, "d1_chunk_0"), (1, "d3_chunk_0"), (2, "d3_chunk_1"), (3, "d3_chunk_2")]
    assert rows[0]["text"] == "hola mundo" and rows[0]["entities"] == {"X": ["mundo"]} and rows[1]["entities"] == {}
    assert all(len(r["embedding"]) == 64 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows)
    ingest.index(spark.createDataFrame([("d1", "adiós")], "document_id string, text string"), table, upsert=True)
    assert [r["text"] for r in vectortable.load(spark, table).filter("uid = 'd1_chunk_0'").collect()] == ["adiós"]


def test_commands(spark, tmp_path, capsys):
    import json

    from lectern import cli

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_text("Composición\nAlfa es un ﬁltro.\n\f\nConservación\nAlfa se guarda en frío.")
    (tmp_path / "lex.csv").write_text("alfa,CHEM\n")
    (tmp_path / "q.json").write_text(json.dumps([{"question": "¿Dónde se guarda Alfa?", "answer": "En frío"}]))
    texts, table, lex = str(tmp_path / "texts"), str(tmp_path / "table"), str(tmp_path / "lex.csv")
    cli.main(["pages", str(tmp_path / "raw"), texts], spark)
    cli.main(["index", texts, table, "--lexicon", lex], spark)
    cli.main(["evaluate", table, str(tmp_path / "q.json"), "--lexicon", lex, "--full"], spark)
    (tmp_path / "env").write_text("LECTERN_TOP_K=1\n")
    cli.main(["--env", str(tmp_path / "env"), "make-qa", texts, str(tmp_path / "qa"), "--trial"], spark)
    told = capsys.readouterr().out
    assert "1 documents" in told and "dimension 64" in told and "all questions (n = 1)" in told and "pairs written" in told
    lines, out = iter(["", "¿Dónde se guarda Alfa?", "Salir"]), []
    cli.ask(spark, table, cli.Settings.of({"LECTERN_TOP_K": "1"}), providers.HashEmbedder, lambda: providers.Extractive(answer.ABSTENTION), cli.tagger_of(lex), lambda _: next(lines), out.append)
    assert len(out) == 1 and "frío" in out[0] and "[answered]" in out[0]
    with pytest.raises(Exception, match="(?i)path|exist"):
        cli.questions_of(spark, [str(tmp_path / "none.json")]).count()
