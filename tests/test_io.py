import json

import pytest

from lectern.sources import io


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("uno\r\ndos\rtres".encode())
    assert tuple(io.read_texts(spark, str(tmp_path / "a.txt")).first()) == ("a", "uno\ndos\ntres")
    ents = [{"entity_group": "CHEM", "word": "x", "start": 3, "other": 1}]
    for name, value in (("bare", ents), ("env", {"input_file": "i", "output_file": "o", "entities": ents}), ("bad", {"no": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = {r[0]: r[1] and [tuple(x) for x in r[1]] for r in io.read_entities(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"bare": [("CHEM", "x", 3)], "env": [("CHEM", "x", 3)], "bad": None}


def test_chunks_and_pairs(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"chunk_id": "chunk_0", "text": "ñ", "start": 0, "end": 1, "entities": {"A": ["b"]}}]))
    r = io.read_chunks(spark, str(tmp_path / "d.json")).first()
    assert (r["document_id"], r["text"], r["entities"]) == ("d", "ñ", {"A": ["b"]})
    (tmp_path / "q.json").write_text(json.dumps([{"question": 'di "sí"', "answer": "a,b"}]))
    qa = io.read_qa(spark, str(tmp_path / "q.json"))
    io.write_qa_csv(qa, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()
    assert tuple(back) == ('di "sí"', "a,b")
    io.write_qa_csv(spark.createDataFrame([(" q\n", "  ")], "question string, answer string"), str(tmp_path / "blank"))
    assert tuple(spark.read.csv(str(tmp_path / "blank"), header=True, escape='"', multiLine=True).first()) == (" q\n", "  ")
    with pytest.raises(Exception, match="(?i)not.*exist|path"):
        io.read_qa(spark, str(tmp_path / "none.json")).count()


def test_pages_to_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "hoja.v1.bin").write_text("uno  dos\fﬁn\x01\n\n\n\n")
    (tmp_path / "in" / "empty.bin").write_text(" ")
    got = {r["document_id"]: r["text"] for r in io.pages_to_documents(spark, str(tmp_path / "in"), io.plain_pages, str(tmp_path / "out")).collect()}
    assert got == {"hoja.v1": "uno dos\n\nfin", "empty": ""}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pages(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(b"one|two||")
    pages = io.read_pages(spark, str(tmp_path / "p.bin"), lambda b: b.decode().split("|")[:3])
    assert io.join_pages(pages).first()["text"] == "one\n\ntwo\n\n\n\n"
