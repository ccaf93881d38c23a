import pytest
from pyspark.sql import functions as F

from lectern.functions import parsing, text


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.undo_mojibake, "cafÃ©", "café"),
        (text.undo_mojibake, "café x", "café x"),
        (text.undo_mojibake, "€ cafÃ©", "€ cafÃ©"),
        (text.undo_mojibake, None, None),
        (text.strip_invisible, "a​b", "ab"),
        (text.strip_controls, "a\x00\t\n\rb\x7f", "a\t\n\rb\x7f"),
        (text.expand_ligatures, "ﬁﬂﬀ", "fiflﬀ"),
        (text.squeeze_lines, "a\n\n\n\nb\n\nc", "a\n\nb\n\nc"),
        (text.squeeze_spaces, "a   b\t\tc", "a b\t\tc"),
        (text.strip, "\xa0 \ta b\x1c\n", "a b"),
        (text.universal_newlines, "a\r\nb\rc\n", "a\nb\nc\n"),
        (text.fold_heading, "  Conservación Ü ", "conservacion ü"),
        (text.nfc, "é", "é"),
        (text.normalize, "  cafÃ©  \n\n\n\nx\x01", "café \n\nx"),
        (text.normalize, "cafÃ©​", "cafÃ©"),
        (text.normalize, None, None),
        (text.normalize, "", ""),
        (text.stem, "a.b.json", "a.b"),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == want


def test_tokens(spark):
    assert sorted(one(spark, text.token_set, "Hola, hola\xa0¿qué? (a-b)")) == ["a-b", "hola", "qué"]
    assert one(spark, text.token_set, None) == [] == one(spark, text.token_set, " .,!\n")
    assert one(spark, text.first_token, " a b") == "a"
    assert one(spark, text.first_token, " ") is None


def test_clip(spark):
    class Chars:
        encode = staticmethod(list)
        decode = staticmethod("".join)

    assert one(spark, lambda c: text.clip_tokens(c, 3, Chars), "abcdef") == "abc"
    assert one(spark, lambda c: text.clip_tokens(c, 3, Chars), None) is None
    assert one(spark, lambda c: text.clip_words(c, 2), "a b c") == "a b"


JUDGE = [
    ('{"score": 0.7}', 0.7, 0.7), ('x {"score": 1.5} y', 1.0, 0.0), ('{"a": {"score": 1}}', 0.0, 0.0), ('{"score": "0.7"}', 0.7, 0.7), ('{"score": true}', 1.0, 1.0),
    ('{"score": "true"}', 0.0, 0.0), ('{"score": null}', 0.0, 0.0), ("{}", 0.0, 0.0), ("no", 0.0, 0.0), ("[1]", 0.0, 0.0), ('{"score": [1]}', 0.0, 0.0), ('{"score": -1}', 0.0, -1.0),
    ('a {"score":0.2} {"score":0.9}', 0.2, 0.0), ('{"score": 1e-3}', 0.001, 0.001), ('{\n"score":0.4\n}', 0.4, 0.4), ('```json\n{"score":0.4}\n```', 0.4, 0.0), ('{"score":1} xx', 1.0, 0.0), (None, 0.0, 0.0),
]


@pytest.mark.parametrize(("reply", "judge", "validation"), JUDGE)
def test_scores(spark, reply, judge, validation):
    assert one(spark, parsing.judge_score, reply) == judge
    assert one(spark, parsing.validation_score, reply) == validation


def test_pairs(spark):
    assert [tuple(x) for x in one(spark, parsing.qa_pairs, 'ok [{"question":"a","answer":"b"}, {"question":"c"}] end')] == [("a", "b")]
    for bad in ("] [", "[bad", None, ""):
        assert one(spark, parsing.qa_pairs, bad) == []
    rows = spark.createDataFrame([(0.6,), (0.59,), (float("nan"),)], "s double").filter(parsing.accepted(F.col("s"))).collect()
    assert [r["s"] for r in rows] == [0.6]


def test_fixed(spark):
    d = spark.createDataFrame([(2.675, 0.0625), (0.5, 1 / 3), (-0.0005, 1.0)], "a double, b double")
    got = [tuple(r) for r in d.select(text.fixed(F.col("a"), 2), text.fixed(F.col("b"), 3), text.fixed(F.col("b"), 3, 1)).collect()]
    assert [g[:2] for g in got] == [(f"{a:.2f}", f"{b:.3f}") for a, b in ((2.675, 0.0625), (0.5, 1 / 3), (-0.0005, 1.0))] and [g[2] for g in got] == ["0.062", "0.333", "1.0"]


def test_nfc_batches(spark):
    d = spark.createDataFrame([(1, "e\u0301"), (2, None), (3, "ascii"), (4, "ñandú"), (5, "")], "k int, t string").coalesce(1)
    assert [r[0] for r in d.orderBy("k").select(text.nfc(F.col("t"))).collect()] == ["é", None, "ascii", "ñandú", ""]
    assert d.filter("k > 1").orderBy("k").select(text.nfc(F.col("t"))).first()[0] is None
