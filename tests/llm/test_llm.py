"""Small tests of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm.subjects import posteriors
from lectern.llm import answers, encodings, grayindex, incremental, links, mixing, nearcopies, probing, queries, scans, shingles, splitting, subjects, tokens

WORDS = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("r", "n", "s", "l")]


def passage(r, n=60):
    return " ".join(r.choice(WORDS) for _ in range(n))


def sets(t):
    plain = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
    w = re.findall("[a-z0-9]+", plain)
    return set(zip(w, w[1:], w[2:]))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def passages(seed, n):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
        else:
            texts.append(passage(r))
    return [*texts, None, "", "dos palabras", "á" * 30000]


# --- 1


@pytest.mark.parametrize("text", ["Según la prohibición, señor", "“annexe” – 5 µg ≤ 6 €", "pré-mistura à época"])
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp850", "iso8859-2", "latin-1"])
@pytest.mark.parametrize("layers", [1, 2])
def test_round_trip(text, codec, layers):
    bad = text
    for _ in range(layers):
        data = bad.encode("utf-8")
        table = {b: c for c, b in encodings._BYTES[codec].items()}
        bad = "".join(chr(b) if b < 128 else table[b] for b in data)
    work = encodings.Repairer({})
    assert work.garbled(bad) and work.restore(bad) == text
    assert not work.garbled(text) and work.restore(text) == text


def test_encodings(spark):
    rows = [(1, "segÃºn", "x"), (2, None, "x"), (3, "", "x"), (4, "Золдорин ñandú", "x"), (5, "la federaci�n", "x"), (6, "la revisi�n", "x"), (1, "segÃºn", "x"), *[(10 + i, "la revisión según lo dicho", "x") for i in range(15)], (30, "la revisiуn segъn lo dicho", "x"), (31, "á" * 50000, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, garbled string")
    got = {r["doc_id"]: (r["garbled"], r["text"]) for r in encodings.repaired(d).collect()}
    assert got[1] == (True, "según") and got[30] == (True, "la revisión según lo dicho") and got[5] == (True, "la federaci�n") and got[6] == (True, "la revisión")
    assert got[2] == (False, None) and got[3] == (False, "") and not got[4][0] and not got[10][0] and not got[31][0]
    assert encodings.repaired(d.limit(0)).count() == 0


def test_words_beyond_the_bound(spark):
    r = random.Random(31)
    good = ["según", "revisión", "señal", "dosis", "cápsula", "niño", "también", "inyección"]
    rows = [(i, " ".join(r.choice(good) for _ in range(30))) for i in range(60)]
    bad = [(100 + i, t.encode().decode(c, "replace") if c != "cp1251" else t.encode("cp1252").decode("cp1251")) for i, ((_, t), c) in enumerate(zip(rows, ["cp1252", "latin-1", "cp1251", *["cp1252", "latin-1"] * 10, "cp1252"]))]
    d = spark.createDataFrame([*rows, *bad, bad[0], (300, None), (301, ""), (302, "revisi\ufffdn según " + "ñ" * 500)], "doc_id bigint, text string")
    one, two = (sorted(map(tuple, encodings.repaired(d, bound=b).collect()), key=str) for b in (10**6, 1))
    assert one == two and {x[0] for x in one if x[1]} == {*range(100, 124), 302}
    got = {x[0]: x[2] for x in one}
    assert all(got[100 + i] == rows[i][1] for i in range(24)) and got[302].startswith("revisión según")


def test_restoring_is_scored(spark):
    r = random.Random(51)
    good = ["según", "revisión", "señal", "dosis", "cápsula", "niño", "también", "inyección", "médico"]
    d = spark.createDataFrame([(" ".join(r.choice(good) for _ in range(40)),) for _ in range(600)] + [(None,), ("",)], "text string")
    got = encodings.repair_accuracy(d).collect()
    assert sum(x["documents"] for x in got) > 10 and all(x["found"] == x["restored"] == x["documents"] for x in got if "0 layers" not in x["way"])
    assert encodings.repair_accuracy(d.limit(0)).count() == 0


def test_layers_without_end():
    bad = "á" * 3
    for _ in range(7):
        bad = bad.encode().decode("latin-1")
    assert encodings.unnest(bad) == "á" * 3


@pytest.mark.parametrize("times", [1, 40])
def test_rare_and_frequent(times):
    # what is told of a word is the same when everything is there forty times as often
    known = {"revisión": 200 * times, "revisiуn": 3 * times, "según": 100 * times, "segъn": 30 * times}
    work = encodings.Repairer(known)
    assert work.word("revisiуn") == (True, "revisión") and not work.word("segъn")[0] and not work.word("revisión")[0]


def test_frequent_lost_bytes():
    # lost bytes are found however many documents have the word; a frequent capital within a word is not
    work = encodings.Repairer({"revisi\ufffdn": 5000, "pausi\x93n": 5000, "miÉl": 5000, "según": 9000})
    assert work.garbled("la revisi\ufffdn") and work.garbled("la pausi\x93n") and not work.garbled("según miÉl")


# --- 2


@given(st.text(alphabet="abc .\n,é́", min_size=0, max_size=3000), st.sampled_from([(850, 200), (100, 20)]))
@settings(max_examples=60, deadline=None)
def test_plan(t, size):
    limit, overlap = size
    at = [0, *splitting.plan(t, 0, len(t), limit, overlap)]
    assert at[-1] == len(t) and all(0 < b - a <= limit - overlap for a, b in zip(at, at[1:]))


def test_pieces(spark):
    r = random.Random(1)
    long = ". ".join(passage(r, 9).capitalize() for _ in range(900))
    rows = [("d", "c0", "a" * 850, 0, 1), ("d", "c1", "b" * 851, 10, 1), ("d", "c2", long, None, 1), ("d", "c2", long, None, 1), ("d", "c3", None, 0, 1), ("d", "c4", "", 0, 1), (None, "c5", "x y " * 400, 0, 1)]
    d = spark.createDataFrame(rows, "document_id string, chunk_id string, text string, start int, piece int")
    for size in (2000, 1 << 16):
        out = splitting.oversized_pieces(d, range_size=size).orderBy("piece").collect()
        by = {}
        for x in out:
            by.setdefault(x["chunk_id"], []).append(x)
        assert set(by) == {"c1", "c2", "c5"}
        for k, x in by.items():
            assert [p["piece"] for p in x] == list(range(len(x))) and all(len(p["text"]) <= 850 and len(p["text"]) == p["end"] - p["start"] for p in x)
            assert all(a["end"] - b["start"] == 200 for a, b in zip(x, x[1:]))
            assert "".join([x[0]["text"], *[p["text"][200:] for p in x[1:]]]) == {"c1": "b" * 851, "c2": long, "c5": "x y " * 400}[k]
    assert splitting.oversized_pieces(d.limit(0)).count() == 0


def test_cut_before_long_run(spark):
    prose = "Una frase. Otra frase termina aquí.\n"
    text = "x" * 400 + "\n" + "y" * 100 + " " + "z" * 3000
    assert splitting.plan(text, 0, len(text))[0] == 401
    # a boundary in the first half only, behind a cut and at the start of the text
    text = prose * 20 + "z" * 2000
    cuts = splitting.plan(text, 0, len(text))
    assert 20 * len(prose) in cuts and cuts[cuts.index(20 * len(prose)) + 1] == 20 * len(prose) + 650
    text = prose * 8 + "z" * 2000
    assert splitting.plan(text, 0, len(text))[0] == 8 * len(prose)
    # neighbours share 200 code points even if the only boundary lies before
    text = prose + "z" * 2000
    assert splitting.plan(text, 0, len(text))[0] == 650
    # a range's edge within the run
    text = "a b. " * 390 + "z" * 9000
    d = spark.createDataFrame([("d", "c", text, 0)], "document_id string, chunk_id string, text string, start int")
    p = splitting.oversized_pieces(d, range_size=2000).orderBy("piece").collect()
    assert 1950 in {x["end"] for x in p} and 2000 not in {x["end"] for x in p}
    assert all(a["end"] - b["start"] == 200 for a, b in zip(p, p[1:])) and "".join([p[0]["text"], *[x["text"][200:] for x in p[1:]]]) == text


def test_pieces_of_rows_that_share_a_key(spark):
    a, b = "uno dos. " * 400, "tres cuatro. " * 900
    rows = [("d", "c", a, 0, "x"), ("d", "c", b, 0, "x"), ("d", "c", b, 5, "x"), ("d", None, a, 0, "x"), ("d", None, a, 0, "y")]
    d = spark.createDataFrame(rows, "document_id string, chunk_id string, text string, start int, text_id string")
    for size in (3000, 1 << 16):
        by = {}
        for x in splitting.oversized_pieces(d, range_size=size).orderBy("piece").collect():
            by.setdefault((x["chunk_id"], x["text_id"]), []).append(x)
        assert sorted((k[0] or "", p[0]["start"], "".join([p[0]["text"], *[x["text"][200:] for x in p[1:]]])) for k, p in by.items()) == sorted([("c", 0, a), ("c", 0, b), ("c", 5, b), ("", 0, a)])
        assert all([x["piece"] for x in p] == list(range(len(p))) for p in by.values())


@given(st.binary(max_size=40) | st.text(max_size=12).map(lambda t: t.encode()) | st.lists(st.sampled_from([b"\x80", b"\xe2", b"\xe2\x82", b"\xf0\x9f", b"a", "€".encode(), "😀".encode(), b"\xff", b"\xc3"]), max_size=20).map(b"".join))
@settings(max_examples=400, deadline=None)
def test_synced(data):
    whole = data.decode("utf-8", "replace")
    for p in range(len(data) + 1):
        q = splitting.synced(data, p)
        assert p <= q <= p + 3 and data[:q].decode("utf-8", "replace") + data[q:].decode("utf-8", "replace") == whole


@pytest.mark.parametrize("every", [997, 61, 7])
def test_file_with_bad_bytes(spark, tmp_path, every):
    r = random.Random(every)
    data = bytearray(". ".join(passage(r, 12) + " ñ€😀" for _ in range(900)).encode())
    for i in range(0, len(data), every):
        data[i] = r.choice([0x80, 0xBF, 0xC3, 0xE2, 0xF0, 0xFF, data[i]])
    data[30_000:30_000] = b"\x80" * 7000 + b"\xf0\x9f" * 3000
    (tmp_path / "f").write_bytes(data)
    text = bytes(data).decode("utf-8", "replace")
    for size in (7001, 20_000, 1 << 22):
        p = splitting.file_pieces(spark, str(tmp_path / "f"), range_size=size).orderBy("piece").collect()
        assert [x["piece"] for x in p] == list(range(len(p))) and all(text[x["start"] : x["end"]] == x["text"] and len(x["text"]) <= 850 for x in p)
        assert "".join([p[0]["text"], *[x["text"][200:] for x in p[1:]]]) == text


def test_folder_of_files(spark, tmp_path):
    for name, text in (("a", "uno. " * 3000), ("b", ""), ("c", "x"), ("_no", "y")):
        (tmp_path / name).write_text(text)
    got = splitting.file_pieces(spark, str(tmp_path), range_size=7000).groupBy("file").agg(F.max("end").alias("n"), F.count("*").alias("k"), F.max("piece").alias("m")).collect()
    assert {r["file"].rsplit("/")[-1]: r["n"] for r in got} == {"a": 15000, "c": 1} and all(r["k"] == r["m"] + 1 for r in got)


@pytest.mark.parametrize("size", [5000, 1 << 20])
def test_file(spark, tmp_path, size):
    r = random.Random(2)
    text = "\n\n".join(passage(r, 40) + " ñ€😀." for _ in range(200))
    (tmp_path / "f").write_text(text)
    p = splitting.file_pieces(spark, str(tmp_path / "f"), range_size=size).orderBy("piece").collect()
    assert [x["piece"] for x in p] == list(range(len(p))) and all(text[x["start"] : x["end"]] == x["text"] and len(x["text"]) <= 850 for x in p)
    assert p[-1]["end"] == len(text) and all(a["end"] - b["start"] == 200 for a, b in zip(p, p[1:]))
    (tmp_path / "e").write_text("")
    assert splitting.file_pieces(spark, str(tmp_path / "e")).count() == 0


# --- 3 and 5


def test_shingles():
    texts = passages(3, 50) + ["Ñandú  CAFÉ\0con-leche 3º", "ﬁn µg x y z"]
    rows, _ = shingles.shingle_sets(texts)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(sets(t)) for t in texts]
    x = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    assert (shingles.gray_code(shingles.gray_rank(x)) == x).all()


@pytest.mark.parametrize("hot", [4096, 8])
def test_similar_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(grayindex, "BLOCK", 16)
    texts = passages(4, 300)
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "pos bigint, text string, node int")
    s = [sets(t) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i) if jaccard(s[i], s[j]) >= 0.7}
    want = {(j, i) for i, j in want}
    plain = grayindex.candidate_pairs
    monkeypatch.setattr(grayindex, "candidate_pairs", lambda k: plain(k, hot=hot))
    got = {tuple(r) for r in nearcopies.similar_pairs(d, "pos").collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    if hot == 8:
        # shares of files, whose edges part groups, give the same
        monkeypatch.setattr(grayindex, "candidate_pairs", lambda k: plain(k, hot=hot, share=3000))
        assert {tuple(r) for r in nearcopies.similar_pairs(d, "pos", part=2).collect()} == got
        return
    monkeypatch.setattr(grayindex, "candidate_pairs", plain)
    assert {tuple(r) for r in nearcopies.similar_pairs(d, "pos", exact=True).collect()} == want
    groups = {r["pos"]: r["group_id"] for r in nearcopies.copy_groups(d, "pos").collect()}
    assert set(groups) == set(range(len(texts)))
    for i, j in got:
        assert groups[i] == groups[j]
    assert nearcopies.similar_pairs(d.limit(0), "pos").count() == 0 == nearcopies.copy_groups(d.limit(0), "pos").count()


def test_hot_group(spark):
    r = random.Random(8)
    base = passage(r, 40)
    d = spark.createDataFrame([(i, base) for i in range(60)] + [(100 + i, passage(r, 40)) for i in range(120)], "pos bigint, text string")
    assert nearcopies.similar_pairs(d, "pos").count() == 60 * 59 // 2


def test_recall_of_the_index(spark):
    """Against the exact join, on pairs of every similarity from the threshold on."""
    r, texts = random.Random(41), []
    for _ in range(400):
        w = passage(r, 70).split()
        texts.append(" ".join(w))
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    exact = {tuple(x) for x in nearcopies.similar_pairs(d, "pos", exact=True).collect()}
    found = {tuple(x) for x in nearcopies.similar_pairs(d, "pos").collect()}
    assert found <= exact and len(exact) > 250 and len(found) >= 0.99 * len(exact)


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30)), max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_scan_in_shares(rows, size):
    """A stream in any shares, and any batches, gives every pair of a key once its blocks are paired."""
    rows = sorted({(k, n * 7 % 31, n) for k, n in rows})
    want = {(a[2], b[2]) if a[2] < b[2] else (b[2], a[2]) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0]}
    for hot in (3, 1000):
        pairs, blocks = set(), {}
        shares = [rows[i : i + 3 * size] for i in range(0, len(rows), 3 * size)]
        for i, share in enumerate(shares):
            scan = grayindex.Scan(64, hot, len(shares) > 1, i << 20)
            out = [b for at in range(0, len(share), size) for b in scan.add(*[np.array([x[c] for x in share[at : at + size]], np.int64) for c in range(3)])]
            for batch in [*out, *scan.end()]:
                for x in batch.to_pylist():
                    if x["a"] is not None:
                        pairs.add((x["a"], x["b"]))
                    else:
                        assert (x["key"], x["block"]) not in blocks
                        blocks[x["key"], x["block"]] = x["nodes"]
        for (k, p), x in blocks.items():
            for (l, q), y in blocks.items():
                if k == l and p <= q:
                    pairs |= {(min(a, b), max(a, b)) for a in x for b in y if a != b}
        assert pairs == want


def test_components_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="rounds"):
        links.components(chain, most_rounds=1)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {t["node"]: t["component"] for t in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def walk(rows):
    kept, out = [], set()
    for _, pos, t in sorted((b, p, t) for p, t, b in rows):
        s = sets(t)
        if any(jaccard(s, k) >= 0.7 for k in kept):
            out.add(pos)
        else:
            kept.append(s)
    return out


@pytest.mark.parametrize("hot", [4096, 16])
def test_incremental(spark, hot, monkeypatch, tmp_path):
    monkeypatch.setattr(grayindex, "HOT", hot)
    monkeypatch.setattr(grayindex, "BLOCK", 8 if hot == 16 else 512)
    r = random.Random(6)
    rows = [(i, t or "", r.choice([1, 1, 2, 3])) for i, t in enumerate(passages(6, 150))]
    d = spark.createDataFrame([(p, "u", None, t, b, "x") for p, t, b in rows] + [(0, "u", None, rows[0][1], rows[0][2], "x")], "vector_pos bigint, uid string, document_id string, text string, batch_id int, node string")
    want = walk(rows)
    assert {x[0] for x in incremental.not_accepted(d).collect()} == want and len(want) > 30
    assert incremental.not_accepted(d.limit(0)).count() == 0
    # three sessions, each of which knows no more than the path
    step, at = set(), str(tmp_path / "history")
    for b in (1, 2, 3):
        step |= {x[0] for x in incremental.History(spark.newSession(), at, buckets=5).apply(d.filter(F.col("batch_id") == b)).collect()}
    assert step == want
    h = incremental.History(spark, at)
    assert h.buckets == 5 and h.number == 2 and len(h.weights) == 4
    assert h.apply(d.limit(0)).count() == 0
    # every row of the three again: all but those without a shingle are there already
    again = {x[0] for x in h.apply(d).collect()}
    assert again == {p for p, t, _ in rows if sets(t)}


def test_history_merges_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FANOUT", 2)
    rows = [(i, t or "", i % 6) for i, t in enumerate(passages(16, 120))]
    d = spark.createDataFrame([(p, "u", "d", t, b) for p, t, b in rows], "vector_pos bigint, uid string, document_id string, text string, batch_id int")
    at = str(tmp_path / "history")
    got, want = {x[0] for x in incremental.not_accepted(d, path=at).collect()}, walk(rows)
    # a link at the threshold may be missed, and others hang on it
    assert len(got ^ want) <= 0.03 * len(want)
    h = incremental.History(spark, at)
    assert all(len(p) < 6 for p in h.state["parts"].values())
    # a batch that broke off has left parts that no version names, and is taken again
    (tmp_path / "history" / "keys" / "left").mkdir()
    assert "left" in h.vacuum() and set(h.vacuum()) == set()
    late = spark.createDataFrame([(1000, "u", "d", rows[3][1], 9), (1001, "u", "d", passage(random.Random(99), 50), 9)], d.schema)
    assert {x[0] for x in incremental.History(spark, at).apply(late).collect()} == {1000}


def test_probe_reads_what_it_needs(spark, tmp_path):
    at = str(tmp_path / "part")
    probing.write_part(spark.range(200_000).select("id", F.col("id").alias("x")), at, "id", 3)
    files = probing.part_files(spark, at)
    assert sorted(b for b, _, _ in files) == [0, 1, 2]
    wanted = spark.createDataFrame([(5,), (5,), (77_777,), (199_999,), (-3,), (None,)], "id bigint")
    assert sorted(r["id"] for r in probing.probe(wanted, probing.by_bucket([files]), "id", "id bigint, x bigint", 3).collect()) == [5, 77_777, 199_999]
    low, high = np.array([0, 10, 20]), np.array([9, 19, 29])
    assert probing.groups_with(low, high, np.array([10, 12, 40])).tolist() == [1]
    got = [(i, j) for a, b in probing.matches(np.array([1, 3, 3, 9]), np.array([1, 1, 3, 4]), 2) for i, j in zip(a.tolist(), b.tolist())]
    assert got == [(0, 0), (0, 1), (1, 2), (2, 2)]


def test_incremental_any_weights(spark, monkeypatch):
    # no weights, however they are learned, keep a candidate from the exact check: a text against itself many times over
    monkeypatch.setattr(incremental, "fit_weights", lambda x, y: np.array([0.0, 0.0, 0.0, -50.0]))
    short = passage(random.Random(11), 40)
    rows = [(1, short, 1), (2, " ".join([short] * 20), 2), (3, short + " " * 3000, 2), (4, passage(random.Random(12), 40), 2)]
    d = spark.createDataFrame([(p, "u", None, t, b) for p, t, b in rows], "vector_pos bigint, uid string, document_id string, text string, batch_id int")
    assert {x[0] for x in incremental.not_accepted(d).collect()} == walk([(p, t, b) for p, t, b in rows]) == {2, 3}


def test_incremental_reads_rows_once(spark, tmp_path, monkeypatch):
    # whatever the number of batches, each row is read and hashed once; joins that are too large for a broadcast give the same
    rows = [(i, t or "", i % 4) for i, t in enumerate(passages(17, 80))]
    plain = spark.createDataFrame([(p, "u", "d", t, b) for p, t, b in rows], "vector_pos bigint, uid string, document_id string, text string, batch_id int").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    at = str(tmp_path / "history")
    got = {x[0] for x in incremental.not_accepted(plain.mapInArrow(count, plain.schema), path=at).collect()}
    assert read.value == len(rows)
    monkeypatch.setattr(incremental, "LOOKUP_ROWS", 0)
    assert {x[0] for x in incremental.not_accepted(plain).collect()} == got and len(got ^ walk(rows)) <= 0.03 * len(got)
    # classes that are there already write no keys again
    h = incremental.History(spark, at)
    before = len(h.state["parts"]["keys"])
    assert {x[0] for x in h.apply(plain).collect()} == {p for p, t, _ in rows if sets(t)}
    assert len(h.state["parts"]["keys"]) == before


def test_incremental_copies_once(spark, tmp_path, monkeypatch):
    # two texts that are nearly the same, of 60 rows each, in many tasks and in two batches: their keys meet once
    one = passage(random.Random(18), 60)
    two = one + " ban"
    d = spark.createDataFrame([(b * 100 + i, "u", "d", (one, two)[b], b) for b in (0, 1) for i in range(60)], "vector_pos bigint, uid string, document_id string, text string, batch_id int")
    at = str(tmp_path / "history")
    assert {x[0] for x in incremental.not_accepted(d.repartition(20), path=at).collect()} == {*range(1, 60), *range(100, 160)}
    h = incremental.History(spark, at)
    assert h._read("keys", h.state["parts"]["keys"]).count() == 2 * incremental.KEYS
    key, code, node = (np.repeat(np.array(x), 50) for x in ([3, 3, 7], [5, 5, 5], [1, 2, 2]))
    assert [x.tolist() for x in incremental._once(key, code, node)] == [[3, 3, 7], [5, 5, 5], [1, 2, 2]]


# --- 4


def test_scans(spark):
    r = random.Random(9)
    vocabulary = ["paciente", "tratamiento", "durante", "medicina", "informe", "según", "revisión", "producto", "conserva", "temperatura", "envase", "nevera", "semana", "controla", "registro"]
    vocabulary += [w + end for w in WORDS[:60] for end in ("ando", "mente")]
    clean = [(i, ". ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(50)) + ".") for i in range(150)]
    bad = [(1000 + i, scans.noisy(t, r)) for i, (_, t) in enumerate(clean[:40])]
    other = [(2000, None), (2001, ""), (2002, "  \n"), (2003, "1\n2\n3\n\n" + clean[0][1]), (2004, "el medi-\ncina pro-\nducto " + clean[1][1]), (2005, "x" * 30000), (2006, "- paciente\n- envase\n- nevera\n\n" + clean[3][1])]
    d = spark.createDataFrame([(*x, 0) for x in [*clean, *bad, *other]], "doc_id bigint, text string, word int")
    got = {x["doc_id"]: x["text"] for x in scans.read_scans(d).collect()}
    assert len([k for k in got if k < 1000]) == 0 and len([k for k in got if 1000 <= k < 2000]) >= 38
    assert {k for k in got if k >= 2000} == {2004} and "producto" in got[2004] and "pro-" not in got[2004]
    assert scans.read_scans(d.limit(0)).count() == 0
    # most of the noise is gone
    wrong = lambda t: sum(w.strip(".").lower() not in vocabulary for w in t.split())
    pairs = [(b, got[k]) for k, b in bad if k in got]
    assert sum(wrong(t) for _, t in pairs) < 0.35 * sum(wrong(b) for b, _ in pairs)


def test_editor():
    words = ["según", "paciente", "durante", "tomar"]
    e = scans.Editor(scans.Models([*words, *(w + "ar" for w in WORDS)], [], [("pacicnte", "paciente"), ("durarite", "durante")] * 3, []), set(words))
    assert e.edit("pacicnte") == "paciente" and e.edit("durarite") == "durante" and e.edit("t·omar") == "tomar"
    assert e.edit("según") is None and e.edit("helicóptero") is None


def test_joins_are_learned():
    words = [f"{a}{b}" for a in WORDS for b in ("dor", "ción")][:300]
    models = scans.Models(words, ["bardor-lerción"], [], [])
    r = scans.Reader(models, {w: None for w in [*words, "bardor-lerción", "gel", "placa"]})
    w = words[0]
    assert r.joins(w[:3], "-", w[3:]) == w and r.joins(w[:3], "\xad", w[3:]) == w and r.joins(w[:3].upper(), "-", w[3:].upper()) == w.upper()
    assert r.joins("xiloz", "-", "utano") == "xilozutano" and r.joins("gel", "-", "placa") is None and r.joins("bardor", "-", "lerción") is None
    assert r.joins("gel", "¬", "placa") == "gelplaca" and r.joins("Anglo", "-", "Sajón") is None


def test_margin():
    # an edit that no example speaks for isn't made, though it would give a known word
    words = ["paciente", "durante", "conserva", "producto"] * 20
    models = scans.Models(words, [], [], [])
    models.margin = 1e9
    assert scans.Editor(models, {"paciente"}).edit("pacicnte") is None


def test_scan_tables_by_join(spark):
    r = random.Random(21)
    vocabulary = [w + end for w in WORDS for end in ("ando", "mente", "al")]
    clean = [". ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(30)) + "." for _ in range(60)]
    rows = [*enumerate(clean), *[(100 + i, scans.noisy(t, r)) for i, t in enumerate(clean[:20])], (100, scans.noisy(clean[0], r)), (200, None), (201, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    fitted = scans.Fitted(d)
    one, two = (sorted(map(tuple, scans.read_scans(d, fitted=fitted, bound=b).collect())) for b in (10**6, 1))
    assert one == two and len(one) >= 18
    a = scans.repair_accuracy(d).first()
    assert a["documents"] >= 55 and a["wrong_after"] < 0.75 * a["wrong_before"]
    assert scans.repair_accuracy(d.limit(0)).first()["share_mended"] is None


# --- 6


def test_answers(spark):
    good = "La dosis máxima de Alfa es de {} mg al día, repartida en 3 tomas según indique el médico."
    rows = [(i, "¿Cuál es la dosis máxima diaria de Alfa?", good.format(i)) for i in range(20)]
    cases = {
        100: (None, "empty"), 101: (" ​\n", "empty"), 102: ("N/A", "empty"), 103: ("...", "empty"), 104: ("Respuesta:", "empty"),
        110: ("La dosis máxima de Alfa es de 5 mg al día, re", "truncated"), 111: ("La dosis máxima de Alfa es de la", "truncated"), 112: ("La dosis máxima (", "truncated"), 113: ("La dosis máxima de Alfa…", "truncated"),
        120: ("Lo siento, no puedo ayudar con esa consulta.", "refusal"), 121: ("ME TEMO QUE NO SABRÍA DECIRLE.", "refusal"), 122: ("I must decline to answer this.", "refusal"),
        130: ("¿CUÁL ES LA DOSIS MAXIMA DIARIA DE ALFA?", "copy"), 131: ("Me pregunta cuál es la dosis máxima diaria de Alfa.", "copy"),
        140: ("The maximum dose of Alfa is 5 mg per day, split into 3 intakes as the doctor advises.", "other_language"), 141: ("アルファの最大用量は一日五ミリグラムです", "other_language"),
        150: ("5 mg al día", None), 151: ("No", None), 152: (good.format(7)[:-1], None), 153: ("Lamentablemente para quien tiene prisa, " + good.format(9), None), 154: (good.format(3) + " Lo sentirá antes en ayunas.", None),
    }
    rows += [(k, rows[0][1], a) for k, (a, _) in cases.items()] + [(152, rows[0][1], good.format(7)[:-1])] + [(160, None, good.format(1)), (161, "", "a b c")]
    d = spark.createDataFrame([(*x, "x") for x in rows], "qa_id bigint, question string, answer string, f string")
    got = {r["qa_id"]: r["defect"] for r in answers.defect_rows(d).collect()}
    assert got == {k: v for k, (_, v) in cases.items() if v}
    assert answers.scored(d).count() == len(rows)
    assert answers.defect_rows(d.limit(0)).count() == 0


def test_truncation_does_not_fade(spark):
    # answers that are whole, some of them without a full stop, and ones that are cut; ten times as many rows change nothing
    whole = [f"Tome el comprimido con agua cada {i % 9 + 2} horas durante el día" for i in range(60)]
    cut = [f"Tome el comprimido {i} con agua cada seis horas sin masti" for i in range(8)]
    rows = [(i, "¿Cómo se toma?", t + ".") for i, t in enumerate(whole)] + [(100 + i, "¿Cómo se toma?", t) for i, t in enumerate([*whole[:5], *cut])]
    for times in (1, 10):
        d = spark.createDataFrame([(k * 1000 + i, q, a) for k in range(times) for i, q, a in rows], "qa_id bigint, question string, answer string")
        got = {r["qa_id"] % 1000 for r in answers.defect_rows(d).filter("defect = 'truncated'").collect()}
        assert got == {105 + i for i in range(8)}


def test_known_endings_beyond_the_bound(spark, monkeypatch):
    rows = [(i, "¿Cómo se toma el medicamento?", f"Se toma cada día con un vaso {'lleno' if i % 2 else 'grande'}" + "." * (i % 5 > 0)) for i in range(50)]
    d = spark.createDataFrame([*rows, (99, "¿Cómo se toma el medicamento?", "Se toma cada día con un va")], "qa_id bigint, question string, answer string")
    want = sorted(map(tuple, answers.scored(d).collect()))
    monkeypatch.setattr(answers, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, answers.scored(d).collect())) == want and [x for x in want if x[1]] == [(99, ["truncated"])]


# --- 7


@given(st.text(max_size=400), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_chunk_encoding(t, n):
    work = tokens.ChunkEncoder(mean=4, keep=50)
    text = t * n + " palabras y más palabras " * n + t
    assert work.encode(text) == work.plain.encode_ordinary(text) == work.encode(text)


@given(st.text(alphabet="ab1'. ,-\n\t\x1c\x85\u2003ñé€😀sdtmrevl\x00", max_size=120))
@settings(max_examples=400, deadline=None)
def test_joins_are_repaired(t):
    work = tokens.ChunkEncoder(mean=2, keep=30)
    want = work.plain.encode_ordinary(t * 3)
    assert work.encode(t * 3) == want == work.encode(t * 3)
    data = t.encode()
    for at in tokens.exact_splits(np.frombuffer(data, np.uint8)).tolist() if len(data) > 1 else []:
        assert work.plain.encode_ordinary(data[:at].decode()) + work.plain.encode_ordinary(data[at:].decode()) == work.plain.encode_ordinary(t)


def test_chunks_are_reused(spark):
    texts = [passage(random.Random(i % 3), 400) for i in range(30)]
    r = tokens.chunk_reuse(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).first()
    assert r["saved"] > 0.3 * r["bytes"] and r["bytes"] == sum(map(len, texts)) and r["chunks"] > r["reused"] > 0
    assert tuple(tokens.chunk_reuse(spark.createDataFrame([], "text string")).first()) == (0, 0, 0, 0)


def test_token_ids(spark):
    texts = [None, "", " ", "\n\n", "<|endoftext|> x", "it's   ñ 😀", "a" * 20000, "hola mundo. " * 300, "\xa0  x"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")], "doc_id bigint, text string, ids string")
    rows = tokens.token_ids(d).collect()
    plain = tokens.encoder()
    assert len(rows) == 10 and all(r["ids"] == (plain.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else []) for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(d, ["doc_id"]).collect()}
    assert counts[0] == counts[1] == 0 and counts[7] == len(plain.encode_ordinary(texts[7]))
    assert tokens.token_ids(d.limit(0)).count() == 0
    assert sorted(map(tuple, tokens.decoded(tokens.token_ids(d)).collect())) == sorted((r["doc_id"], r["text"] or "") for r in d.collect())


# --- 8


def test_flow():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10}, [(("a",), "a", 2), (("a", "b"), "a", 2), (("a", "b"), "b", 1)], {"a": 25, "b": 8})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 25 and flow[("a", "b"), "b"] == 8
    assert mixing.min_cost_flow({("a",): 10}, [(("a",), "a", 1)], {"a": 50}) == {(("a",), "a"): 10}


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, "big" if i < 300 else "small" if i < 320 else None if i < 330 else "odd", passage(r, r.randrange(1, 60)), 1.0) for i in range(340)]
    docs += [docs[0], (900, "big", None, 1.0), (901, "small", "", 1.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, target_share double")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t)
    s = m.selected()
    got = s.collect()
    assert len({x["doc_id"] for x in got}) == len(got) and all(1 <= x["copies"] <= {"big": 1, "small": 3}[x["source"]] for x in got)
    share = {x["source"]: x["actual_share"] for x in m.shares(s).collect()}
    assert abs(share["big"] - 0.8) < 0.02 and abs(share["small"] - 0.2) < 0.02 and share["none"] == 0
    assert mixing.Mix(d, t).selected().exceptAll(s).count() == 0
    capped = {x["source"]: x for x in mixing.Mix(d, t, total_tokens=10**9).shares().collect()}
    assert capped["small"]["most_copies"] == 3 and capped["big"]["most_copies"] == 1
    assert mixing.Mix(d.limit(0), t).selected().count() == 0 and mixing.Mix(d, t.limit(0)).selected().count() == 0
    lists = d.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("big"), F.lit("small"))).otherwise(F.array("source")))
    assert {x["source"]: round(x["actual_share"], 1) for x in mixing.Mix(lists, t).shares().collect()} == {"big": 0.8, "small": 0.2, "none": 0.0}


def test_scarce_source(spark, tmp_path):
    # one short document of a source with a target must not shrink the mix of the others
    r = random.Random(4)
    docs = [(i, "big" if i < 200 else "other", passage(r, 40)) for i in range(300)] + [(300, "tiny", "una frase corta"), (301, "unused", passage(r, 9000)), (302, None, passage(r, 40))]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.6, 1), ("other", 0.3, 2), ("tiny", 0.1, 3), ("unused", 0.0, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    got = {x["doc_id"]: x for x in queries.p8_mix(spark, str(tmp_path)).collect()}
    assert got[300]["copies"] == 3 and not {301, 302} & got.keys() and len(got) > 250
    share = {x["source"]: x for x in queries.p8_shares(spark, str(tmp_path)).collect()}
    assert share["tiny"]["actual_share"] < 0.1 and share["tiny"]["most_copies"] == 3 and share["unused"]["tokens"] == 0
    assert abs(share["big"]["tokens"] / share["other"]["tokens"] - 2) < 0.05


# --- 9


def test_subjects(spark):
    law = "El tribunal impugna la patente según el reglamento vigente. "
    sport = "El atleta solicita en la pista el control de dopaje otra vez. "
    none = "Quedan pendientes varios apartados del informe para otro momento. "
    rows = [(1, law * 6), (2, sport * 6), (3, law * 3 + sport * 3), (4, law * 9 + sport), (5, none * 5), (6, None), (7, ""), (8, "1\t2\t3\n" * 50), (2, sport * 6)]
    d = spark.createDataFrame([(*x, None, None, "x") for x in rows], "doc_id bigint, text string, source string, holder string, share string")
    s = spark.createDataFrame([("law",), ("sport",), ("medicine",)], "subject string")
    lab = spark.createDataFrame([(1, "law"), (2, "sport"), (2, "sport")], "doc_id bigint, subject string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(d, lab, s).collect()}
    assert got == {(1, "law"), (2, "sport"), (3, "law"), (3, "sport"), (4, "law")}
    assert subjects.document_subjects(d.limit(0), lab.limit(0), s).count() == 0
    assert {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(d, lab.limit(0), s).collect()} == got
    a = subjects.held_out_accuracy(d, lab, s).first()
    assert 0 <= a["both"] <= min(a["labelled"], a["found"])
    assert tuple(subjects.held_out_accuracy(d.limit(0), lab.limit(0), s).first()) == (0, 0, 0, None, None)


def test_accuracies_are_learned():
    n = 4
    at = lambda lexicon, seeds, section, source: (((lexicon + 1) * n + seeds + 1) * n + section + 1) * n + source + 1
    counts = {at(0, 0, -1, 0): 300, at(1, 1, -1, 1): 300, at(2, 2, -1, 2): 300, at(-1, -1, -1, -1): 300, at(-1, -1, -1, 0): 5, at(0, -1, -1, 0): 40}
    _, good = posteriors(counts, 3, {(at(0, 0, -1, 0), 0): 50, (at(1, 1, -1, 1), 1): 50})
    # a lexicon that the labels speak against isn't trusted, whatever it is called
    post, bad = posteriors({**counts, at(0, 1, -1, 1): 900}, 3, {(at(0, 1, -1, 1), 1): 500})
    assert good["lexicon"][0] > 0.9 and bad["lexicon"][0] < 0.6 and post[at(0, 1, -1, 1)].argmax() == 1


def test_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"p{i}" for i in range(1, 10)}
