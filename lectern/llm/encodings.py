"""Text that was decoded with the wrong character encoding: finding it and restoring it by round trips.

Every stretch of characters outside ASCII is encoded again under candidate legacy encodings and strictly decoded as
what it should have been, again and again for nested layers, as long as a garbling cost drops. Two kinds of round trip:
  - to UTF-8: a stretch that strictly decodes is itself the evidence, as ordinary text never does by chance;
  - between single-byte encodings, where everything decodes: here the cost of a word is its rarity, so the word that
    comes out must be frequent in the whole corpus (a table of document frequencies of words outside ASCII) and the one
    that is there must be rarer by far.
Marks of bytes that are lost (U+FFFD, C1 control characters, a capital that only a lead byte leaves inside a word) are found
too, but only what a round trip gives back is changed.

Null and empty texts are no case. Correct text in rare scripts, symbols and figures stay as they are: there a round trip
does not decode, or gives no known word. Repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, lookup, spread

#: Encodings by which UTF-8 was read, and (read as, really) for single-byte pairs.
READ_AS = ("cp1252", "latin-1", "iso8859-2", "cp1250", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1251", "cp1254", "cp1257", "koi8-r", "cp1253", "cp866")
SINGLE = (("cp1251", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("koi8-r", "cp1252"), ("cp1253", "cp1252"), ("iso8859-5", "cp1252"), ("cp1257", "cp1252"), ("cp866", "cp1252"))
#: Documents that must have a word for it to count as known; times more frequent than what is there it must be.
LEAST_DOCS, TIMES = 3, 10
#: Documents, and share of all, from which on a capital within a word counts as the way it is written.
RARE_DOCS, RARE_SHARE = 60, 6e-4
#: Garbled words that are sent to the workers as a whole.
GARBLED_WORDS = 500_000
#: Words kept by a worker with what was decided on them.
CACHE_WORDS = 300_000

_RUN = re.compile(r"[^\x00-\x7f]+")
_BY_CHANCE = re.compile("[^\x00-\x7f][\u2010-\u2027\u2030-\u205e\xab\xbb\xb0\xb7]+(?![^\\W\\d_])")
_LOST_BYTE = re.compile("[\ufffd\x80-\x9f]")
_OUTER = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum()) + "“”‘’«»¿¡–—…•"
_COMMON = set("áéíóúüñàèìòùâêîôûãõäëïöçœæøåßÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÃÕÄËÏÖÇŒÆØÅ¿¡ºª“”‘’–—•…€™®©°±µ½¼¾²³¹×·«»§¶†£≤≥≈αβ")


_ASCII_OUTER = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum())


def key_of(word: str) -> str:
    """The form under which a word is counted: without outer marks, or with those outside ASCII where nothing else is."""
    core = word.strip(_OUTER)
    return core if core and not core.isascii() else word.strip(_ASCII_OUTER) or word


def _sloppy(codec: str) -> dict[str, int]:
    """Character to byte for all bytes; one that the encoding leaves open stands for the control character of its number."""
    out = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


_BYTES = {c: _sloppy(c) for c in {*READ_AS, *(a for a, _ in SINGLE)}}


def _encode(s: str, codec: str) -> bytes | None:
    table, out = _BYTES[codec], bytearray()
    for c in s:
        if c < "\x80":
            out.append(ord(c))
        elif (b := table.get(c)) is None:
            return None
        else:
            out.append(b)
    return bytes(out)


def cost(s: str) -> int:
    """The garbling cost of a stretch: what its characters outside ASCII weigh."""
    total = 0
    for c in s:
        if c < "\x80":
            continue
        if c == "�" or c <= "\x9f":
            total += 6
        elif c in _COMMON:
            total += 2
        else:
            kind = unicodedata.category(c)
            total += 3 if kind[0] in "LN" else 4
    return total


def _plausible(s: str) -> bool:
    """Whether a reading holds only characters that text of these collections could have; a bare chance decodes into odd scripts."""
    odd = 0
    for c in s:
        n = ord(c)
        if n < 0x530 or 0x2000 <= n < 0x2C00 or 0x3000 <= n < 0xA000 or 0xAC00 <= n < 0xD7B0 or n >= 0xFB00:
            continue
        if not 0x590 <= n < 0x700:
            return False
        odd += 1
    return odd != 1


def _to_utf8(run: str) -> str | None:
    """The best strict UTF-8 reading of a run of characters outside ASCII, one layer."""
    best, least = None, cost(run)
    for codec in READ_AS:
        data = _encode(run, codec)
        if data is None:
            continue
        try:
            got = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if (c := cost(got)) < least and _plausible(got):
            best, least = got, c
    return best


def unnest(run: str) -> str:
    """A run with its layers of UTF-8 undone; parts of it where the whole doesn't decode."""
    # each layer costs less than the one before, so this ends
    while True:
        got = _to_utf8(run)
        if got is None and len(run) > 2:
            # garbled and correct characters side by side: the longest parts that decode; of longer ones the pieces decode as well
            out, i = [], 0
            while i < len(run):
                for j in range(min(len(run), i + 12), i + 1, -1):
                    if (part := _to_utf8(run[i:j])) is not None:
                        out.append(part)
                        i = j
                        break
                else:
                    out.append(run[i])
                    i += 1
            got = "".join(out)
            got = got if got != run else None
        if got is None:
            break
        run = got
    return run


def _lost(word: str) -> bool:
    """Marks of bytes that can't be told any more."""
    for i, c in enumerate(word):
        if c == "�" or "\x80" <= c <= "\x9f":
            return True
        if c > "\x7f" and i and c.isupper() and word[i - 1].islower() and (i + 1 >= len(word) or not word[i + 1].isupper()):
            return True
    return False


def odd(word: str) -> int:
    """Characters outside ASCII that sit ill in a word: capitals after small letters, signs between letters, other scripts beside Latin."""
    n = 0
    for i, c in enumerate(word):
        if c < "\x80":
            continue
        before, after = word[i - 1] if i else " ", word[i + 1] if i + 1 < len(word) else " "
        if c.isalpha():
            foreign = ord(c) > 0x24F and c not in "αβµ"
            n += c.isupper() and before.islower() or foreign and (before < "\x80" and before.isalpha() or after < "\x80" and after.isalpha())
        else:
            n += before.isalpha() and after.isalpha() and c not in "’·"
    return n


def counted(word: str) -> str:
    """key_of() a word, by its digest where it is long."""
    key = key_of(word)
    return key if len(key) <= 60 else "#é" + hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _unnested(word: str) -> str:
    return _RUN.sub(lambda m: unnest(m.group()), word)


def _with_lost_hyphens(word: str) -> str:
    """A lead byte whose second, read as a soft hyphen, was cleaned away."""
    return _unnested(re.sub("Ã(?![\x80-\xbf])", "Ã\xad", word)) if "Ã" in word else word


def _singles(word: str) -> list[tuple[str, tuple[str, str]]]:
    """(reading, encoding pair) of the single-byte readings of a word that look no worse than it does."""
    core, out = key_of(word), []
    plain = sum(c.isalpha() and c < "\x80" for c in core)
    # a word needs plain letters beside; lone characters are told only from ones that text doesn't use
    if not (plain >= 2 or len(core) > 1 and plain or cost(core) > 2 * len(core)):
        return out
    for read, real in SINGLE:
        data = _encode(word, read)
        if data is None:
            continue
        try:
            got = data.decode(real)
        except UnicodeDecodeError:
            continue
        if got != word and cost(got) <= cost(word) and odd(got) <= odd(word) and not key_of(got).isascii():
            out.append((got, (read, real)))
    return out


def options(word: str) -> tuple[set[str], set[str]] | None:
    """(keys, shapes) whose frequencies tell whether a word is garbled and what it was; None for a word that is fine whatever they are."""
    got, again, singles = _unnested(word), _with_lost_hyphens(word), _singles(word)
    if got == word == again and not singles and not _LOST_BYTE.search(word) and not _lost(word):
        return None
    readings = [word, got, again, *[x for x, _ in singles]]
    return {counted(x) for x in readings}, {x.strip(_OUTER) for x in readings if "�" in x}


class Repairer:
    """Decides on words by the documents that have them. known: documents of each word outside ASCII, by counted(); shapes: the word of a shape, where it dwarfs all others.

    rare: documents from which on a capital within a word counts as the way it is written.
    """

    def __init__(self, known: dict[str, int], least: int = LEAST_DOCS, shapes: dict[str, str] | None = None, rare: int = RARE_DOCS):
        self.known, self.least, self.rare = known, least, rare
        self.met: dict[str, tuple[bool, str]] = {}
        self.by: dict[str, tuple[str, str]] = {}
        self.shapes = shapes_of(known.items(), least) if shapes is None else shapes

    def _times(self, word: str) -> int:
        return self.known.get(counted(word), 0)

    def _single(self, word: str) -> str | None:
        best, times = None, max(self.least, TIMES * max(1, self._times(word))) - 1
        for got, pair in _singles(word):
            if (n := self._times(got)) > times:
                best, times = got, n
                self.by[word] = pair
        return best

    def decide(self, word: str) -> tuple[bool, str]:
        got = _unnested(word)
        # a letter and the mark behind its word may decode by chance: if more documents have the word as it is, it stays
        if got != word and _BY_CHANCE.search(word) and not key_of(got).isascii() and self._times(word) > self._times(got):
            got = word
        if got == word and (again := _with_lost_hyphens(word)) != word and self._times(again) > max(self.least, TIMES * self._times(word)) - 1:
            got = again
        if got == word or _lost(got):
            got = self._single(got) or got
        if "�" in got and (inner := got.strip(_OUTER)) in self.shapes:
            got = got.replace(inner, self.shapes[inner], 1)
        # lost bytes are garbled however many documents have the word
        return got != word or _LOST_BYTE.search(word) is not None or _lost(word) and self._times(word) < self.rare, got

    def word(self, word: str) -> tuple[bool, str]:
        """(garbled, restored)"""
        found = self.met.get(word)
        if found is None:
            found = self.decide(word)
            if len(self.met) >= CACHE_WORDS:
                self.met.clear(), self.by.clear()
            self.met[word] = found
        return found

    def garbled(self, text: str) -> bool:
        return not text.isascii() and any(self.word(w)[0] for w in words(text))

    def restore(self, text: str) -> str:
        """The text with its words restored. Words that no frequency tells follow the pair of encodings that most of the document's words speak for, if they sit ill as they are and better then."""
        parts = re.split(r"([ \n\t\r]+)", text)
        votes = Counter(self.by[w] for w in set(parts) if not w.isascii() and self.word(w)[0] and w in self.by)
        pair = votes.most_common(1)[0][0] if votes else None

        def one(w: str) -> str:
            if w.isascii():
                return w
            got = self.word(w)[1]
            if got == w and pair and odd(w) and (data := _encode(w, pair[0])) is not None:
                try:
                    again = data.decode(pair[1])
                except UnicodeDecodeError:
                    return w
                return again if odd(again) < odd(w) else w
            return got

        return "".join(map(one, parts))


def words(text: str) -> set[str]:
    """Words with a character outside ASCII; only ASCII white space parts them, as other spaces may be garbled bytes."""
    return {w for w in re.split(r"[ \n\t\r]+", text) if not w.isascii()}


def shapes_of(words: Iterable[tuple[str, int]], least: int = LEAST_DOCS) -> dict[str, str]:
    """The word of each shape, its characters outside ASCII as U+FFFD, where one has `least` documents and dwarfs all others."""
    by: dict[str, list[tuple[int, str]]] = {}
    for w, n in words:
        if "�" not in w and any(c.isalpha() and c < "\x80" for c in w):
            by.setdefault(_RUN.sub(lambda m: "�" * len(m.group()), w), []).append((n, w))
    best = {shape: sorted(found, reverse=True)[:2] for shape, found in by.items()}
    return {shape: f[0][1] for shape, f in best.items() if f[0][0] >= least and (len(f) == 1 or f[0][0] >= TIMES * f[1][0])}


class Told(Repairer):
    """A repairer that is told what was decided on each garbled word: {word: (restored, read as, really)}."""

    def __init__(self, table: dict[str, tuple[str, str | None, str | None]]):
        self.met = {w: (True, x[0]) for w, x in table.items()}
        self.by = {w: (x[1], x[2]) for w, x in table.items() if x[1]}

    def word(self, word: str) -> tuple[bool, str]:
        return self.met.get(word) or (False, word)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, docs): documents that have a word, '' for all of them; and (word, null): words that frequencies are to tell of."""
    counts: Counter = Counter()
    suspects: set[str] = set()
    met: dict[str, str] = {}

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([*counts, *suspects], pa.string()), pa.array([*counts.values(), *[None] * len(suspects)], pa.int64())], names=["word", "docs"])
        counts.clear(), suspects.clear()
        return out

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if not t:
                continue
            counts[""] += 1
            if t.isascii():
                continue
            keys = set()
            for w in words(t):
                key = met.get(w)
                if key is None:
                    if len(met) >= CACHE_WORDS:
                        met.clear()
                    key = met[w] = counted(w)
                    if options(w) is not None:
                        suspects.add(w)
                if not key.isascii():
                    keys.add(key)
            counts.update(keys)
        if len(counts) + len(suspects) > 200_000:
            yield told()
    yield told()


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, need, shape): what is to be looked up for a suspect."""
    for batch in batches:
        rows = [(w, x, kind) for w in batch.column(0).to_pylist() for kind, some in enumerate(options(w)) for x in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([bool(r[2]) for r in rows], pa.bool_())], names=["word", "need", "shape"])


def garbled_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, restored, read, real): the garbled words of a corpus, each once, with what they were as far as that can be told, and the pair of single-byte encodings that tells it.

    Frequencies count all documents and all words; they are joined with the few words that they are needed for, and decisions are made word by
    word, so no table of words is held as a whole anywhere.
    """
    src = spread(documents.select(F.col(text).cast("string").alias("_t")))
    first = cut(src.mapInArrow(_first_pass, "word string, docs bigint"))
    counts = first.filter("docs is not null").groupBy("word").agg(F.sum("docs").alias("docs"))
    n = counts.filter("word = ''").select("docs").first()
    rare = max(RARE_DOCS, int(RARE_SHARE * (n[0] if n else 0)))
    needs = cut(first.filter("docs is null").select("word").distinct().mapInArrow(_needs, "word string, need string, shape boolean"))
    counts = counts.filter("word <> ''").select(F.col("word").alias("need"), "docs")
    known = needs.filter("not shape").join(counts, "need", "left").select("word", "need", F.coalesce("docs", F.lit(0)).alias("docs"), F.lit(None).cast("string").alias("of"))
    # the two most frequent words of each shape that is asked for tell whether one dwarfs the others
    asked = needs.filter("shape").select("need").distinct()
    shaped = counts.filter(~F.col("need").startswith("#é") & ~F.contains("need", F.lit("�")) & F.col("need").rlike("[A-Za-z]")).withColumn("of", F.regexp_replace("need", r"[^\x00-\x7F]", "�"))
    two = shaped.join(asked.toDF("of"), "of", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("docs"), F.desc("need")))).filter("_r <= 2")
    by_shape = needs.filter("shape").select("word", F.col("need").alias("of")).join(two.select("of", "need", "docs"), "of").select("word", "need", "docs", "of")
    told = known.unionByName(by_shape).groupBy("word").agg(F.collect_list(F.struct("need", "docs", "of")).alias("known"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = Repairer({k["need"]: k["docs"] for k in known if k["of"] is None}, LEAST_DOCS, shapes_of([(k["need"], k["docs"]) for k in known if k["of"] is not None]), rare)
                bad, restored = one.decide(w)
                if bad:
                    out.append((w, restored, *one.by.get(w, (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["word", "restored", "read", "real"])

    return cut(told.mapInArrow(decide, "word string, restored string, read string, real string"))


def repaired(documents: DataFrame, key: str = "doc_id", text: str = "text", only_found: bool = False, table: DataFrame | None = None, bound: int = GARBLED_WORDS) -> DataFrame:
    """(key, garbled, text): every document with its text restored as far as it can be; only_found leaves out the rest.

    table: garbled_words() of a corpus, of the documents themselves by default. At most `bound` of them, counted first, go to the workers;
    of more each document is joined with its own.
    """
    table = garbled_words(documents, text) if table is None else table
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")))
    schema = f"`{key}` {src.schema['_k'].dataType.simpleString()}, garbled boolean, text string"

    def run(own):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, flags, texts = [], [], []
                for i, (k, t, work) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own(batch))):
                    bad = bool(t) and work.garbled(t)
                    if bad or not only_found:
                        keys.append(i), flags.append(bad), texts.append(work.restore(t) if bad else t)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(flags, pa.bool_()), pa.array(texts, pa.string())], names=[key, "garbled", "text"])

        return rows

    few = table.limit(bound + 1).collect()
    if len(few) <= bound:
        shared = documents.sparkSession.sparkContext.broadcast({r["word"]: (r["restored"], r["read"], r["real"]) for r in few})
        met: list[Told] = []

        def same(batch: pa.RecordBatch):
            if not met:
                met.append(Told(shared.value))
            return met * batch.num_rows

        return src.mapInArrow(run(same), schema)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, w) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and not t.isascii() for w in words(t) if options(w) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["_h", "word"])

    # equal texts are repaired alike, so a text's hash stands for it
    texts = src.withColumn("_h", F.xxhash64("_t"))
    met = lookup(texts.select("_h", "_t").mapInArrow(suspects, "_h bigint, word string").distinct(), table, "word", bound=bound)
    own = met.groupBy("_h").agg(F.collect_list(F.struct("word", "restored", "read", "real")).alias("_w"))
    each = lambda batch: (Told({x["word"]: (x["restored"], x["read"], x["real"]) for x in w or ()}) for w in batch.column(2).to_pylist())
    return texts.join(own, "_h", "left").select("_k", "_t", "_w").mapInArrow(run(each), schema)


#: Ways in which clean texts are spoiled to measure how they are restored: UTF-8 read as an encoding, once or twice, and one single-byte encoding read as another.
SPOILED = (("cp1252", 1), ("latin-1", 1), ("mac_roman", 1), ("cp850", 1), ("cp1252", 2), ("latin-1", 2), ("cp1251", 0), ("cp850", 0), ("mac_roman", 0))


def spoiled(text: str, codec: str, layers: int) -> str:
    """A text as it would have been read: its UTF-8 bytes by a codec, `layers` times; with no layer its bytes in cp1252. What has no byte there stays."""
    if not layers:
        return "".join(c if c < "\x80" or (b := c.encode("cp1252", "ignore")) == b"" else b.decode(codec, "replace") for c in text)
    table = {b: c for c, b in _BYTES[codec].items()}
    for _ in range(layers):
        text = "".join(chr(b) if b < 128 else table[b] for b in text.encode("utf-8"))
    return text


def repair_accuracy(documents: DataFrame, text: str = "text") -> DataFrame:
    """(way, documents, found, restored): clean texts with characters outside ASCII, of which every twentieth by its hash is spoiled, each way as often, and repaired by what is counted in all of them; restored are those that are as they were."""
    src = spread(documents.select(F.col(text).cast("string").alias("_t")).filter("_t is not null").distinct())
    clean = repaired(src.select(F.xxhash64("_t").alias("k"), F.col("_t").alias("text")), "k").filter("not garbled").select("k", "text")

    def spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, out = [], []
            for k, t in zip(*[c.to_pylist() for c in batch.columns]):
                way = SPOILED[k // 20 % len(SPOILED)] if k % 20 == 0 and not t.isascii() else None
                bad = spoiled(t, *way) if way else t
                ways.append(f"{way[0]}, {way[1]} layers" if bad != t else None), out.append(bad)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.string()), pa.array(out, pa.string())], names=["k", "text", "way", "bad"])

    both = cut(clean.mapInArrow(spoil, "k bigint, text string, way string, bad string"))
    got = repaired(both.select("k", F.col("bad").alias("text")), "k").select("k", "garbled", F.col("text").alias("got"))
    told = both.filter("way is not null").select("k", "way", "text").join(got, "k")
    return told.groupBy("way").agg(F.count("*").alias("documents"), F.sum(F.col("garbled").cast("int")).alias("found"), F.sum((F.col("got") == F.col("text")).cast("int")).alias("restored"))
