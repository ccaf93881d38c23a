"""Cutting oversized texts and files into pieces at natural boundaries, with overlap, by ranges.

Texts up to the size of a range are cut where they are. Longer ones, and files, are read in ranges with halos on both sides, each
in a task of its own. A range begins at a cut that both neighbours find alike (the first natural boundary at or after the range's
edge, within the halo; else one before; else the edge), plans its own cuts from there, and tells how many pieces and how much length
it has. From this table of boundaries, one row for each range, prefix sums give the numbers of the pieces and, for files, code point
offsets. Pieces are written once with their range and emitted by offset.

Between cuts c and d lies the piece from c - overlap to d (from c for the first piece), so neighbours share exactly
`overlap` code points and a piece has at most `limit`. The last of the strongest boundaries in reach is taken: blank line,
line end, end of a sentence, end of a clause, white space, first in the last half of a step and then in its first half;
where there is none in the whole step the cut is made at the limit, but not before a combining mark or joiner.

Null and empty texts, and texts of at most `limit` code points, have no pieces. A null start counts as 0. Rows repeated
whole are cut once. Pieces together cover the text; with overlaps dropped they give it back. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.probing import open_file
from lectern.session import cut

#: Most code points of a piece, and code points that neighbours share.
LIMIT, OVERLAP = 850, 200
#: Code points (bytes for files) of a range; the halo is at least the limit.
RANGE = 1 << 16

_SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*\s")
_CLAUSE = re.compile(r"[,;:]\s")
_BLANK = re.compile(r"\s")
_TIED = "‍︎️"


def natural_cut(text: str, low: int, high: int) -> int | None:
    """The last of the strongest boundaries c, low < c <= high, after which a new piece begins; text[c - 1] ends the old one. None if there is none."""
    window = text[low:high]
    for mark in ("\n\n", "\n"):
        if (at := window.rfind(mark)) >= 0:
            return low + at + len(mark)
    for pattern in (_SENTENCE, _CLAUSE, _BLANK):
        last = None
        for last in pattern.finditer(window):
            pass
        if last:
            return low + last.end()
    return None


def hard_cut(text: str, low: int, high: int) -> int:
    """The cut at high, or before it, so that it parts no combining mark or joiner."""
    c = high
    while c > low + 1 and c < len(text) and (text[c] in _TIED or text[c - 1] == "‍" or unicodedata.combining(text[c])):
        c -= 1
    return c


def snapped(text: str, edge: int, reach: int, back: int) -> int:
    """The first natural boundary at or after edge, within reach; else the last of the strongest before it, within back; else edge."""
    window = text[edge : edge + reach]
    for mark in ("\n\n", "\n"):
        if (at := window.find(mark)) >= 0:
            return edge + at + len(mark)
    for pattern in (_SENTENCE, _BLANK):
        if m := pattern.search(window):
            return edge + m.end()
    return natural_cut(text, max(0, edge - back), edge) or edge


def plan(text: str, begin: int, end: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Cuts after begin, the last at end. Steps are at most limit - overlap; a natural cut is sought in the last half of a step first, then in the first half.

    No cut is made within the first overlap code points of the text, as neighbours share that many.
    """
    step, out, p = limit - overlap, [], begin
    while end - p > step:
        half = p + step // 2
        c = natural_cut(text, half, p + step) or natural_cut(text, max(p, overlap - 1), half) or hard_cut(text, half, p + step)
        out.append(c)
        p = c
    return [*out, end] if end > p else out


def range_cuts(x: str, edge: int, next_edge: int | None, first: bool, halo: int, back: int, limit: int, overlap: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(begin, end, [(from, to) of each piece]) of the range from edge to next_edge (None: to the end of x), in places of x, which holds the range and its halos."""
    begin = 0 if first else snapped(x, edge, halo, back)
    end = len(x) if next_edge is None else min(len(x), snapped(x, next_edge, halo, back))
    out, c = [], begin
    for d in plan(x, begin, end, limit, overlap) if end > begin else []:
        out.append((max(0, c - overlap) if out or not first else 0, d))
        c = d
    return begin, end, out


def _numbers(counts: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """counts, with the sum of each column over the ranges before it: {column: name of its sum}."""
    before = Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in sums.items()])


def oversized_pieces(chunks: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_id"), text: str = "text", start: str = "start", limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = RANGE) -> DataFrame:
    """(*keys, text_id, piece, text, start, end) of every text longer than limit; end is outside. text_id tells different texts of one key apart."""
    halo = 2 * limit
    # less than what the cut of the edge before may reach, so that cuts of edges keep their order
    back = max(0, min(limit - overlap, range_size - halo))
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {chunks.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)) + ", s bigint, h bigint"
    big = chunks.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.coalesce(F.col(start), F.lit(0)).cast("bigint").alias("s"), F.col(text).cast("string").alias("x")).filter(F.length("x") > limit)
    big = big.withColumn("h", F.xxhash64("x", "s")).dropDuplicates([*names, "s", "h"]).select(*names, "s", "h", "x")
    m = len(names) + 2

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, texts, low, high = [], [], [], [], []
            for i, x in enumerate(batch.column(m).to_pylist()):
                for k, (lo, hi) in enumerate(range_cuts(x, 0, None, True, halo, back, limit, overlap)[2]):
                    rows.append(i), number.append(k), texts.append(x[lo:hi]), low.append(lo), high.append(hi)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in batch.columns[:m]], pa.array(number, pa.int64()), pa.array(texts, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=[*names, "s", "h", "piece", "text", "lo", "hi"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(m).to_pylist()):
                for r, edge in enumerate(range(0, len(x), range_size)):
                    at = max(0, edge - halo)
                    # a row a batch, so that no more than a range and the text itself is held
                    yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:m]], pa.array([r], pa.int32()), pa.array([edge - at], pa.int32()), pa.array([at], pa.int64()), pa.array([edge + range_size >= len(x)]), pa.array([x[at : edge + range_size + 2 * halo]], pa.string())], names=[*names, "s", "h", "r", "edge", "at", "last", "x"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, texts, low, high = [], [], [], [], []
            for i, (r, edge, at, last, x) in enumerate(zip(*[c.to_pylist() for c in batch.columns[m:]])):
                found = range_cuts(x, edge, None if last else edge + range_size, r == 0, halo, back, limit, overlap)[2]
                for k, (lo, hi) in enumerate(found):
                    rows.append(i), number.append(k), texts.append(x[lo:hi]), low.append(at + lo), high.append(at + hi)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in batch.columns[: m + 1]], pa.array(number, pa.int64()), pa.array(texts, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=[*names, "s", "h", "r", "k", "text", "lo", "hi"])

    one = big.filter(F.length("x") <= range_size).mapInArrow(whole, f"{kinds}, piece bigint, text string, lo bigint, hi bigint")
    giant = big.filter(F.length("x") > range_size).mapInArrow(slices, f"{kinds}, r int, edge int, at bigint, last boolean, x string")
    # ranges of a giant text go to all tasks
    done = giant.repartition(*names, "s", "h", "r").mapInArrow(pieces, f"{kinds}, r int, k bigint, text string, lo bigint, hi bigint")
    # where there is none nothing is written
    done = cut(done)
    by = [*names, "s", "h"]
    first = _numbers(done.groupBy(*by, "r").agg(F.count("*").alias("n")), by, {"n": "first"})
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "r")]
    many = done.alias("a").join(first.alias("b"), same).select(*[f"a.{c}" for c in by], (F.col("k") + F.col("first")).alias("piece"), "text", "lo", "hi")
    every = one.unionByName(many)
    return every.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("h").alias("text_id"), "piece", "text", (F.col("s") + F.col("lo")).cast("int").alias("start"), (F.col("s") + F.col("hi")).cast("int").alias("end"))


def synced(data: bytes, p: int) -> int:
    """The first place at or after p where a decoder of UTF-8 stands between two characters, whatever the bytes are.

    That is before every byte that continues no character, and behind three that do, as no character has more. data must hold the three bytes before p, or begin with the file.
    """
    n, carry = len(data), 0
    for q in range(max(0, p - 3), p):
        carry = carry + 1 if data[q] & 0xC0 == 0x80 else 0
    while 0 < p < n and data[p] & 0xC0 == 0x80 and carry < 3:
        carry += 1
        p += 1
    return min(p, n)


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder but those whose names begin with a dot or underscore."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    out = [(x.getPath(), x.getLen()) for x in found if x.isFile()]
    return sorted((p.toString(), n) for p, n in out if not p.getName().startswith((".", "_")))


def file_pieces(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = 1 << 22) -> DataFrame:
    """(file, piece, text, start, end) of UTF-8 files, read by byte ranges; offsets are code points. path is a file or a folder of files, each cut on its own.

    No file is loaded as a whole: a task reads its range and its halos. An empty file has no pieces; a file of at most `limit` code points is one piece.
    Bytes that are no UTF-8 are replaced by U+FFFD, just as if the whole file were decoded at once.
    """
    halo = 8 * limit
    # a range of bytes has a quarter as many code points at least
    back = max(0, min(limit - overlap, range_size // 4 - limit))
    # one row for each range: 250 000 for a terabyte
    ranges = [(f, n, r) for f, n in files_under(spark, path) for r in range(-(-n // range_size))]
    source = spark.createDataFrame(ranges, "file string, total bigint, r int")
    source = source.repartition(max(1, min(len(ranges), 10_000)), "file", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, total, r in zip(*[c.to_pylist() for c in batch.columns]):
                at = max(0, r * range_size - halo)
                with open_file(f) as file:
                    file.seek(at)
                    data = file.read(min(total, (r + 1) * range_size + 2 * halo) - at)
                # a halo begins anywhere, and no character is longer than four bytes
                skip = synced(data, min(3, len(data))) if at else 0
                last = at + len(data) >= total
                x = data[skip : len(data) if last else synced(data, max(skip, len(data) - 4))].decode("utf-8", "replace")
                place = lambda p: len(data[skip : synced(data, p - at)].decode("utf-8", "replace"))  # noqa: E731 - code points before a byte
                ends = (r + 1) * range_size >= total
                begin, end, found = range_cuts(x, place(r * range_size), None if ends else place((r + 1) * range_size), r == 0, limit, back, limit, overlap)
                n = len(found)
                # offsets are told from the range's first cut; the prefix sum of lengths gives that cut's place
                cols = [[f] * n, [r] * n, list(range(n)), [x[lo:hi] for lo, hi in found], [lo - begin for lo, _ in found], [hi - begin for _, hi in found], [max(0, end - begin)] * n]
                if not n:
                    cols = [[f], [r], [None], [None], [None], [None], [max(0, end - begin)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "r", "k", "text", "lo", "hi", "length"])

    out = cut(source.mapInArrow(run, "file string, r int, k bigint, text string, lo bigint, hi bigint, length bigint"))
    lengths = out.groupBy("file", "r").agg(F.max("length").alias("length"), F.count("text").alias("n"))
    base = _numbers(lengths, ["file"], {"length": "base", "n": "first"})
    return out.filter("text is not null").join(base, ["file", "r"]).select("file", (F.col("first") + F.col("k")).alias("piece"), "text", (F.col("base") + F.col("lo")).alias("start"), (F.col("base") + F.col("hi")).alias("end"))
