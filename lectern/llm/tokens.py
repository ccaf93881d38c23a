"""Token ids of whole corpora by a public byte-level BPE, with reuse of content-defined chunks.

A text is cut where a rolling hash over its last bytes hits a pattern, so equal stretches of different documents are cut alike.
A chunk that comes again in a task is encoded on its own, kept, and looked up from then on: what is kept are the ids of its inner
part, which no neighbour can change, and the bytes before and after that. A join, the last bytes of one chunk and the first of the next,
is repaired by encoding it again, widened until both ends of the window agree with the ids beside it: that is at exact splits, where
the pre-tokenizer ends a match whatever stands around. Between letters, figures, signs and white space of ASCII it always does
(but behind an apostrophe and behind white space), and what it matches on the right of such a place depends on nothing to its left,
so the encodings of both sides concatenate to that of the whole. A chunk without such a place is all join, and the window grows into the next one.
Joins are kept as well. Chunks that are new are encoded together with their new neighbours. Both caches are bounded and only save time.

Null and empty texts give an empty list; blank texts are encoded like any other. Strings that look like
special tokens are ordinary text. Repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import spread

#: Where the vocabulary files are; a parameter everywhere below.
VOCABULARY_DIR = "/opt/tokenizers"
#: Mean bytes between hash cuts.
MEAN_CHUNK = 128
#: Chunks kept by a task before its cache starts anew.
CACHE_CHUNKS = 300_000
#: Rows encoded at once; bounds a worker's memory.
SLICE_ROWS = 400
#: Pre-tokenizer of the 50k byte-level vocabularies, a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR):
    import tiktoken

    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Kinds of ASCII bytes for the pre-tokenizer: letters, figures, signs, white space; 0 for all others. An apostrophe is a sign of its own kind.
_LETTER, _FIGURE, _SIGN, _QUOTE, _WHITE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = [_WHITE if chr(b).isspace() and b not in range(28, 32) else _LETTER if chr(b).isalpha() else _FIGURE if chr(b).isdigit() else _QUOTE if b == 39 else _SIGN for b in range(128)]
#: Whether a place between two kinds is an exact split. Signs and apostrophes are one run.
_EXACT = np.zeros((6, 6), bool)
_EXACT[_LETTER, [_FIGURE, _SIGN, _QUOTE, _WHITE]] = _EXACT[_FIGURE, [_LETTER, _SIGN, _QUOTE, _WHITE]] = _EXACT[_SIGN, [_LETTER, _FIGURE, _WHITE]] = _EXACT[_QUOTE, [_FIGURE, _WHITE]] = True
_EXACT_FLAT = _EXACT.ravel()


def exact_splits(c: np.ndarray) -> np.ndarray:
    """Places within UTF-8 bytes at which encoding may be split, in order."""
    k = _KIND[c]
    return np.flatnonzero(_EXACT_FLAT[k[:-1] * np.uint8(6) + k[1:]]) + 1


def cuts(data: bytes | np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Ends of chunks within UTF-8 bytes: where the hash of the last eight bytes hits, at the next begin of a character. The end of data is not among them."""
    c = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    if len(c) < 2 * mean:
        return np.zeros(0, np.int64)
    # doubling: the hash of 2, 4, 8 bytes from two of half as many
    h = c.astype(np.uint32) * np.uint32(0x9E3779B1)
    for n, m in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        h[n:] = h[n:] * np.uint32(m) + h[:-n]
    h ^= h >> np.uint32(15)
    at = np.flatnonzero(h < np.uint32((1 << 32) // mean)) + 1
    at = at[at < len(c)]
    for _ in range(3):
        inner = (at < len(c)) & ((c[np.minimum(at, len(c) - 1)] & 0xC0) == 0x80)
        if not inner.any():
            break
        at = at + inner
    return np.unique(at[at < len(c)])


class ChunkEncoder:
    """encode() equals the plain encoding of the whole text, for every text."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR, mean: int = MEAN_CHUNK, keep: int = CACHE_CHUNKS):
        self.plain, self.mean, self.keep = encoder(name, directory), mean, keep
        #: chunk: b"" if met once, else (bytes before its inner part, ids of that, bytes after it), or None if it has no exact split
        self.known: dict[bytes, tuple | bytes | None] = {}
        self.joins: dict[bytes, bytes] = {}
        #: chunks met, chunks looked up, bytes of all chunks, bytes whose ids were looked up
        self.chunks = self.reused = self.bytes = self.saved = 0

    def _ids(self, part: bytes) -> bytes:
        return self.plain.encode_to_numpy(part.decode("utf-8"), disallowed_special=()).astype("<i4").tobytes()

    def _join(self, part: bytes) -> bytes:
        """Ids of what lies between two inner parts; short ones are kept."""
        if len(part) > 4 * self.mean:
            return self._ids(part)
        ids = self.joins.get(part)
        if ids is None:
            if len(self.joins) >= self.keep:
                self.joins.clear()
            ids = self.joins[part] = self._ids(part)
        return ids

    def _inner(self, chunk: bytes) -> tuple | None:
        at = exact_splits(np.frombuffer(chunk, np.uint8))
        if len(at) < 2:
            return None
        low, high = int(at[0]), int(at[-1])
        return chunk[:low], self._ids(chunk[low:high]), chunk[high:]

    def many(self, data: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids (as bytes) of the texts that lie in data between consecutive offsets, and where each text's ids end, in ids."""
        known, out, total = self.known, [], 0
        ends = np.union1d(cuts(data, self.mean), offsets[1:])
        doc_ends, counts, k, start = offsets[1:].tolist(), [], 0, int(offsets[0])
        # what isn't encoded yet: from `open_` on
        open_ = start
        for end in ends.tolist():
            if end > start:
                chunk = data[start:end]
                self.chunks += 1
                had = known.get(chunk, 0)
                if had == 0:
                    if len(known) >= self.keep:
                        known.clear()
                    known[chunk] = b""
                else:
                    if had == b"":
                        had = known[chunk] = self._inner(chunk)
                    else:
                        self.reused += had is not None
                    if had is not None:
                        before, ids, after = had
                        if open_ < start + len(before):
                            out.append(x := self._join(data[open_ : start + len(before)]))
                            total += len(x)
                        out.append(ids)
                        total += len(ids)
                        open_ = end - len(after)
                        self.saved += open_ - start - len(before)
                self.bytes += end - start
                start = end
            if k < len(doc_ends) and doc_ends[k] == end:
                if open_ < end:
                    out.append(x := self._join(data[open_:end]))
                    total += len(x)
                open_ = end
                while k < len(doc_ends) and doc_ends[k] == end:
                    counts.append(total // 4)
                    k += 1
        while k < len(doc_ends):
            counts.append(total // 4)
            k += 1
        return out, np.array(counts, np.int64)

    def encode(self, text: str | None) -> list[int]:
        data = (text or "").encode("utf-8")
        return np.frombuffer(b"".join(self.many(data, np.array([0, len(data)]))[0]), dtype="<i4").tolist()

    def column(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """many() over a column of strings; nulls count as empty."""
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())])
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = int(offsets[0])
        return self.many(data.to_pybytes()[first : int(offsets[-1])] if data else b"", offsets - first)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row, in one pass without a shuffle."""
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ChunkEncoder(tokenizer, directory)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                parts, ends = work.column(part.column(1))
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
                ids = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(ids: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR) -> DataFrame:
    """(key, text) of token ids (key, ids)."""
    src = ids.select(F.col(key).alias("_k"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = encoder(tokenizer, directory)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return src.mapInArrow(run, f"`{key}` {src.schema['_k'].dataType.simpleString()}, text string")


def chunk_reuse(documents: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR) -> DataFrame:
    """(chunks, reused, bytes, saved), one row: chunks met, chunks whose ids were looked up, bytes of all texts, bytes whose ids were looked up. It depends on how rows fall into tasks."""
    src = spread(documents.select(F.col(text).cast("string").alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ChunkEncoder(tokenizer, directory)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                work.column(batch.column(0).slice(at, SLICE_ROWS))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (work.chunks, work.reused, work.bytes, work.saved)], names=["chunks", "reused", "bytes", "saved"])

    each = src.mapInArrow(run, "chunks bigint, reused bigint, bytes bigint, saved bigint")
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns])


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR) -> DataFrame:
    """The columns `keys` and n_tokens of every row; ids stay in the worker."""
    src = spread(documents.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("_t")))
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ChunkEncoder(tokenizer, directory)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n = np.diff(work.column(part.column(len(keys)))[1], prepend=0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    return src.mapInArrow(run, schema + ", n_tokens bigint")
