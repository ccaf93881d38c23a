"""Hamming joins of fingerprints through a Gray-ordered hierarchical index, spread over the cluster.

Each text has a long fingerprint, its minimum hashes side by side, and a short one of 64 of their bits. An upper node of the index
holds the texts whose long fingerprints share a masked pattern: each of KEYS masks picks the bits of ROWS minimum hashes. (Such
masks part texts far better than masks of single bits can at these similarities; it's what banded minimum hashing does too.)
Below it, short fingerprints lie in the order of their Gray ranks, where neighbours differ in few bits; every inner node
holds the bits that all of its fingerprints share (a mask and a value). Two nodes whose shared bits already differ
in more places than the threshold are pruned with all that is below them; leaves are compared bit by bit.

The keys are written sorted, by bucket, and read by tasks that take shares of the files. An upper node of more than HOT fingerprints, and
one that may go on in the next share, is cut into blocks of BLOCK, each with its own mask and value. Blocks meet by
their masks and values alone, and those that pass the same pruning are compared, each pair in a task of its own
choosing; so no task holds an unbounded group. Equal sets meet once: copies are folded into their first row by each task
before the shuffle, and by node below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import probing, shingles
from lectern.session import cut, scratch, spread

#: Fingerprints compared directly, in a block, and kept in one task before a group is cut into blocks.
LEAF, BLOCK, HOT = 32, 512, 4096
#: Most differing bits of 64. At a similarity of 0.7, 9.6 differ on average with a deviation of 2.9.
MOST_BITS = 24
#: Minimum hashes in a key, and keys of a text. A pair of similarity s shares a key with 1 - (1 - s^4)^20: 0.996 at 0.7, 0.9995 at 0.75.
ROWS, KEYS = 4, 20
#: Nodes by which a task folds copies before it begins anew, and shingles that an exact join counts as frequent, at most.
FOLDED, FREQUENT = 2_000_000, 2_000_000

_KEY_SCHEMA = "key bigint, rank bigint, node bigint"
_FOUND_SCHEMA = "a bigint, b bigint, key bigint, block bigint, nodes array<bigint>, ranks array<bigint>, mask bigint, value bigint"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def band_keys(minima: np.ndarray, rows: int, keys: int) -> np.ndarray:
    """(keys, n) index keys of 44 bits, each from its own `rows` minima."""
    out = np.empty((keys, minima.shape[1]), np.uint64)
    for k in range(keys):
        h = np.full(minima.shape[1], k + 1, np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            h = shingles.mix(h ^ minima[j].astype(np.uint64))
        out[k] = h >> np.uint64(20)
    return out


def ranks(minima: np.ndarray) -> np.ndarray:
    """Gray ranks of the fingerprints, in the order of signed numbers."""
    return shingles.gray_rank(shingles.fingerprint(minima)) ^ np.uint64(1 << 63)


def signed_rows(texts: DataFrame, carry: list[str], text: str = "text", width: int = 3, rows: int = ROWS, keys: int = KEYS, apart: str | None = None) -> DataFrame:
    """(*carry, text, node, rank, keys ARRAY<BIGINT>) of every row with a shingle; the keys of a node are null but at its first row in a task, or its first with each value of `apart` (one of carry)."""
    src = spread(texts.select(*carry, F.col(text).cast("string").alias("_t")))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS):
                part = batch.slice(at, shingles.SLICE_ROWS)
                row, node, minima = shingles.signatures(*shingles.shingle_sets(part.column(len(carry)).to_pylist(), width), rows * keys)
                if not len(row):
                    continue
                take = pa.array(row)
                each = node.tolist() if apart is None else zip(part.column(carry.index(apart)).take(take).to_pylist(), node.tolist())
                old = np.array([x in met or met.add(x) is not None for x in each], bool)
                if len(met) > FOLDED:
                    met.clear()
                values = pa.array(_signed(np.ascontiguousarray(band_keys(minima, rows, keys).T).ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * keys), values)
                lists = lists.filter(pa.array(~old)).take(pa.array(np.where(old, 0, np.cumsum(~old) - 1), mask=old))
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in part.columns], pa.array(_signed(node)), pa.array(_signed(ranks(minima))), lists], names=[*carry, "text", "node", "rank", "keys"])

    return src.mapInArrow(run, f"{kinds}, text string, node bigint, rank bigint, keys array<bigint>")


def index_keys(texts: DataFrame, text: str = "text", width: int = 3, rows: int = ROWS, keys: int = KEYS) -> DataFrame:
    """(key, rank, node) of every text with a shingle; equal sets of shingles once in a task."""
    src = spread(texts.select(F.col(text).cast("string").alias("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS):
                part = batch.slice(at, shingles.SLICE_ROWS)
                _, node, minima = shingles.signatures(*shingles.shingle_sets(part.column(0).to_pylist(), width), rows * keys)
                new = np.array([x not in met and met.add(x) is None for x in node.tolist()], bool)
                if not new.any():
                    continue
                node, minima = node[new], minima[:, new]
                if len(met) > FOLDED:
                    met.clear()
                out = band_keys(minima, rows, keys)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(out.ravel())), pa.array(_signed(np.tile(ranks(minima), keys))), pa.array(_signed(np.tile(node, keys)))], names=["key", "rank", "node"])

    return src.mapInArrow(run, _KEY_SCHEMA)


def prefix_keys(texts: DataFrame, text: str = "text", width: int = 3, least: float = 0.7) -> DataFrame:
    """(key, rank, node) for an exact join: the keys of a text are the hashes of its prefix, the |x| - ceil(least |x|) + 1 first shingles in an order that all texts share.

    Two texts of similarity `least` or more have a shingle of their prefixes in common, whatever the order; here rare shingles come first, so
    that keys part texts well. Of a count over all texts as many of the most frequent as may be broadcast are told apart; all others count as equally rare.
    """
    src = spread(texts.select(F.col(text).cast("string").alias("_t")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS):
                _, h = shingles.shingle_sets(batch.column(0).slice(at, shingles.SLICE_ROWS).to_pylist(), width)
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = cut(src.mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2"))
    floor = 2
    while counts.filter(F.col("n") > floor).count() > FREQUENT:
        floor *= 4
    often = counts.filter(F.col("n") > floor).toPandas()
    often = often.sort_values("h")
    shared = texts.sparkSession.sparkContext.broadcast((often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)))
    parts = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, shingles.SLICE_ROWS):
                row, h = shingles.shingle_sets(batch.column(0).slice(at, shingles.SLICE_ROWS).to_pylist(), width)
                at_row, node, minima = shingles.signatures(row, h, 64)
                if not len(node):
                    continue
                often = np.zeros(len(h), np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    often = np.where(frequent[place] == h, times[place], 0)
                order = np.lexsort((h, often, row))
                row, h = row[order], h[order]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                size = np.diff(np.append(starts, len(row)))
                # whole numbers, so that a tie at the threshold is exact
                prefix = size + (-(round(least * parts) * size) // parts) + 1
                keep = np.arange(len(row)) - np.repeat(starts, size) < np.repeat(prefix, size)
                which = np.searchsorted(at_row, row[keep])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[keep])), pa.array(_signed(ranks(minima)[which])), pa.array(_signed(node[which]))], names=["key", "rank", "node"])

    return src.mapInArrow(run, _KEY_SCHEMA)


def _shared(codes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Mask of the bits that all codes share, and their values."""
    mask = ~np.bitwise_or.reduce(codes ^ codes[0])
    return mask, codes[0] & mask


class Tree:
    """The index over one group of codes in Gray order."""

    def __init__(self, codes: np.ndarray, lo: int = 0):
        self.lo, self.hi = lo, lo + len(codes)
        self.mask, self.value = _shared(codes)
        half = len(codes) // 2
        self.parts = [] if len(codes) <= LEAF else [Tree(codes[:half], lo), Tree(codes[half:], lo + half)]


def tree_pairs(x: Tree, y: Tree, cx: np.ndarray, cy: np.ndarray, same: bool, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `most` bits between two trees, or within one (same: i < j)."""
    out, todo = [], [(x, y)]
    while todo:
        p, q = todo.pop()
        if int(np.bitwise_count(p.mask & q.mask & (p.value ^ q.value))) > most:
            continue
        if not p.parts and not q.parts:
            near = np.bitwise_count(cx[p.lo : p.hi, None] ^ cy[None, q.lo : q.hi]) <= most
            i, j = np.nonzero(np.triu(near, 1) if same and p is q else near)
            if len(i):
                out.append((i + p.lo, j + q.lo))
        elif same and p is q:
            l, r = p.parts
            todo += [(l, l), (l, r), (r, r)]
        elif p.parts and (not q.parts or p.hi - p.lo >= q.hi - q.lo):
            todo += [(c, q) for c in p.parts]
        else:
            todo += [(p, c) for c in q.parts]
    return out


def _codes(rank: np.ndarray) -> np.ndarray:
    return shingles.gray_code(rank.view(np.uint64) ^ np.uint64(1 << 63))


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    a, b = a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


def _group_pairs(key: np.ndarray, rank: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs of whole groups, sorted by key and rank, each of at most HOT rows."""
    got = []
    code = _codes(rank)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(first, len(key)))
    for f, n in zip(first[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        c = code[f : f + n]
        t = Tree(c)
        got += [(node[f + i], node[f + j]) for i, j in tree_pairs(t, t, c, c, True, most)]
    small = np.repeat((sizes > 1) & (sizes <= LEAF), sizes)
    key, code, node = key[small], code[small], node[small]
    for d in range(1, LEAF):
        same = key[d:] == key[:-d] if d < len(key) else np.zeros(0, bool)
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(code[at] ^ code[at + d]) <= most]
        if len(at):
            got.append((node[at], node[at + d]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _ordered(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if len(a):
        both = np.unique(np.stack([a, b], 1), axis=0)
        a, b = both[:, 0], both[:, 1]
    n = len(a)
    lists = pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), lists, lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        names=["a", "b", "key", "block", "nodes", "ranks", "mask", "value"],
    )


_BLOCK_KINDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("nodes", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("mask", pa.int64()), ("value", pa.int64())])


def _blocks_batch(key: int, number: int, rank: np.ndarray, node: np.ndarray) -> tuple[pa.RecordBatch, int]:
    rows = []
    for at in range(0, len(rank), BLOCK):
        r, n = rank[at : at + BLOCK], node[at : at + BLOCK]
        both = np.array(_shared(_codes(r)), np.uint64).view(np.int64).tolist()
        rows.append({"a": None, "b": None, "key": key, "block": number, "nodes": n.tolist(), "ranks": r.tolist(), "mask": both[0], "value": both[1]})
        number += 1
    return pa.RecordBatch.from_pylist(rows, schema=_BLOCK_KINDS), number


class Scan:
    """Pairs and blocks of a stream of (key, rank, node), sorted in this order.

    split: the stream is a share of a larger one, so its first and last group may go on elsewhere and come out as blocks.
    first: number of the first block; those of other shares must be apart.
    """

    def __init__(self, most: int, hot: int = HOT, split: bool = False, first: int = 0):
        self.most, self.hot, self.split, self.number = most, hot, split, first
        #: the key whose group comes out as blocks, and the first key of the stream
        self.open_key = self.first_key = None
        none = np.zeros(0, np.int64)
        self.carry = (none, none, none)

    def _as_blocks(self, key: int, rank: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        out, self.number = _blocks_batch(key, self.number, rank, node)
        return out

    def add(self, key: np.ndarray, rank: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        key, rank, node = (np.concatenate(x) for x in zip(self.carry, (key, rank, node)))
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, rank, node = key[fresh], rank[fresh], node[fresh]
        if self.first_key is None:
            self.first_key = int(key[0])
            if self.split:
                self.open_key = self.first_key
        s = int(np.searchsorted(key, key[-1], "left"))
        if s:
            starts = np.flatnonzero(np.concatenate(([True], key[1:s] != key[: s - 1])))
            ends = np.append(starts[1:], s)
            apart = ends - starts > self.hot
            if self.open_key is not None:
                apart[0] = True
            keep = np.ones(s, bool)
            for f, t in zip(starts[apart].tolist(), ends[apart].tolist()):
                keep[f:t] = False
                yield self._as_blocks(int(key[f]), rank[f:t], node[f:t])
            self.open_key = None
            if keep.any():
                a, b = _group_pairs(key[:s][keep], rank[:s][keep], node[:s][keep], self.most)
                if len(a):
                    yield _pairs_batch(a, b)
        key, rank, node = key[s:], rank[s:], node[s:]
        if len(key) > self.hot or self.open_key is not None:
            self.open_key = int(key[0])
            # the last row stays, so that its node is known when it comes again
            whole = (len(key) - 1) // BLOCK * BLOCK
            if whole:
                yield self._as_blocks(self.open_key, rank[:whole], node[:whole])
                key, rank, node = key[whole:], rank[whole:], node[whole:]
        self.carry = (key, rank, node)

    def end(self) -> Iterator[pa.RecordBatch]:
        key, rank, node = self.carry
        if not len(key):
            return
        if self.split or self.open_key is not None:
            yield self._as_blocks(int(key[0]), rank, node)
        else:
            a, b = _group_pairs(key, rank, node, self.most)
            if len(a):
                yield _pairs_batch(a, b)


def _block_pairs(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["block"] == r["block_2"]
                nx, ny = np.array(r["nodes"], np.int64), np.array(r["nodes_2"], np.int64)
                cx, cy = _codes(np.array(r["ranks"], np.int64)), _codes(np.array(r["ranks_2"], np.int64))
                x = Tree(cx)
                got = tree_pairs(x, x if same else Tree(cy), cx, cy, same, most)
                if got:
                    a, b = _ordered(np.concatenate([nx[i] for i, _ in got]), np.concatenate([ny[j] for _, j in got]))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def pairs_of_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """(a, b) of blocks (key, block, nodes, ranks, mask, value): blocks of one key meet by mask and value, and only those that may hold a pair are compared."""
    few = blocks.select("key", "block", "mask", "value")
    met = few.join(few.toDF("key", "block_2", "mask_2", "value_2"), "key").filter("block <= block_2").filter(F.expr(f"bit_count((mask & mask_2) & (value ^ value_2)) <= {int(most)}")).select("key", "block", "block_2")
    one = met.join(blocks.select("key", "block", "nodes", "ranks"), ["key", "block"])
    two = one.join(blocks.select("key", F.col("block").alias("block_2"), F.col("nodes").alias("nodes_2"), F.col("ranks").alias("ranks_2")), ["key", "block_2"])
    return two.select("block", "block_2", "nodes", "nodes_2", "ranks", "ranks_2").mapInArrow(_block_pairs(most), "a bigint, b bigint")


def candidate_pairs(keys: DataFrame, most: int = MOST_BITS, hot: int = HOT, share: int = probing.SHARE) -> DataFrame:
    """Distinct (a, b), a < b: pairs of nodes that share an index key and differ in at most `most` bits.

    keys: (key, rank, node). An empty table gives none.
    """
    spark = keys.sparkSession
    path, buckets = scratch(spark, "keys"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    probing.write_part(keys.select("key", "rank", "node"), path, "key", buckets, ("rank", "node"))
    tasks = probing.shares(spark, probing.part_files(spark, path), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, uri, i, n in zip(*[c.to_pylist() for c in batch.columns]):
                yield from scanned(b, uri, i, n, most, hot)

    found = cut(tasks.mapInArrow(run, _FOUND_SCHEMA))
    pairs = found.filter("a is not null").select("a", "b")
    blocks = found.filter("block is not null").select("key", "block", "nodes", "ranks", "mask", "value")
    if not blocks.isEmpty():
        pairs = pairs.unionByName(pairs_of_blocks(blocks, most))
    return pairs.distinct()


def scanned(number: int, uri: str, share: int, shares: int, most: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs and blocks of a share of a file of sorted keys."""
    with probing.open_file(uri) as raw, probing.pq.ParquetFile(raw) as file:
        scan = Scan(most, hot, shares > 1, (number << 40) + (share << 24))
        for g in probing.share_of(file, share, shares):
            t = file.read_row_group(g, columns=["key", "rank", "node"])
            yield from scan.add(*[t.column(c).to_numpy() for c in ("key", "rank", "node")])
        yield from scan.end()
