"""Tables of files that are sorted by a key and cut into buckets by it, and workers that read of them only what they need.

write_part() makes a part: one file for each bucket, bucket = pmod(hash(key), n), sorted, in small row groups. The number in a file's
name is its bucket (files of older parts lie in a folder _b=bucket each). A worker that looks for
some keys opens the files of their bucket and reads those row groups whose range of keys holds one, so what is read follows the number
of keys that are looked for and not the size of the table. Files are opened through pyarrow's file systems, wherever the shared folder lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group before it is compressed.
ROW_GROUP = 1 << 20
#: Bytes of a file that one task scans.
SHARE = 8 << 20
#: Bytes of small files that one task reads.
TOGETHER = 2 << 20
_NAME = re.compile(r"/(?:_b=(\d+)/)?part-(\d+)-[^/]*\.parquet$")


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


_PLACES: dict[int, list[int]] = {}


def _placed_by(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a number that a shuffle into so many partitions puts into the partition of its own, so that no two buckets fall together."""
    if buckets in _PLACES:
        return _PLACES[buckets]
    found, n = {}, 64
    while len(found) < buckets:
        n *= 4
        found = {r["p"]: r["id"] for r in spark.range(n * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("p")).agg(F.min("id").alias("id")).collect()}
    _PLACES[buckets] = [found[b] for b in range(buckets)]
    return _PLACES[buckets]


def write_part(rows: DataFrame, path: str, key: str, buckets: int, then: tuple[str, ...] = ()) -> None:
    """Writes rows by bucket of a BIGINT key, one file each, sorted by the key and `then`.

    The bucket is in no column: a sort that began with it would compare whole rows, as it is the same all over a task. Nor do sorted keys and texts gain by a dictionary.
    """
    one = F.element_at(F.array(*map(F.lit, _placed_by(rows.sparkSession, buckets))), bucket(F.col(key), buckets) + 1).cast("bigint")
    placed = rows.repartition(buckets, one).sortWithinPartitions(key, *then)
    placed.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(ROW_GROUP)).option("maxRecordsPerFile", 0).parquet(path)


def part_files(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(bucket, file, bytes) of a part: as many as there are buckets, at most."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    found = fs.listFiles(at, True)
    while found.hasNext():
        x = found.next()
        if (m := _NAME.search(x.getPath().toString())) is not None:
            b, uri = int(m.group(1) or m.group(2)), x.getPath().toString()
            # where the first bucket has no row Spark leaves a file without any
            if b or m.group(1) or _rows(uri):
                out.append((b, uri, x.getLen()))
    if len({b for b, _, _ in out}) < len(out):
        raise ValueError(f"{path} has buckets of several files")
    return sorted(out)


def by_bucket(parts: list[list[tuple[int, str, int]]]) -> dict[int, list[str]]:
    """The files of each bucket over several parts."""
    out: dict[int, list[str]] = {}
    for part in parts:
        for b, f, _ in part:
            out.setdefault(b, []).append(f)
    return out


def open_file(uri: str):
    """A file that can be sought, wherever pyarrow's file systems reach: local, HDFS, object stores."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem().open_input_file(uri)
    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system.open_input_file(path)


def _rows(uri: str) -> int:
    with open_file(uri) as raw, pq.ParquetFile(raw) as file:
        return file.metadata.num_rows


def ranges(file: pq.ParquetFile, key: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest key of each row group."""
    meta = file.metadata
    at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == key)
    found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    return np.array([s.min for s in found], np.int64), np.array([s.max for s in found], np.int64)


def groups_with(low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row groups whose range holds one of the wanted keys, which are sorted."""
    return np.flatnonzero(np.searchsorted(wanted, low, "left") < np.searchsorted(wanted, high, "right"))


def matches(wanted: np.ndarray, keys: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in wanted, places in keys) of all equal pairs, in slices of about `most`; keys are sorted."""
    left, right = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = right - left
    total = np.cumsum(n)
    at = 0
    while at < len(wanted):
        # as many wanted keys as make a slice, one at least
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        k = n[at:end]
        i = np.repeat(np.arange(at, end), k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(left[at:end], k)
        if len(i):
            yield i, j
        at = end


def probe(wanted: DataFrame, files: dict[int, list[str]], key: str, schema: str, buckets: int) -> DataFrame:
    """The rows of a table (key first in schema) whose key is in wanted.`key`, each once for every row of the table; no other row group is read.

    files: of each bucket. Keys that are repeated in wanted count once in a task.
    """
    spark = wanted.sparkSession
    names = spark.createDataFrame([], schema).schema.names
    src = wanted.select(F.col(key).cast("bigint").alias("k")).filter("k is not null").distinct().select("k", bucket(F.col("k"), buckets).alias("b")).repartition("b").sortWithinPartitions("b", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
            for f, t in zip(edge, [*edge[1:], len(b)]):
                mine = keys[f:t]
                for uri in files.get(int(b[f]), ()):
                    with open_file(uri) as raw, pq.ParquetFile(raw) as file:
                        for g in groups_with(*ranges(file, key), mine):
                            rows = file.read_row_group(int(g), columns=names).select(names).combine_chunks()
                            have = rows.column(0).to_numpy()
                            at = np.searchsorted(mine, have)
                            keep = (at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == have)
                            yield from rows.take(pa.array(np.flatnonzero(keep))).to_batches()

    return src.mapInArrow(run, schema)


def shares(spark: SparkSession, files: list[tuple[int, str, int]], size: int = SHARE) -> DataFrame:
    """(bucket, file, share, shares) of a part: a file in as many tasks as its size asks for."""
    rows = [(b, f, i, n) for b, f, length in files for n in [max(1, -(-length // size))] for i in range(n)]
    df = spark.createDataFrame(rows, "bucket int, file string, share int, shares int")
    # small files are read by one task together
    tasks = max(1, min(len(rows), -(-sum(n for _, _, n in files) // TOGETHER)))
    return df.repartition(tasks)


def share_of(file: pq.ParquetFile, share: int, count: int) -> range:
    """The row groups of a share of a file."""
    n = file.metadata.num_row_groups
    return range(share * n // count, (share + 1) * n // count)
