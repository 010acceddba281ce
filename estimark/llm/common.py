"""Shared pieces of the training-data operators: word splitting, blocks of documents,
written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one task holds at once; longer batches are cut between documents.
BATCH_BYTES = 16 << 20

SPACE, LETTER, DIGIT, PUNCT, HIGH = range(5)
_CLASS = np.full(256, PUNCT, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = LETTER
_CLASS[97:123] = LETTER
_CLASS[128:] = HIGH
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is
    unset and all runs on one machine (tests), a temporary folder; elsewhere that's an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="estimark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths and schemas of the tables written within each ``settled`` that runs.
_MADE: list[dict[str, StructType]] = []


def written(df: DataFrame, *spent: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: computed once, its
    lineage cut, and still there when executors are lost. The shuffle files behind it go at
    once, and so do the tables ``spent``, which came from this function and serve no more.
    by: a column with few values, each of which gets a folder that can be read alone."""
    spark, schema = df.sparkSession, df.schema
    path, before = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    if _MADE:
        _MADE[-1][path] = schema
    emptied(*spent)
    return out


def emptied(*tables: DataFrame) -> None:
    """Leaves nothing but their schema of tables that came from ``written``."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            empty(table.sparkSession, path, table.schema)


def empty(spark: SparkSession, path: str, schema: StructType) -> None:
    for made in _MADE:
        made.pop(path, None)
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def settled(make: Callable[[], DataFrame], *spent: DataFrame) -> DataFrame:
    """What ``make`` returns, as ``written`` does it; all tables written on the way are emptied."""
    _MADE.append({})
    try:
        out = written(make(), *spent)
    finally:
        made = _MADE.pop()
    for path, schema in made.items():
        if path != _PATHS[out]:
            empty(out.sparkSession, path, schema)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the ``text`` (or other) column of each has about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def text_lengths(text: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    return np.diff(offsets.astype(np.int64))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (with the end); null is empty."""
    if text.null_count:
        text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds, without copying."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def split_runs(data: np.ndarray, offsets: np.ndarray, chunks: bool) -> tuple[pa.Array, np.ndarray]:
    """Codes of the words of all texts (in order) as a dictionary array, and where each text's
    words begin.

    chunks: words are runs without ASCII white space. Otherwise they are also cut between
    ASCII letters, digits and punctuation, wherever both sides of the cut tokenise on their own.
    """
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    left, right = kind[:-1], kind[1:]
    if chunks:
        np.not_equal(left == SPACE, right == SPACE, out=cut[1:-1])
    else:
        np.not_equal(left, right, out=cut[1:-1])
        joined = ((left == HIGH) & (right != SPACE)) | ((right == HIGH) & (left != SPACE))
        # contractions ('s) and the tokenizer's <|...|> markers span letters and punctuation
        mark = (data == 39) | (data == 124)
        joined |= (mark[:-1] & (right == LETTER)) | ((data[1:] == 124) & (left == LETTER))
        cut[1:-1] &= ~joined
    cut[offsets] = True
    bounds = np.flatnonzero(cut).astype(np.int32)
    del cut, left, right
    solid = kind[bounds[:-1]] != SPACE
    coded = pieces_array(data, bounds).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[solid]
    first = np.zeros(len(bounds), np.int32)
    np.cumsum(solid, out=first[1:])
    return pa.DictionaryArray.from_arrays(pa.array(codes), coded.dictionary), first[np.searchsorted(bounds, offsets)].astype(np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[i] .. starts[i] + counts[i] - 1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = counts > 0
    s, c = starts[full].astype(np.int64), counts[full].astype(np.int64)
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - c[:-1] + 1
    return np.cumsum(out)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach from each node in a link.

    Alternates large-star and small-star steps; each is a grouped minimum and a join, and its
    result is written to the shared folder. Nothing is collected but the count of links."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        emptied(edges)
        edges = small
        if now == before:
            break
        before = now
    top = edges.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)


_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd number modulo 2^64, and their inverses."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])) for base in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _POWERS[size]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return scrambled((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and each text's first run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _CLASS[data] != SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[1:-1] = ~solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & solid)
    edge[1:-1] = ~solid[1:]
    edge[-1] = True
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & solid) + 1
    return starts, ends, np.searchsorted(starts, offsets)
