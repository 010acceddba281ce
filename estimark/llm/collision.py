"""Approximate nearest neighbours by collision-counting hashing.

Each vector is projected on random lines, and each shard keeps one sorted array a line. Around
a query, a window opens on every line and widens round by round (virtual rehashing). A vector
that falls in the windows of half the lines is verified by its exact inner product. The search
of a shard ends when a vector as near as the k-th found would have been verified with the
target probability, or when the windows hold all vectors.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), where M is the
longest vector's length. Vectors that are null, zero or hold null or non-finite components
take no part, neither as queries nor as candidates. Candidates that share the query's id are
its own row. Vectors of different lengths are compared as if the shorter ended in zeros. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.llm.vectors import matrix, usable, width

#: Vectors of a shard (on average) until there are as many shards as SHARDS, bytes of its vectors
#: from then on, queries of a block.
SHARD_ROWS, SHARDS, SHARD_BYTES, QUERY_ROWS = 8192, 64, 128 << 20, 256
#: Vectors whose collisions are counted at once.
SLICE = 4096


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x. Each is summed on its own and in one order, so that equal
    rows have equal products wherever they stand, which a matrix product doesn't promise."""
    return np.einsum("ij,j->i", x, query)


class Shard:
    """Sorted projections of a shard's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray, longest: float):
        self.ids, self.x, self.lines = ids, x, lines
        self.rest = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))
        placed = (np.hstack([x, self.rest[:, None]]) @ lines).T
        order = np.argsort(placed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed, order, 1)
        #: each vector's place in the array of each line, in the least unsigned type that holds their number
        self.place = np.empty(placed.shape, np.uint16 if placed.shape[1] < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(placed.shape[1], dtype=self.place.dtype)[None, :], 1)
        self.half = 0.4 * float(placed.std()) + 1e-12

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, recall: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and inner products of the k vectors found nearest to it."""
        n, m = len(self.ids), self.lines.shape[1]
        need = m // 2
        at_lines = (queries @ self.lines[:-1]).T
        done = self.ids[None, :] == own[:, None]
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        half, active, ended = self.half, np.arange(len(queries)), []
        while len(active):
            a = np.stack([np.searchsorted(s, p - half) for s, p in zip(self.sorted, at_lines[:, active], strict=True)], 1)
            b = np.stack([np.searchsorted(s, p + half, "right") for s, p in zip(self.sorted, at_lines[:, active], strict=True)], 1)
            all_in = ((a == 0) & (b == n)).all(1)
            stay = []
            for row, q in enumerate(active.tolist()):
                hit = np.ones(n, bool) if all_in[row] else self.collisions(a[row], b[row]) >= need
                self.verify(q, queries[q], hit, done[q], best, k)
                if all_in[row] or self.enough(best[q], queries[q], half, need, m, k, recall):
                    ended.append(half)
                else:
                    stay.append(q)
            active = np.array(stay, np.int64)
            half *= 1.25
        self.half = 0.8 * float(np.median(ended))  # where the next block's windows begin; blocks come in a fixed order
        return best

    def collisions(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """In how many lines' windows each vector falls. A place before the window wraps around to
        a number beyond its length, so one comparison tells."""
        kind, n = self.place.dtype, self.place.shape[1]
        begin, length = begin[:, None].astype(kind), (end - begin)[:, None].astype(kind)
        return np.concatenate([np.add.reduce(self.place[:, at : at + SLICE] - begin < length, axis=0, dtype=np.uint8) for at in range(0, n, SLICE)])

    def verify(self, q: int, query: np.ndarray, hit: np.ndarray, done: np.ndarray, best: list, k: int) -> None:
        fresh = np.flatnonzero(hit & ~done)
        if len(fresh):
            done[fresh] = True
            at, score = np.concatenate([best[q][0], fresh]), np.concatenate([best[q][1], products(self.x.take(fresh, 0), query)])
            if len(at) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                top = np.flatnonzero(score >= edge)  # with all ties
                top = top[np.lexsort((self.ids[at[top]], -score[top]))[:k]]
                at, score = at[top], score[top]
            best[q] = at, score

    def enough(self, found: tuple, query: np.ndarray, half: float, need: int, m: int, k: int, recall: float) -> bool:
        """True if a vector as near as the k-th found would have been seen by now."""
        at, score = found
        if len(at) < k:
            return False
        worst = at[-1]
        far = math.sqrt(max(1e-18, float(self.x[worst] @ self.x[worst]) + self.rest[worst] ** 2 + float(query @ query) - 2 * score[-1]))
        p = math.erf(half / (far * math.sqrt(2)))
        sure = p - (need - 0.5) / m
        return sure > 0 and 0.5 * math.erfc(-sure * math.sqrt(m / max(1e-12, 2 * p * (1 - p)))) >= recall


def search(vectors: DataFrame, queries: F.Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", lines: int = 48, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects, its k nearest of
    the other rows by inner product, ties to the smaller vec_id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    asked = vectors.where(queries).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    d = width(rows, "v")
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, min(SHARDS, -(-n // SHARD_ROWS)), -(-n * d * 8 // SHARD_BYTES))
    directions = np.random.default_rng(seed).standard_normal((d + 1, lines))
    index = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("long").alias("shard"), F.lit(-1).cast("long").alias("part"), "vec_id", "v")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (20 * QUERY_ROWS)))).cast("long")
    ask = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), part.alias("part"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            key = batch.column("shard").to_numpy()
            kind = batch.column("part").to_numpy() < 0
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (kind[1:] != kind[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if key[lo] != now:
                    now, held, shard = key[lo], [], None
                ids, x = batch.column("vec_id").slice(lo, hi - lo).to_numpy(), matrix(batch.column("v").slice(lo, hi - lo), d)
                if kind[lo]:
                    held.append((ids, x))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), directions, longest), []
                out = [(i, *found) for at in range(0, len(ids), QUERY_ROWS) for i, found in zip(ids[at : at + QUERY_ROWS], shard.search(x[at : at + QUERY_ROWS], ids[at : at + QUERY_ROWS], k, recall), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out])), pa.array(np.concatenate([shard.ids[o[1]] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                    ["query_id", "vec_id", "score"],
                )

    # in one order whatever the input's, so that a task that runs again finds the same
    both = index.unionByName(ask).repartition("shard").sortWithinPartitions("shard", "part", "vec_id", F.xxhash64("v"))
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
