"""Hard negatives by a vector-approximation file.

Each shard of the vectors quantises every component into cells of about equal counts and keeps
the cells' numbers, one byte each, beside the vectors. For an anchor, a table holds the least
and the greatest product of its component with each cell; their sums over a row's cells bound
the row's score from below and above. Exact scores are taken only of rows that may enter: the
first pass looks for an anchor's positives (the best rows of its label), the second for the
best rows of other labels in the window that each positive's score opens. What the shards find
is merged by anchor, so all rows count and nothing is approximate in the result.

Scores are integer inner products of ``floor(scale * x)``; scores that 64 bits may not hold
raise an error. Rows with a null id, label or vector, or with null or non-finite components take
no part; zero and empty vectors do, with a score of 0. Shorter vectors are compared as if they
ended in zeros. Rows that repeat an id are one row, that of the smallest label and vector. Equal
vectors under different ids are different rows, ties come by smaller id. Other columns are
ignored. An empty table, an anchor without positives, and a positive without rows in its window
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.llm.common import written
from estimark.llm.vectors import matrix, width

#: Cells a component; shards at least; bytes of a shard's vectors at most, on average; anchors of a block.
CELLS, SHARDS, SHARD_BYTES, BLOCK = 64, 24, 64 << 20, 16
LEAST = np.iinfo(np.int64).min


class Approximations:
    """A shard's integer vectors in order of label, and the cell of each of their components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        once = np.unique(ids, return_index=True)[1]
        order = once[np.lexsort((ids[once], labels[once]))]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.most = int(np.abs(self.x).max(initial=0))
        n, d = self.x.shape
        self.code, self.low, self.high = np.empty((d, n), np.uint8), [], []
        for j in range(d):
            values = np.sort(self.x[:, j])
            cuts = np.unique(values[n * np.arange(CELLS) // CELLS])
            self.code[j] = np.searchsorted(cuts, self.x[:, j], "right") - 1
            self.low.append(cuts.astype(np.int64))
            self.high.append(values[np.append(np.searchsorted(values, cuts[1:]), n) - 1].astype(np.int64))

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each anchor's score with each of the rows, from below and from above."""
        code = self.code[:, rows]
        low, high = np.zeros((2, len(anchors), code.shape[1]), np.int64)
        for j, cells in enumerate(code):
            a, b = anchors[:, j, None] * self.low[j], anchors[:, j, None] * self.high[j]
            low += np.minimum(a, b).take(cells, 1)
            high += np.maximum(a, b).take(cells, 1)
        return low, high

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def best(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (anchor, row), the k of each anchor with the highest scores from low to
        high, by their exact scores."""
        score = np.concatenate([np.zeros(0, np.int64), *((self.x[r[at : at + 65536]] * anchors[a[at : at + 65536]]).sum(1) for at in range(0, len(a), 65536))])
        ok = (score >= low[a]) & (score <= high[a])
        a, r, score = a[ok], r[ok], score[ok]
        order = np.lexsort((self.ids[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[top], r[top], score[top]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; the least integer where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST)
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k]


def positives_in(shard: Approximations, ids: np.ndarray, label: int, anchors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of anchors of one label, the k best of the shard's other rows of that label."""
    begin, end = shard.of_label(label)
    low, high = shard.bounds(anchors, slice(begin, end))
    own = shard.ids[None, begin:end] == ids[:, None]
    low[own] = LEAST
    a, r = np.nonzero((high >= kth(low, k)[:, None]) & ~own)
    a, r, score = shard.best(anchors, a, begin + r, k, np.full(len(ids), LEAST), np.full(len(ids), np.iinfo(np.int64).max))
    return ids[a], shard.ids[r], score


def negatives_in(shard: Approximations, ids: np.ndarray, label: int, anchors: np.ndarray, positives: list[tuple[np.ndarray, np.ndarray]], k: int, window: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Of anchors of one label, for each of their positives the k best of the shard's rows of
    other labels in the window."""
    begin, end = shard.of_label(label)
    parts = [shard.bounds(anchors, rows) for rows in (slice(0, begin), slice(end, len(shard.ids)))]
    low, high = (np.concatenate(x, 1) for x in zip(*parts, strict=True))
    out = []
    for place in range(max((len(p[0]) for p in positives), default=0)):
        have = np.flatnonzero([len(p[0]) > place for p in positives])
        score = np.array([positives[i][1][place] for i in have], np.int64)
        least, most = -(-window[0] * score // 100), window[1] * score // 100
        lo, hi = low[have], high[have]
        surely = (lo >= least[:, None]) & (hi <= most[:, None])
        reach = np.maximum(kth(np.where(surely, lo, LEAST), k), least)
        a, r = np.nonzero((hi >= reach[:, None]) & (lo <= most[:, None]))
        a, r, found = shard.best(anchors[have], a, np.where(r < begin, r, r + end - begin), k, least, most)
        out.append((ids[have][a], np.array([positives[i][0][place] for i in have], np.int64)[a], shard.ids[r], score[a], found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else ()


def by_shard(batches: Iterator[pa.RecordBatch], d: int, scale: float, look: Callable[[Approximations, np.ndarray, int, np.ndarray, pa.RecordBatch], tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``look`` at each shard, whose rows come first, with blocks of anchors of one label."""

    def integers(column: pa.Array) -> np.ndarray:
        x = np.floor(matrix(column, d) * scale)
        if np.abs(x).max(initial=0) >= 2.0**62:
            raise ValueError("components are too large for 64-bit scores")
        return x.astype(np.int64)

    now, held, shard = None, [], None
    for batch in batches:
        key, kind, label = (batch.column(c).to_numpy() for c in ("shard", "kind", "label"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | ((label[1:] != label[:-1]) & (kind[1:] > 0))) + 1).tolist(), len(key)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            if key[begin] != now:
                now, held, shard = key[begin], [], None
            part = batch.slice(begin, end - begin)
            if not kind[begin]:
                x = integers(part.column("v"))
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x))
                continue
            if shard is None:
                if not held:
                    continue
                shard, held = Approximations(*(np.concatenate([h[i] for h in held]) for i in range(3))), []
            for at in range(0, part.num_rows, BLOCK):
                block = part.slice(at, BLOCK)
                anchors = integers(block.column("v"))
                if d * shard.most * int(np.abs(anchors).max(initial=0)) >= 1 << 56:
                    raise ValueError("components are too large for 64-bit scores")
                found = look(shard, block.column("vec_id").to_numpy(), int(label[begin]), anchors, block)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)


def mine(vectors: DataFrame, anchors: F.Column, label: F.Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row
    that ``anchors`` selects, its first positives, and for each of them the first negatives whose
    score lies from window[0] to window[1] percent of the positive's."""
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    d, n = max(1, width(rows, "v")), rows.count()
    shards = max(SHARDS, -(-n * d * 5 // SHARD_BYTES))
    stored = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "label", "v")
    first = F.min(F.struct("label", "v")).alias("r")
    asked = rows.where("asks").groupBy("vec_id").agg(first).select("vec_id", "r.label", "r.v")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    def met(asked: DataFrame, more: list[str]) -> DataFrame:
        both = stored.unionByName(asked.select(everywhere, F.lit(1).alias("kind"), "vec_id", "label", "v", *more), allowMissingColumns=True)
        return both.repartition("shard").sortWithinPartitions("shard", "kind", "label", "vec_id", "v")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = lambda shard, ids, of, x, block: positives_in(shard, ids, of, x, positives)
        return by_shard(batches, d, scale, look, ["vec_id", "positive_id", "positive_score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def look(shard: Approximations, ids: np.ndarray, of: int, x: np.ndarray, block: pa.RecordBatch) -> tuple:
            known = [tuple(np.array(block.column(c)[i].as_py(), np.int64) for c in ("positive_ids", "positive_scores")) for i in range(len(ids))]
            return negatives_in(shard, ids, of, x, known, negatives, window)

        return by_shard(batches, d, scale, look, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = met(asked, []).mapInArrow(find_positives, "vec_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    known = written(best.groupBy("vec_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores")))
    asked = asked.join(known, "vec_id")
    found = met(asked, ["positive_ids", "positive_scores"]).mapInArrow(find_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
