"""Reading vector columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> F.Column:
    """True for vectors that take part: not null, no null or non-finite component, not zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def width(vectors: DataFrame, column: str) -> int:
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column in double precision; shorter vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def second_moments(vectors: DataFrame, column: str, d: int) -> np.ndarray:
    """The d x d matrix of summed products of unit vectors' components: d * d numbers come to
    the driver, however many vectors there are."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(d * d)
    for row in vectors.select(column).mapInArrow(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out.reshape(d, d)
