"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto their principal axes and cut into grid cells as wide as the
largest distance of a link, on the leading axes that are wider than a cell. Sorted by cells,
and within a cell by the nearest of some directions on the other axes, they form sequence
intervals: slices, blocks of a slice, tiles of a block. This tree of intervals is joined with
itself level by level, and pairs of intervals whose cells lie more than a link apart are
skipped. A block meets a tile only with those of its vectors that lie no further from the
tile's mean direction than the tile's own and a link's angle together; of these, leading
coordinates and the length of the rest bound the cosine from above, and what passes is
compared in double precision.

Pairs of blocks are pairs of rows that Spark's Cartesian product reads from the table of
blocks: nothing is shuffled for them, so the disk holds the vectors two or three times at
most, however many pairs of blocks there are. Each pair of blocks returns counts of links and
one link to a local root for each of its vectors, so a group of alike vectors costs rows in
proportion to its size, not to its square. Equal vectors are one from the start and count as
often as they occur; their rows get the result by a join on 128 bits of hashes.

Null vectors, zero vectors and those with null or non-finite components link with nothing and
come back as components of their own. Vectors of different lengths are compared as if the
shorter ended in zeros. Rows that repeat a vec_id are rows of their own; a null vec_id stays null
in the result and doesn't name a component unless all of it is null. An empty table gives an
empty result.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from estimark.llm.common import components, pieces_array, ranges, text_bytes, written
from estimark.llm.vectors import matrix, second_moments, usable, width

#: Vectors in a block of a small table, in a tile of a block; slices at most; bytes of a block's vectors.
BLOCK_ROWS, TILE_ROWS, FAN_OUT, BLOCK_BYTES = 4096, 256, 8, 13 << 20
#: Parts of a tile, by their distance from its mean direction.
PARTS = 8
#: Vectors that are compared with a tile at once, and tiles whose directions are tried at once.
AT_ONCE, TILES_AT_ONCE = 4096, 32
#: Share of the vectors' squared lengths that the coordinates for the bound hold, without the first; rounding of the bounds.
HELD, SLACK = 0.47, 1e-5
#: What goes along with a distinct vector: its smallest vec_id, its hashes, how often it occurs.
CARRIED = ["vec_id", "k1", "k2", "copies"]
CARRIED_SCHEMA = "vec_id long, k1 long, k2 long, copies long"


def unit(x: np.ndarray) -> np.ndarray:
    """The rows in double precision, each of length 1."""
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def units(raw: np.ndarray) -> np.ndarray:
    out = np.empty(raw.shape, np.float32)
    for at in range(0, len(raw), AT_ONCE):
        out[at : at + AT_ONCE] = unit(raw[at : at + AT_ONCE])
    return out


def nearest(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the direction with the largest inner product, and that product."""
    which, most = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for at in range(0, len(x), AT_ONCE):
        along = x[at : at + AT_ONCE] @ to.T
        which[at : at + AT_ONCE] = k = along.argmax(1)
        most[at : at + AT_ONCE] = along[np.arange(len(k)), k]
    return which, most


def directions(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The mean directions of the unit vectors from each start to the next."""
    to = np.add.reduceat(x, starts, axis=0)
    return to / (np.linalg.norm(to, axis=1, keepdims=True) + 1e-30)


def in_tiles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of unit vectors, and where its tiles start: those whose mean direction is nearest, the
    nearest first."""
    to = x[np.linspace(0, len(x) - 1, max(1, len(x) // TILE_ROWS)).astype(np.int64)]
    for step in range(3):
        tile, along = nearest(x, to)
        order = np.lexsort((-along, tile))
        starts = np.flatnonzero(np.diff(tile[order], prepend=-1))
        if step < 2:
            to = directions(x[order], starts)
    return order, starts


def grid_cells(vectors: DataFrame, d: int, dtype: type, axes: np.ndarray, sizes: np.ndarray, eps: float, lead: int, n: int) -> DataFrame:
    """(vec_id, k1, k2, copies, cells, code, v): what grid order sorts by, and the vectors' bytes. code: the
    nearest of n directions on the axes that have no cells, drawn once and as wide as the axes."""
    to = np.random.default_rng(1).standard_normal((n, d - lead)) * sizes[lead:] + 1e-30
    to = (to / np.linalg.norm(to, axis=1, keepdims=True)).astype(np.float32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), d)
                turned = unit(x) @ axes
                grid = np.floor(turned[:, :lead] / eps + 0.5).astype(np.int32)
                code = nearest(turned[:, lead:].astype(np.float32), to)[0] if turned.shape[1] > lead else np.zeros(len(x), np.int64)
                v = pieces_array(np.ascontiguousarray(x, dtype).view(np.uint8).ravel(), np.arange(len(x) + 1) * d * np.dtype(dtype).itemsize)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in CARRIED], pa.FixedSizeListArray.from_arrays(pa.array(grid.ravel()), lead).cast(pa.list_(pa.int32())), pa.array(code), v], [*CARRIED, "cells", "code", "v"]
                )

    return vectors.mapInArrow(cells, f"{CARRIED_SCHEMA}, cells array<int>, code long, v binary")


def in_blocks(placed: DataFrame, d: int, dtype: type) -> DataFrame:
    """(slice, at, n, lo, hi, v, tiles, vec_id, k1, k2, copies): a row a block, an interval of grid order, with the
    box around its cells. Its vectors are numbered from ``at``, tile by tile; slices are intervals of blocks."""
    count, most = placed.count(), max(1, BLOCK_BYTES // (d * np.dtype(dtype).itemsize))
    parts = max(1, -(-count // most), min(16, -(-count // BLOCK_ROWS)))
    slices = min(parts, FAN_OUT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cells = t["cells"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            raw = np.frombuffer(text_bytes(t["v"].combine_chunks())[0], dtype).reshape(-1, d)
            order, tiles = in_tiles(units(raw))
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            return pa.RecordBatch.from_arrays(
                [pa.array([min(part * slices // parts, slices - 1)], pa.int32()), pa.array([(part << 40) + at]), pa.array([len(t)]), one(pa.array(cells.min(0))), one(pa.array(cells.max(0))), pa.array([raw[order].tobytes()], pa.binary()), one(pa.array(tiles.astype(np.int32))), *[one(t[c].combine_chunks().take(pa.array(order))) for c in CARRIED]],
                ["slice", "at", "n", "lo", "hi", "v", "tiles", *CARRIED],
            )

        rows = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most + most // 4 - rows))
                rows += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if rows == most + most // 4:
                    yield out()
                    held, at, rows = [], at + rows, 0
        if rows:
            yield out()

    spread = placed.repartitionByRange(parts, "cells", "code", "k1", "k2").sortWithinPartitions("cells", "code", "k1", "k2")
    return spread.mapInArrow(pack, "slice int, at long, n long, lo array<int>, hi array<int>, v binary, tiles array<int>, vec_id array<long>, k1 array<long>, k2 array<long>, copies array<long>")


def unpacked(blocks: DataFrame) -> DataFrame:
    """(at, vec_id, k1, k2, copies) of the vectors of all blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ranges(batch.column("at").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), *[batch.column(c).flatten() for c in CARRIED]], ["at", *CARRIED])

    return blocks.select("at", "n", *CARRIED).mapInArrow(rows, f"at long, {CARRIED_SCHEMA}")


def near_pairs(blocks: DataFrame, lead: int) -> DataFrame:
    """Pairs of blocks that may hold vectors within a cell's width, each once, and each block with itself:
    at, v, tiles and copies of both. Tasks read both from the table of blocks, slice by slice."""

    def gap(lo_a, hi_a, lo_b, hi_b, most):
        return sum(most(lo_b[k] - hi_a[k] - 1, lo_a[k] - hi_b[k] - 1) ** 2 for k in range(lead))

    bounds = [f(F.col(c)[k]).alias(f"{c}{k}") for f, c in ((F.min, "lo"), (F.max, "hi")) for k in range(lead)]
    slices = [(r[0], r[1 : lead + 1], r[lead + 1 :]) for r in sorted(blocks.groupBy("slice").agg(*bounds).collect())]  # a row a slice
    columns = ["at", "lo", "hi", "v", "tiles", "copies"]
    side = lambda s, at: blocks.where(F.col("slice").isin(at)).select(*[F.col(c).alias(f"{c}_{s}") for c in columns])
    near = (F.col("at_a") <= F.col("at_b")) & (gap(*map(F.col, ("lo_a", "hi_a", "lo_b", "hi_b")), lambda x, y: F.greatest(F.lit(0), x, y)) < 1)
    pairs = []
    for k, (name, lo, hi) in enumerate(slices):
        others = [s[0] for s in slices[k:] if gap(lo, hi, s[1], s[2], lambda x, y: max(0, x, y)) < 1]
        pairs.append(side("a", [name]).hint("shuffle_replicate_nl").join(side("b", others), near).drop("lo_a", "hi_a", "lo_b", "hi_b"))
    return functools.reduce(DataFrame.unionByName, pairs)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def roots(near: np.ndarray) -> np.ndarray:
    """The smallest of rows and columns (numbered after the rows) that each row and column reaches by ``near``."""
    n, m = near.shape
    if 16 * np.count_nonzero(near) > near.size:
        rows, none = np.arange(n, dtype=np.int32), np.int32(n + m)
        for _ in range(8):
            columns = np.where(near, rows[:, None], none).min(0)
            low = np.minimum(rows, np.where(near, columns, none).min(1))
            if (low == rows).all():
                return np.concatenate([rows, np.where(columns == none, np.arange(n, n + m), columns)])
            rows = low
    i, j = np.nonzero(near)
    return spanning(i, j + n, n + m)


@dataclasses.dataclass
class Block:
    """The vectors of a block as they are and as unit vectors, where its tiles start, how often each
    vector occurs, and what bounds a cosine: leading coordinates and the length of the rest."""

    raw: np.ndarray
    unit: np.ndarray
    tiles: np.ndarray
    copies: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, tiles: np.ndarray, copies: np.ndarray, axes: np.ndarray) -> Block:
        x = units(raw)
        turned = x @ axes.astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", turned, turned)) + SLACK)
        return cls(raw, x, tiles, copies.astype(np.float64), np.column_stack([turned, rest]))


def meeting(x: Block, y: Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """For each tile of y vectors of x, and parts of the tile: (start, end, how many of these vectors may link
    with the part, the first ones). Within one block, vectors behind the tile's first."""
    angle, ends = np.arccos(least), [*y.tiles[1:].tolist(), len(y.raw)]
    for first in range(0, len(ends), TILES_AT_ONCE):
        starts = y.tiles[first : first + TILES_AT_ONCE]
        base = starts[0] if same else 0
        to = directions(y.unit[starts[0] : ends[first + len(starts) - 1]], starts - starts[0])
        along = to @ x.unit[base:].T
        for k, (start, end) in enumerate(zip(starts.tolist(), ends[first:])):  # noqa: B905
            cuts = sorted({start + (end - start) * p // PARTS for p in range(PARTS + 1)})
            # where unit vectors cancel out, their sum has no direction to speak of, but any will do
            far = np.arccos(np.clip(np.minimum.reduceat(y.unit[start:end] @ to[k], np.array(cuts[:-1]) - start) - SLACK, -1, 1)) + angle
            limits = np.minimum.accumulate(np.where(far < np.pi, np.cos(far) - SLACK, -2))
            skip = start + 1 - base if same else 0
            some = np.flatnonzero(along[k][skip:] >= limits[-1]) + skip
            misses = (along[k][some] < limits[:, None]).sum(0, dtype=np.uint8)
            counts = np.cumsum(np.bincount(misses, minlength=len(limits))).tolist()
            yield some[np.argsort(misses, kind="stable")] + base, list(zip(cuts[:-1], cuts[1:], counts))  # noqa: B905


def passing(x: Block, y: Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors of x, vectors of y): those of a part of a tile that have a partner by the bounds of the cosines."""
    for rows, parts in meeting(x, y, same, least):
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            bound = np.take(x.bound, some, axis=0)
            for start, end, n in parts:
                if n > at:
                    most = bound[: n - at] @ y.bound[start:end].T
                    if most.max() >= least - SLACK:
                        may = most >= least - SLACK
                        yield some[: n - at][may.any(1)], np.arange(start, end)[may.any(0)]


def block_links(x: Block, y: Block, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the vectors of two blocks (or within one): for each vector of the first
    and of the second its count (a vector counts as often as its copies), and the smallest
    vector that links between them reach."""
    n, m = len(x.raw), len(y.raw)
    shift = 0 if same else n  # the vectors of one block have one name on either side
    count, frm, to, held = np.zeros(n if same else n + m, np.int64), [], [], 0
    for i, j in passing(x, y, same, least):
        near = unit(x.raw[i]) @ unit(y.raw[j]).T >= least
        if same:
            near &= i[:, None] > j
        if not near.any():
            continue
        weights = near.astype(np.float64)
        count[i] += (weights @ y.copies[j]).astype(np.int64)
        count[shift + j] += (x.copies[i] @ weights).astype(np.int64)
        root, name = roots(near), np.concatenate([i, shift + j])
        moved = np.flatnonzero(root != np.arange(len(root)))
        frm.append(name[moved])
        to.append(name[root[moved]])
        held += len(moved)
        if held > 1 << 20:
            label = spanning(np.concatenate(frm), np.concatenate(to), len(count))
            frm, to, held = [np.flatnonzero(label != np.arange(len(label)))], [label[label != np.arange(len(label))]], 0
    return count, spanning(np.concatenate(frm), np.concatenate(to), len(count)) if frm else np.arange(len(count))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, lead: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``: other vectors with a
    cosine of ``least`` or more, and the smallest vec_id that such links reach."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    alone = rows.where(~usable("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = rows.where(usable("v")).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    good = every.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    d = width(every, "v")
    if not d:
        return alone.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    eps = float(np.sqrt(2 - 2 * least)) + 1e-9
    dtype = np.float32 if isinstance(rows.schema["v"].dataType.elementType, FloatType) else np.float64
    moments = second_moments(every, "v", d)
    shares, axes = np.linalg.eigh(moments / max(np.trace(moments), 1e-30))
    shares, axes = np.maximum(shares[::-1], 0), axes[:, ::-1].copy()
    lead = int(np.clip((np.sqrt(shares[:lead]) > eps).sum(), 1, lead))
    # coordinates that bound a cosine: as many as tell vectors apart that aren't alike
    leading = axes[:, : max(31, int(np.searchsorted(np.cumsum(shares[1:]), HELD)) + 2)].copy()
    n = int(np.clip(2 * vectors.count() * d * np.dtype(dtype).itemsize // BLOCK_BYTES, 1, 512))
    placed = written(grid_cells(good, d, dtype, axes, np.sqrt(shares), eps, lead, n))
    blocks = written(in_blocks(placed, d, dtype), placed, by="slice")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, Block | None] = (-1, None)
        for batch in batches:
            for k in range(batch.num_rows):
                at = [batch.column(f"at_{s}")[k].as_py() for s in "ab"]
                of = lambda s: Block.of(np.frombuffer(batch.column(f"v_{s}")[k].as_buffer(), dtype).reshape(-1, d), batch.column(f"tiles_{s}")[k].values.to_numpy(), batch.column(f"copies_{s}")[k].values.to_numpy(), leading)  # noqa: B023, E731
                if kept[0] != at[0]:
                    kept = (at[0], of("a"))
                x, y = kept[1], kept[1] if at[0] == at[1] else of("b")
                count, label = block_links(x, y, at[0] == at[1], least)
                names = np.arange(at[0], at[0] + len(x.raw)) if at[0] == at[1] else np.concatenate([np.arange(a, a + len(z.raw)) for a, z in zip(at, (x, y), strict=True)])
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(count[some]), pa.array(names[label[some]])], ["at", "n", "root"])

    found = written(near_pairs(blocks, lead).mapInArrow(compare, "at long, n long, root long"))
    n_links = found.groupBy("at").agg(F.sum("n").alias("n_links"))
    linked = components(found.select(F.col("at").alias("a"), F.col("root").alias("b")))
    ids = unpacked(blocks)
    named = ids.join(linked, ids["at"] == linked["node"], "left").withColumn("c", F.coalesce("component", "at"))
    least_id = named.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    info = named.join(least_id, "c").join(n_links, "at", "left").select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # a table, so that Spark can split the rows of a vector that very many share
    info = written(info, blocks, found)
    result = every.select("vec_id", "k1", "k2").join(info, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return result.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
