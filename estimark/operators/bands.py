"""Statistics of comparables without a row for a pair.

A key's prices stand in order of size, so a target's band of sizes is a range found by binary
search. Their ranks form a wavelet tree: the bits of the ranks, level by level, with the ranges'
places on the next level told by prefix counts. From it, the k-th price of any range, how many
prices lie under a limit, and the sums of the k lowest follow in one step a level, for all targets
at once. Prices of another condition are scaled before they are ranked, once for each condition
that targets have. The target's own price is taken out by position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from estimark import settings as st
from estimark.functions import scalars as sc
from estimark.operators.meeting import MOST_ASKS, meet

#: A band reaches from 3/4 to 5/4 of a size, less than one bucket to either side.
BUCKET_BASE = 1.35
#: The bucket of targets without a size, for which any size will do.
ANY_SIZE = -(1 << 30)
#: More comparables than there are.
NEVER = 1 << 62
GROUPS = ["premium", "standard", "needs_work", "unknown"]
#: By the comparable's condition and the target's.
FACTORS = np.array([[st.CONDITION_FACTORS.get((a, b), 1.0) for b in GROUPS] for a in GROUPS])
STATS = ["n_same", "n_any", "n_raw", "n_comps", "median", "p40", "p60", "stdev"]
#: Entries up to which a tree's levels are kept for the next question; larger ones are made anew.
KEPT_LEVELS = 1 << 16


class Ranges:
    """Weighted values in a fixed order; answers for many ranges [l, r) of it at once."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.distinct, self.rank = np.unique(values, return_inverse=True)
        self.weights, self.bits = weights, max(1, len(self.distinct).bit_length())
        self.total = np.concatenate([[0], np.cumsum(weights)])
        self.middle = float(self.distinct[len(self.distinct) // 2]) if len(self.distinct) else 0.0
        self.kept: list | None = None

    def made(self) -> Iterator[tuple]:
        """(bit, zeros, their weights, sums, sums of squares) of each level, as prefix sums."""
        rank, w = self.rank, self.weights
        x = self.distinct[rank] - self.middle
        for bit in reversed(range(self.bits)):
            zero = (rank >> bit & 1) == 0
            yield (bit, *(np.concatenate([[0], np.cumsum(np.where(zero, v, 0))]) for v in (np.ones(len(w), np.int64), w, w * x, w * x * x)))
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            rank, w, x = rank[order], w[order], x[order]

    def levels(self) -> Iterator[tuple]:
        if len(self.rank) > KEPT_LEVELS:
            return self.made()
        if self.kept is None:
            self.kept = list(self.made())
        return iter(self.kept)

    def below(self, l: np.ndarray, r: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Weight of the values of each range whose rank is under the limit."""
        found = np.zeros(len(l), np.int64)
        for bit, zeros, weight, _, _ in self.levels():
            ones = (limit >> bit & 1) == 1
            found += np.where(ones, weight[r] - weight[l], 0)
            l, r = (np.where(ones, zeros[-1] + at - zeros[at], zeros[at]) for at in (l, r))
        return found

    def smallest(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k-th value of each range (from 0), and the sum and the sum of squares of the k lower
        ones, both from the middle value."""
        rank, s, q = np.zeros(len(l), np.int64), np.zeros(len(l)), np.zeros(len(l))
        for bit, zeros, weight, sums, squares in self.levels():
            low = weight[r] - weight[l]
            ones = k >= low
            s += np.where(ones, sums[r] - sums[l], 0)
            q += np.where(ones, squares[r] - squares[l], 0)
            k, rank = np.where(ones, k - low, k), rank | ones.astype(np.int64) << bit
            l, r = (np.where(ones, zeros[-1] + at - zeros[at], zeros[at]) for at in (l, r))
        value = self.distinct[np.minimum(rank, len(self.distinct) - 1)]
        return value, s + k * (value - self.middle), q + k * (value - self.middle) ** 2


def described(ranges: Ranges, l: np.ndarray, r: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_raw, n_comps, median, p40, p60, stdev) of each range without one copy of ``own``, as
    ``comps.robust`` has them of an array; ranges with nothing else get zeros."""
    n = ranges.total[r] - ranges.total[l] - 1
    some = n > 0
    out = [np.where(some, n, 0), *(np.zeros(len(n)) for _ in range(5))]
    l, r, own, n = l[some], r[some], own[some], n[some]
    if not len(n):
        return tuple(out)
    before = ranges.below(l, r, np.searchsorted(ranges.distinct, own))

    def kth(*places: np.ndarray) -> list[np.ndarray]:
        k = np.concatenate([p + (p >= before) for p in places])
        return np.split(ranges.smallest(np.tile(l, len(places)), np.tile(r, len(places)), k)[0], len(places))

    q1, q3 = kth(n // 4, n * 3 // 4)
    low, high = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    a = ranges.below(l, r, np.searchsorted(ranges.distinct, low)) - (own < low)
    b = ranges.below(l, r, np.searchsorted(ranges.distinct, high, "right")) - (own <= high)
    whole = (n < 4) | (b <= a)
    a, b = np.where(whole, 0, a), np.where(whole, n, b)
    m = b - a
    top = np.where(m >= 15, np.maximum(1, np.floor(m * np.where(m >= 30, 0.12, 0.08))), 0).astype(np.int64)
    bottom = np.where(m >= 30, np.maximum(1, np.floor(m * 0.05)), 0).astype(np.int64)
    a, size = a + bottom, m - top - bottom
    at = [(size - 1) * p for p in (0.5, 0.4, 0.6)]
    found = kth(*[a + f(x).astype(np.int64) for x in at for f in (np.floor, np.ceil)])
    stats = [found[2 * i] + (found[2 * i + 1] - found[2 * i]) * (x - np.floor(x)) for i, x in enumerate(at)]
    sums = []
    for k in (a, a + size):
        past = k > before
        _, s, q = ranges.smallest(l, r, k + past)
        sums.append((s - np.where(past, own - ranges.middle, 0), q - np.where(past, (own - ranges.middle) ** 2, 0)))
    s, q = sums[1][0] - sums[0][0], sums[1][1] - sums[0][1]
    stdev = np.where(size < 2, 0.0, np.sqrt(np.maximum(0.0, q - s * s / size) / np.maximum(size - 1, 1)))
    for to, x in zip(out[1:], (size, *stats, stdev), strict=True):
        to[some] = x
    return tuple(out)


class Pool:
    """The prices of a key in order of size, ranked for each condition that targets have."""

    def __init__(self, rows: pa.Table):
        size, price, group, weight = (rows.column(c).to_numpy().astype(t) for c, t in (("size", float), ("price", float), ("group", int), ("weight", np.int64)))
        size = np.nan_to_num(size)  # those without a size are only in pools for any size
        order = np.argsort(size, kind="stable")
        self.size, self.price, self.group, self.weight = size[order], price[order], group[order], weight[order]
        self.ranked: dict[tuple[int, bool], tuple[np.ndarray, Ranges]] = {}

    def of(self, group: int, same: bool) -> tuple[np.ndarray, Ranges]:
        if (group, same) not in self.ranked:
            rows = np.flatnonzero(self.group == group) if same else np.arange(len(self.size))
            self.ranked[group, same] = self.size[rows], Ranges(self.price[rows] * FACTORS[self.group[rows], group], self.weight[rows])
        return self.ranked[group, same]

    def describe(self, group: int, same: bool, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        size, ranges = self.of(group, same)
        return described(ranges, np.searchsorted(size, low), np.searchsorted(size, high, "right"), own)


def answer(pool: Pool, asks: pa.RecordBatch, enough: int) -> pa.RecordBatch:
    """The asks with their statistics: of the band's prices of the same condition if these are
    enough, else of all."""
    group, own = asks.column("group").to_numpy(), asks.column("price").to_numpy()
    low, high = ends(asks)
    out = np.zeros((len(STATS), len(own)))
    for g in np.unique(group).tolist():
        rows = np.flatnonzero(group == g)
        found = np.array(pool.describe(g, False, low[rows], high[rows], own[rows]))
        n_any, n_same = found[0].copy(), np.zeros(len(rows))
        if GROUPS[g] != "unknown":
            alike = np.array(pool.describe(g, True, low[rows], high[rows], own[rows]))
            n_same = alike[0]
            found = np.where(n_same >= enough, alike, found)
        out[:, rows] = [n_same, n_any, *found]
    columns = [pa.array(x.astype(np.int32) if name.startswith("n_") else x) for name, x in zip(STATS, out, strict=True)]
    return pa.RecordBatch.from_arrays([*asks.columns, *columns], [*asks.schema.names, *STATS])


def bucket(sqm: Column) -> Column:
    return F.floor(F.ln(sqm) / math.log(BUCKET_BASE)).cast("int")


def group_code(name: Column) -> Column:
    return sc.lookup(name, {g: i for i, g in enumerate(GROUPS)}, len(GROUPS) - 1).cast("int")


def with_band(df: DataFrame, key: str) -> DataFrame:
    """Rows with a price, and their key, size, price and condition under names of our own."""
    size = F.when(F.col("sqm") > 0, F.col("sqm")).cast("double")
    group = group_code(F.col("cgroup")) if "cgroup" in df.columns else F.lit(0)
    return df.where("psqm > 0").withColumns({"__price": F.col("psqm").cast("double"), "__group": group, "__size": size, "__k": F.col(key)})


def pool_buckets() -> Column:
    """The buckets whose targets a pool row may serve."""
    size = F.col("__size")
    near = F.when(size.isNotNull(), F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: d + bucket(size))).otherwise(F.array().cast("array<int>"))
    return F.explode(F.concat(near, F.array(F.lit(ANY_SIZE))))


def target_columns() -> list[Column]:
    """Of a target: key, bucket, and the ends of its band, null for any size."""
    size = F.col("__size")
    low, high = sc.size_band(F.col("sqm"))
    return [F.col("__k"), F.coalesce(bucket(size), F.lit(ANY_SIZE)).alias("__bucket"), *[F.when(size.isNotNull(), x.cast("double")).alias(name) for name, x in (("low", low), ("high", high))]]


def ends(asks: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    low, high = (asks.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high"))
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def band_stats(targets: DataFrame, pool: DataFrame, key: str, enough: int | None, keep: list[str], most: int = MOST_ASKS) -> DataFrame:
    """(id, keep, n_same, n_any, n_raw, n_comps, median, p40, p60, stdev) for each target that has
    a price: the statistics of the prices of the pool's other listings of its key and in its band
    of sizes (any size if it has none), of the same condition if these are ``enough``.

    Both have id (unique), psqm, sqm, cgroup and the key; targets are listings of the pool and have
    ``keep``. Equal listings of a key go to the shuffle once, with their number. A target without a
    key, or without comparables, has zeros."""

    pool = with_band(pool, key).where("__k IS NOT NULL").groupBy("__k", "__size", "__group", "__price").agg(F.count("*").alias("weight"))
    pool = pool.select("__k", pool_buckets().alias("__bucket"), F.col("__size").alias("size"), F.col("__group").alias("group"), F.col("__price").alias("price"), "weight")
    asks = with_band(targets, key).select(*target_columns(), "id", *[c for c in keep if c != "id"], F.col("__price").alias("price"), F.col("__group").alias("group"))
    keyed = asks.where("__k IS NOT NULL")
    schema = StructType([*keyed.drop("__k", "__bucket").schema, *(StructField(name, IntegerType() if name.startswith("n_") else DoubleType()) for name in STATS)])
    found = meet(pool, keyed, ["__k", "__bucket"], Pool, lambda state, part: answer(state, part, NEVER if enough is None else enough), schema, most)
    bare = asks.where("__k IS NULL").drop("__k", "__bucket").withColumns({name: F.lit(0).cast("int" if name.startswith("n_") else "double") for name in STATS})
    return found.unionByName(bare).drop("price", "group", "low", "high")


class Around:
    """A key's listings for the nearest comparables: those with a place in order of latitude, the
    others, and all, in order of price."""

    def __init__(self, rows: pa.Table):
        columns = {c: rows.column(c).to_numpy().astype(float) for c in ("size", "price", "lat", "lng")}
        self.ids = rows.column("id").combine_chunks()
        self.names = np.argsort(pc.sort_indices(self.ids).to_numpy(), kind="stable")  # ids in an order of their own
        self.number = {v: i for i, v in enumerate(self.ids.to_pylist())}
        self.size, self.price, self.lat, self.lng = np.nan_to_num(columns["size"]), columns["price"], columns["lat"], columns["lng"]
        here = ~np.isnan(self.lat) & ~np.isnan(self.lng)
        at = np.flatnonzero(here)
        self.placed = at[np.argsort(self.lat[at], kind="stable")]
        self.lats = self.lat[self.placed]
        self.all = np.lexsort((self.names, self.price))
        self.bare = self.all[~here[self.all]]
        self.reach = 0.002

    def cheapest(self, order: np.ndarray, low: float, high: float, own: int, k: int) -> np.ndarray:
        found, at, step = [], 0, max(256, 4 * k)
        while at < len(order) and sum(map(len, found)) < k:
            part = order[at : at + step]
            found.append(part[(self.size[part] >= low) & (self.size[part] <= high) & (part != own)])
            at, step = at + step, 2 * step
        return np.concatenate(found)[:k] if found else np.zeros(0, np.int64)

    def nearest(self, lat: float, lng: float, low: float, high: float, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest with a place: a strip of latitudes widens until none outside can be nearer."""
        reach = self.reach
        while True:
            a, b = np.searchsorted(self.lats, lat - reach), np.searchsorted(self.lats, lat + reach, "right")
            rows = self.placed[a:b]
            rows = rows[(self.size[rows] >= low) & (self.size[rows] <= high) & (rows != own)]
            p, q = np.radians(lat), np.radians(self.lat[rows])
            x = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(self.lng[rows] - lng) / 2) ** 2
            far = np.round(2 * sc.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, x))), 3)
            whole = b - a == len(self.placed)
            if whole or len(far) >= k and np.partition(far, k - 1)[k - 1] < reach * 111_000:
                self.reach = max(1e-5, reach / 2)
                return rows, far
            reach *= 2

    def best(self, own: object, lat: float, lng: float, low: float, high: float, k: int) -> np.ndarray:
        me = self.number.get(own, -1)
        if np.isnan(lat) or np.isnan(lng):
            return self.cheapest(self.all, low, high, me, k)
        rows, far = self.nearest(lat, lng, low, high, me, k)
        bare = self.cheapest(self.bare, low, high, me, k)
        rows, value = np.concatenate([rows, bare]), np.concatenate([far, self.price[bare]])
        return rows[np.lexsort((self.names[rows], value))[:k]]


def top_comparables(targets: DataFrame, pool: DataFrame, key: str, k: int = 30, most: int = MOST_ASKS) -> DataFrame:
    """(id, comp_ids) for each priced target with a key: up to k other listings of the key in its band
    of sizes, the nearest first; where one of the two has no place, its price stands for the
    distance. Ties come by smaller id. Both have id (unique), psqm, sqm, lat, lng and the key. Pairs
    are looked at within tasks, k ids of a target leave them."""
    place = [F.col(c).cast("double").alias(c) for c in ("lat", "lng")]
    pool = with_band(pool, key).where("__k IS NOT NULL").select("__k", pool_buckets().alias("__bucket"), "id", F.col("__size").alias("size"), F.col("__price").alias("price"), *place)
    asks = with_band(targets, key).where("__k IS NOT NULL").select(*target_columns(), "id", *place)

    def answer(state: Around | None, part: pa.RecordBatch) -> pa.RecordBatch | None:
        if state is None:
            return None
        lat, lng = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lng"))
        found = [state.best(*row, k) for row in zip(part.column("id").to_pylist(), lat, lng, *ends(part), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)), state.ids.take(pa.array(np.concatenate(found).astype(np.int64))))
        out = pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "comp_ids"])
        return out.filter(pa.array([len(f) > 0 for f in found]))

    schema = StructType([asks.schema["id"], StructField("comp_ids", ArrayType(pool.schema["id"].dataType))])
    return meet(pool, asks, ["__k", "__bucket"], Around, answer, schema, most)
