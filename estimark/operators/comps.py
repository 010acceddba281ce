"""Comparable listings: candidate joins, the cascade of pools and robust statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import bands
from estimark.operators.meeting import settled
from estimark.settings import Settings

#: A band reaches from 3/4 to 5/4 of a size, less than one bucket to either side.
BUCKET_BASE = 1.35


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.floor(F.ln("sqm") / math.log(BUCKET_BASE)).cast("int"))


def candidate_pairs(targets: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with their comparables: same ``keys``, another id, a price, and a size in the
    target's band (any size if the target has none). Targets and pool have id, psqm, sqm,
    cgroup, lat, lng and the keys; the comparables' columns come back with the prefix c_."""
    pool = sized(pool.where("psqm > 0"))
    pool = pool.select(*[F.col(c).alias(f"c_{c}") for c in pool.columns])
    low, high = sc.size_band(F.col("sqm"))
    same = [F.col(k) == F.col(f"c_{k}") for k in keys]
    near = sized(targets.where("sqm > 0")).withColumn("bucket", F.explode(F.expr("sequence(bucket - 1, bucket + 1)")))
    banded = near.join(pool, [*same, F.col("bucket") == F.col("c_bucket")]).where((F.col("id") != F.col("c_id")) & F.col("c_sqm").between(low, high))
    if not keys:
        return banded.drop("bucket", "c_bucket")
    open_ = targets.where("coalesce(sqm, 0) <= 0").join(pool, same).where(F.col("id") != F.col("c_id"))
    return banded.drop("bucket", "c_bucket").unionByName(open_.drop("c_bucket"))


def pick(values: Column, at: Column) -> Column:
    return F.get(values, at.cast("int"))


def percentile(values: Column, p: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at)
    return pick(values, low) + (pick(values, F.ceil(at)) - pick(values, low)) * (at - low)


def deviation(values: Column, mean: Column) -> Column:
    """Sample standard deviation of an array with the given mean; 0 for fewer than two values."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(squares / F.greatest(F.size(values) - 1, F.lit(1))))


def robust(df: DataFrame, prices: str) -> DataFrame:
    """``df`` with median, p40, p60, n_comps, n_raw and stdev of an array of prices: without
    outliers (1.5 interquartile ranges, quartiles by position), then without the top 12 % and
    bottom 5 % (30 and more) or the top 8 % (15 and more).

    Each step is a column of its own, so nothing is sorted or looked up once an element."""
    columns = df.columns
    df = df.withColumn("s", F.array_sort(prices)).withColumn("n_raw", F.size("s"))
    df = df.withColumn("q1", pick(F.col("s"), F.floor(F.col("n_raw") / 4))).withColumn("q3", pick(F.col("s"), F.floor(F.col("n_raw") * 3 / 4)))
    df = df.withColumns({"low": F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5, "high": F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5})
    df = df.withColumn("inner", F.when(F.col("n_raw") >= 4, F.filter("s", lambda v: (v >= F.col("low")) & (v <= F.col("high")))).otherwise(F.col("s")))
    df = df.withColumn("inner", F.when(F.size("inner") == 0, F.col("s")).otherwise(F.col("inner"))).withColumn("m", F.size("inner"))
    m = F.col("m")
    top = F.when(m >= 15, F.greatest(F.lit(1), F.floor(m * F.when(m >= 30, 0.12).otherwise(0.08)).cast("int"))).otherwise(0)
    bottom = F.when(m >= 30, F.greatest(F.lit(1), F.floor(m * 0.05).cast("int"))).otherwise(0)
    df = df.withColumns({"top": top, "bottom": bottom})
    df = df.withColumn("kept", F.slice("inner", F.col("bottom") + 1, m - F.col("top") - F.col("bottom")))
    kept = F.col("kept")
    df = df.withColumn("mean", F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0)))
    stats = [percentile(kept, p).alias(name) for name, p in (("median", 0.5), ("p40", 0.4), ("p60", 0.6))]
    return df.select(*columns, "n_raw", *stats, F.size(kept).alias("n_comps"), deviation(kept, F.col("mean")).alias("stdev"))


#: The least reach in metres of targets with radii of their own; each further reach is twice the one before.
LEAST_REACH = 250


def radius_pairs(targets: DataFrame, pool: DataFrame, radius_m: int | str, key: str = "id") -> DataFrame:
    """Pairs of points at most ``radius_m`` apart, by an equi-join on grid cells and their
    neighbours. Points are (key, lat, lng); the partner's columns have the prefix c_. A name for
    ``radius_m`` is a column of the targets with each one's own radius; the pool is then laid out in a
    grid for each doubling of the reach (the number of which comes from the largest radius), and a target
    looks into that of its own."""
    if isinstance(radius_m, str):
        most = targets.agg(F.max(radius_m)).first()[0] or LEAST_REACH
        doublings = lambda m: F.greatest(F.lit(0), F.ceil(F.log2(m / LEAST_REACH) - 1e-9)).cast("int")
        last = max(0, math.ceil(math.log2(max(most, 1) / LEAST_REACH) - 1e-9))
        targets = targets.where(F.col(radius_m) >= 0).withColumn("reach_no", doublings(F.greatest(F.col(radius_m).cast("double"), F.lit(1.0))))
        pool = pool.withColumn("reach_no", F.explode(F.sequence(F.lit(0), F.lit(last))))
        out = cell_pairs(targets, pool, F.pow(F.lit(2.0), F.col("reach_no")) * (LEAST_REACH / 111_000.0), F.col(radius_m), key, ["reach_no"])
        return out.drop("reach_no", "c_reach_no")
    return cell_pairs(targets, pool, F.lit(radius_m / 111_000.0), F.lit(radius_m), key, [])


def radius_counts(points: DataFrame, radius_m: int, key: str = "id") -> DataFrame:
    """(key, n, nearest_m): how many rows of other keys lie at most ``radius_m`` from the rows of each
    key, which has one place, and how far the nearest is; keys without any are left out. Rows of
    one place are counted before pairs are made, so pairs are of places, not of rows."""
    own = points.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy(key, "lat", "lng").agg(F.count("*").alias("own"))
    places = own.groupBy("lat", "lng").agg(F.sum("own").alias("held"))
    pairs = radius_pairs(places.withColumn("side", F.lit(0)), places.withColumn("side", F.lit(1)), radius_m, "side")
    elsewhere = (F.col("lat") != F.col("c_lat")) | (F.col("lng") != F.col("c_lng"))
    around = pairs.groupBy("lat", "lng").agg(F.sum("c_held").alias("around"), F.max("held").alias("held"), F.min(F.when(elsewhere, F.col("distance_m"))).alias("next_m"))
    met = own.join(around, ["lat", "lng"]).where("around > own")
    return met.select(key, (F.col("own") * (F.col("around") - F.col("own"))).alias("n"), F.when(F.col("held") > F.col("own"), 0.0).otherwise(F.col("next_m")).alias("nearest_m"))


def cell_pairs(targets: DataFrame, pool: DataFrame, cell: Column, radius: Column, key: str, same: list[str]) -> DataFrame:
    """The pairs of ``radius_pairs`` with equal columns ``same``; ``cell`` is the height of a cell
    in degrees, no less than the radius, by columns that both have."""
    # a band of latitude has cells as wide as the radius at its edge nearer to the pole; next to a pole it is one cell
    band_edge = lambda gy: F.greatest(F.abs(gy * cell), F.abs((gy + 1) * cell))
    wide = lambda gy: F.least(F.lit(360.0), cell / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), band_edge(gy)))), F.lit(1e-6)))
    known = lambda df: df.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("gy", F.floor(F.col("lat") / cell)).withColumn("east", F.pmod(F.col("lng") + 180, F.lit(360.0)))
    pool = known(pool).withColumn("gx", F.floor(F.col("east") / wide(F.col("gy"))).cast("long")).drop("east")
    pool = pool.select(*[F.col(c).alias(f"c_{c}") for c in pool.columns])
    near = known(targets).withColumn("dy", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("gy", F.col("gy") + F.col("dy"))
    w, e = wide(F.col("gy")), F.col("east")
    # no point within the radius lies further east or west than this
    reach = cell / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs("lat") + cell, band_edge(F.col("gy")))))), F.lit(1e-6)) * 1.01
    span = lambda low, high: F.sequence(F.floor(low / w).cast("long"), F.floor(high / w).cast("long"))
    none = F.array().cast("array<bigint>")
    around = F.when(reach >= 180, span(F.lit(0.0), F.lit(360.0))).otherwise(F.array_distinct(F.concat(
        span(F.greatest(e - reach, F.lit(0.0)), F.least(e + reach, F.lit(360.0))), F.when(e + reach >= 360, span(F.lit(0.0), e + reach - 360)).otherwise(none), F.when(e - reach < 0, span(e - reach + 360, F.lit(360.0))).otherwise(none))))
    near = near.withColumn("gx", F.explode(around)).drop("east")
    pairs = near.join(pool, [F.col(c) == F.col(f"c_{c}") for c in ("gy", "gx", *same)])
    distance = sc.haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    return pairs.withColumn("distance_m", F.round(distance, 3)).where((F.col("distance_m") <= radius) & (F.col(key) != F.col(f"c_{key}"))).drop("gy", "gx", "dy", "c_gy", "c_gx")


def cascade(listings: DataFrame, s: Settings, sale: bool = False) -> DataFrame:
    """One row a listing with its benchmark: the first pool that is large enough of same zone
    and condition, same zone, 800 m and same fascia, same fascia, growing radii, same zone.

    listings: id, psqm, sqm, condition, zone, fascia, lat, lng, omi_mid. Pools of zones and fascias
    give their statistics without rows for pairs (``bands``); pairs are made within radii only, for
    listings that no larger pool has settled."""
    base = listings.withColumn("cgroup", sc.condition_group(F.col("condition"))).select("id", "psqm", "sqm", "cgroup", "zone", "fascia", "lat", "lng", "omi_mid")
    pool = base.drop("omi_mid").where("psqm > 0")
    keep = ["psqm", "sqm", "cgroup", "zone", "fascia", "lat", "lng"]
    stats = ["n_raw", "n_comps", "median", "p40", "p60", "stdev"]
    adjusted = F.when(F.col("cgroup") == "unknown", F.col("c_psqm")).otherwise(F.col("c_psqm") * sc.condition_factor(F.col("c_cgroup"), F.col("cgroup")))
    low, high = sc.size_band(F.col("sqm"))
    fits = (F.coalesce("sqm", F.lit(0)) <= 0) | F.col("c_sqm").between(low, high)
    enough = lambda c: F.coalesce(F.size(c), F.lit(0)) >= s.min_comps

    first = bands.band_stats(base, base, "zone", s.enough_comps, keep)
    first = settled(first.withColumn("source", F.when(F.col("n_same") >= s.enough_comps, "zone_stratified").when(F.col("n_any") >= s.enough_comps, "zone_any_condition")))
    open_ = first.where("source IS NULL").select("id", *keep, F.struct("n_any", *stats).alias("of_zone"))
    around = radius_pairs(open_.drop("of_zone"), pool, 800).where(fits & (F.col("fascia") == F.col("c_fascia")))
    near = settled(robust(around.groupBy("id").agg(F.collect_list(adjusted).alias("prices")).where(enough("prices")), "prices"))
    open_ = open_.join(near.select("id"), "id", "left_anti")
    second = settled(bands.band_stats(open_, pool, "fascia", None, [*keep, "of_zone"]))
    open_ = second.where(F.col("n_any") < s.min_comps).select("id", *keep, "of_zone")
    around = radius_pairs(open_.drop("of_zone"), pool, max(s.radii)).where(fits)
    rings = around.groupBy("id").agg(*[F.collect_list(F.when(F.col("distance_m") <= r, adjusted)).alias(f"r{r}") for r in s.radii])
    source, prices = F, F
    for r in s.radii:
        source, prices = source.when(enough(f"r{r}"), f"comps_{r}"), prices.when(enough(f"r{r}"), F.col(f"r{r}"))
    third = robust(rings.select("id", source.alias("source"), prices.alias("prices")).where("source IS NOT NULL"), "prices")
    third = open_.select("id", "of_zone").join(third, "id", "left").select("id", F.coalesce("source", F.when(F.col("of_zone.n_any") >= s.min_comps, "omi_zone")).alias("source"), *[F.coalesce(c, f"of_zone.{c}").alias(c) for c in stats])
    out = first.where("source IS NOT NULL").select("id", "source", *stats).unionByName(near.select("id", F.lit("radius_800m_same_fascia").alias("source"), *stats))
    out = out.unionByName(second.where(F.col("n_any") >= s.min_comps).select("id", F.lit("fascia_fallback").alias("source"), *stats)).unionByName(third.where("source IS NOT NULL"))
    out = base.select("id", F.col("psqm").alias("ask"), F.col("cgroup").alias("condition_group"), F.col("omi_mid").alias("omi")).join(out, "id", "left")
    has = F.col("source").isNotNull()
    zone_pool = F.col("source") == "zone_stratified"
    confidence = (
        F.when(F.col("n_comps") >= 40, 40).when(F.col("n_comps") >= 20, 20).otherwise(0) + F.when(zone_pool, 40).when(F.col("source").contains("zone"), 10).otherwise(0)
        + F.when(F.col("stdev") < (1500 if sale else 3.0), 20).otherwise(0)
    )
    out = out.withColumn("confidence", F.when(has, F.least(F.lit(100), confidence)))
    mixed = sc.blend_sale(F.col("median"), F.col("omi"), F.col("n_comps"), F.col("confidence")) if sale else sc.blend(F.col("median"), F.col("omi"), F.col("confidence"))
    only = ~has & (sc.zero("omi") > 0) & (sc.zero("ask") > 0)
    blended = F.when(has, mixed).when(only, F.col("omi"))
    return out.select(
        "id", "condition_group", F.coalesce("source", F.when(only, "omi_only").otherwise("none")).alias("benchmark_source"),
        *[sc.exactly(F.when(only, F.col("omi")).otherwise(F.col(c)), 2).alias(c) for c in ("median", "p40", "p60")],
        sc.exactly(blended, 2).alias("blended_median"), sc.exactly((F.col("ask") - blended) / F.nullif(blended, F.lit(0)), 4).alias("delta_pct"),
        F.coalesce("confidence", F.when(only, 15).otherwise(0)).alias("confidence"), sc.zero("n_comps").alias("n_comps"), sc.zero("n_raw").alias("n_raw"),
    )
