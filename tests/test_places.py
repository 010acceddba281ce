"""Pyramids, coverings and bands against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import bands, comps, geo


def metres(a, b):
    (la, lo), (lb, lp) = a, b
    x = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, x)))


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_by_brute_force(spark, seed):
    rng = random.Random(seed)
    anywhere = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180))
    town = lambda: (45.4 + rng.uniform(0, 0.1), 9.1 + rng.uniform(0, 0.1))
    spots = [town() for _ in range(150)] + [anywhere() for _ in range(40)] + [(0.0, 179.999), (0.0, -179.999), (89.9, 10.0), (-90.0, 0.0)]
    spots += spots[:3]  # ties: equal places under other ids
    points = [(k, lat, lng, "ab"[k % 2]) for k, (lat, lng) in enumerate(spots)]
    asks = [(k, lat, lng, "ab"[k % 3 % 2]) for k, (lat, lng) in enumerate([town() for _ in range(40)] + [anywhere() for _ in range(40)] + [(0.0, 180.0), (0.0, -180.0), (90.0, 50.0), *spots[:4]])]
    asks += [(900, None, 9.0, "a"), (901, 45.0, 9.0, "c")]
    targets = spark.createDataFrame(asks, "id long, lat double, lng double, kind string")
    got = {r["id"]: (r["distance_m"], r["point_id"]) for r in geo.nearest(targets, spark.createDataFrame(points, "point_id long, lat double, lng double, kind string"), ["kind"]).collect()}
    want = {}
    for i, lat, lng, kind in asks:
        near = [(round(metres((lat, lng), (p[1], p[2]))), p[0]) for p in points if p[3] == kind] if lat is not None else []
        if near:
            want[i] = min(near)
    assert got == want


def test_box_bounds_hold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        south, west = rng.uniform(-90, 80), rng.uniform(-180, 170)
        north, east = south + rng.uniform(0, 90 - south) * rng.random() ** 3, west + rng.uniform(0, 180 - west) * rng.random() ** 2
        rows.append((rng.uniform(-90, 90), rng.uniform(-180, 180), south, north, west, east, rng.uniform(south, north), rng.uniform(west, east)))
    df = spark.createDataFrame(rows, "lat double, lng double, s double, n double, w double, e double, y double, x double")
    near, far = geo.box_distance_m(*[F.col(c) for c in ("lat", "lng", "s", "n", "w", "e")])
    d = sc.haversine_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x"))
    assert df.where((d < near - 1e-3) | (d > far + 1e-3)).count() == 0


def odd(lat, lng, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def star(rng, x, y, size, n):
    return [[x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]


@pytest.mark.parametrize("cell", [0.01, 0.05, 0.5])
def test_coverings_by_brute_force(spark, cell):
    """Stars with holes and several polygons, rectangles on the grid's own lines, points on edges."""
    rng = random.Random(int(cell * 100))
    zones = [("m", f"S{k}", k, [[star(rng, 9 + rng.uniform(0, 0.3), 45 + rng.uniform(0, 0.3), 0.12, rng.randint(3, 25)), star(rng, 9.15, 45.15, 0.02, 5)], [star(rng, 9.6, 45.6, 0.03, 6)]]) for k in range(5)]
    zones.append(("m", "R", 9, [[[[9.3, 45.3], [9.4, 45.3], [9.4, 45.4], [9.3, 45.4]], [[9.32, 45.32], [9.35, 45.32], [9.35, 45.35], [9.32, 45.35]]]]))
    zones.append(("n", "N", 0, [[[[-0.02, -0.02], [0.03, -0.01], [0.0, 0.04]]]]))
    points = [(k, 44.85 + rng.uniform(0, 0.85), 8.85 + rng.uniform(0, 0.85), "m") for k in range(1500)]
    points += [(2000 + k, 45.3 + (k % 12) / 100, 9.3 + k // 12 / 100, "m") for k in range(144)] + [(3000 + k, rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05), "n") for k in range(200)] + [(4000, 45.3, 9.3, "x"), (4001, None, None, "m")]
    want = {}
    for i, lat, lng, city in points:
        for c, zona, ord_, polygons in sorted(zones, key=lambda z: z[2]):
            if lat is not None and c == city and any(odd(lat, lng, p[0]) and not any(odd(lat, lng, hole) for hole in p[1:]) for p in polygons):
                want[i] = zona
                break
    z = spark.createDataFrame(zones, "city string, zona string, ord int, polygons array<array<array<array<double>>>>")
    df = spark.createDataFrame(points, "id long, lat double, lng double, city string")
    got = {r["id"]: r["zona"] for r in geo.polygon_lookup(df, z, centroid_fallback=False, cell_deg=cell).collect()}
    assert got == want and len(want) > 200
    if cell < 0.05:
        assert geo.covering(z, cell).where("edges IS NULL").count() > 100
    how = geo.polygon_lookup(df, z, cell_deg=cell).groupBy("how").count().collect()
    assert {r["how"]: r["count"] for r in how} == {"polygon": len(want), "centroid": len([p for p in points if p[1] is not None and p[3] != "x"]) - len(want)}


def test_bands_equal_arrays(spark):
    """Statistics from wavelet trees against those of the collected arrays, with salted targets."""
    rng = np.random.default_rng(3)
    n = 700
    sizes = [None if rng.random() < 0.05 else int(s) for s in rng.integers(20, 140, n)]
    rows = [(k, float(np.round(rng.gamma(9, 2), int(rng.integers(0, 3)))), sizes[k], ["premium", "standard", "needs_work", "unknown"][rng.integers(0, 4)], ["hot", "hot", "b", None][rng.integers(0, 4)] if k else "alone") for k in range(n)]
    rows += [(n, None, 50, "premium", "hot"), (n + 1, 0.0, 50, "premium", "hot")]
    df = spark.createDataFrame(rows, "id long, psqm double, sqm int, cgroup string, zone string")
    pool = df.withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})
    pairs = comps.candidate_pairs(pool.where("psqm > 0"), pool, ["zone"])
    adjusted = F.when(F.col("cgroup") == "unknown", F.col("c_psqm")).otherwise(F.col("c_psqm") * sc.condition_factor(F.col("c_cgroup"), F.col("cgroup")))
    lists = pairs.groupBy("id", "cgroup").agg(F.collect_list(adjusted).alias("any"), F.collect_list(F.when(F.col("cgroup") == F.col("c_cgroup"), F.col("c_psqm"))).alias("same"))
    lists = lists.withColumn("same", F.when(F.col("cgroup") == "unknown", F.array().cast("array<double>")).otherwise(F.col("same")))
    want = {r["id"]: r for r in comps.robust(lists.withColumn("prices", F.when(F.size("same") >= 15, F.col("same")).otherwise(F.col("any"))), "prices").collect()}
    got = bands.band_stats(df, df, "zone", 15, ["cgroup"], most=40).collect()
    assert len(got) == n and len(want) > 400
    for r in got:
        w = want.get(r["id"])
        if w is None:
            assert r["n_raw"] == r["n_any"] == 0
            continue
        assert (r["n_same"], r["n_any"], r["n_raw"], r["n_comps"]) == (len(w["same"]), len(w["any"]), w["n_raw"], w["n_comps"]), r
        assert all(math.isclose(r[c], w[c], rel_tol=1e-9, abs_tol=1e-7) for c in ("median", "p40", "p60", "stdev")), (r, w)
    assert bands.band_stats(df.where("false"), df.where("false"), "zone", 15, []).count() == 0


def test_ranges_without_kept_levels(monkeypatch):
    rng = np.random.default_rng(1)
    values, weights = rng.integers(0, 9, 60).astype(float), rng.integers(1, 4, 60)
    monkeypatch.setattr(bands, "KEPT_LEVELS", 0)
    tree = bands.Ranges(values, weights)
    for l in range(0, 60, 7):
        for r in range(l + 1, 60, 5):
            flat = np.sort(np.repeat(values[l:r], weights[l:r]))
            k = np.arange(len(flat))
            value, s, q = tree.smallest(np.full(len(k), l), np.full(len(k), r), k)
            assert (value == flat).all()
            c = flat - tree.middle
            assert np.allclose(s, np.concatenate([[0], np.cumsum(c)[:-1]])) and np.allclose(q, np.concatenate([[0], np.cumsum(c * c)[:-1]]))
            for limit in range(len(tree.distinct) + 1):
                top = tree.distinct[limit] if limit < len(tree.distinct) else np.inf
                assert tree.below(np.array([l]), np.array([r]), np.array([limit]))[0] == (flat < top).sum()


def test_radii_of_ones_own(spark):
    """Targets with radii from nothing to half the earth, against all pairs."""
    rng = random.Random(9)
    places = [(rng.uniform(45, 45.3), rng.uniform(9, 9.4)) for _ in range(60)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(25)] + [(0.0, 179.99), (0.0, -179.99)]
    targets = spark.createDataFrame([(k, y, x, rng.choice([0, 50, 249, 250, 251, 3000, 40_000, 500_000, 9_000_000, 21_000_000])) for k, (y, x) in enumerate(places)], "id long, lat double, lng double, radius int")
    pool = spark.createDataFrame([(k + 1000, y, x) for k, (y, x) in enumerate(places)], "id long, lat double, lng double")
    d = sc.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    want = targets.alias("a").join(pool.alias("b"), F.round(d, 3) <= F.col("a.radius")).select("a.id", "b.id").collect()
    got = [(r["id"], r["c_id"]) for r in comps.radius_pairs(targets, pool, "radius").collect()]
    assert sorted(got) == sorted((r[0], r[1]) for r in want) and len(got) == len(set(got))
