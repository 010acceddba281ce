"""Joins by place: nearest points, polygons, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estimark.functions import scalars as sc


def nearest(targets: DataFrame, points: DataFrame, group: list[str], cell_deg: float = 0.02, factor: int = 4) -> DataFrame:
    """For each target (id, lat, lng, group) the nearest point (point_id, lat, lng, group) of its
    group, ties to the smaller point_id; distance in whole metres.

    Points stand in a pyramid of cells, each with the box around its points. A target begins with
    its group's cells of the coarsest level, of which there are four at most, and goes down level by
    level: cells that lie surely further away than the best cell's far corner go. Only the points
    of what is left on the finest level are measured, so a target far from all points costs no
    more than one among them."""
    points = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(*[F.col(g).alias(f"p_{g}") for g in group], "point_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    low_lat, high_lat, low_lng, high_lng = points.agg(F.min("p_lat"), F.max("p_lat"), F.min("p_lng"), F.max("p_lng")).first()
    levels = 0
    while low_lat is not None and cell_deg * factor**levels < max(high_lat - low_lat, high_lng - low_lng):
        levels += 1
    same = [F.col(g) == F.col(f"p_{g}") for g in group]
    keys = [f"p_{g}" for g in group]
    points = points.withColumns({"p_y": F.floor(F.col("p_lat") / cell_deg), "p_x": F.floor(F.col("p_lng") / cell_deg)})
    box = [f(c).alias(n) for c, names in (("p_lat", ("south", "north")), ("p_lng", ("west", "east"))) for f, n in zip((F.min, F.max), names, strict=True)]
    pyramid = [points.groupBy(*keys, "p_y", "p_x").agg(*box)]
    wider = [f(n).alias(n) for f, n in ((F.min, "south"), (F.max, "north"), (F.min, "west"), (F.max, "east"))]
    for _ in range(levels):
        pyramid.append(pyramid[-1].groupBy(*keys, F.floor(F.col("p_y") / factor).alias("p_y"), F.floor(F.col("p_x") / factor).alias("p_x")).agg(*wider))
    found = targets.where("lat IS NOT NULL AND lng IS NOT NULL").select(list(dict.fromkeys(["id", "lat", "lng", *group])))
    columns = found.columns
    for level in range(levels, -1, -1):
        cells = pyramid[level]
        if level == levels:
            met = found.join(cells, same)
        else:
            up = cells.withColumns({"up_y": F.floor(F.col("p_y") / factor), "up_x": F.floor(F.col("p_x") / factor)})
            met = found.join(up, [*same, F.col("y") == F.col("up_y"), F.col("x") == F.col("up_x")])
        near, far = box_distance_m(F.col("lat"), F.col("lng"), F.col("south"), F.col("north"), F.col("west"), F.col("east"))
        met = met.select(*columns, F.col("p_y").alias("y"), F.col("p_x").alias("x"), near.alias("near"), far.alias("far"))
        # distances are compared in whole metres, so a point up to a metre further away may still win
        least = F.min("far").over(Window.partitionBy("id"))
        found = met.withColumn("least", least).where(F.col("near") <= F.col("least") + 1).select(*columns, "y", "x")
    distance = sc.haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    met = found.join(points, [*same, F.col("y") == F.col("p_y"), F.col("x") == F.col("p_x")])
    best = met.groupBy("id").agg(F.min(F.struct(F.round(distance, 0).cast("long").alias("distance_m"), "point_id")).alias("best"))
    return best.select("id", "best.point_id", "best.distance_m")


def box_distance_m(lat: Column, lng: Column, south: Column, north: Column, west: Column, east: Column) -> tuple[Column, Column]:
    """Bounds of the distance from a place to the points of a box: none is nearer than the first or
    further than the second."""
    around = lambda x: F.least(x, F.lit(360.0) - x)
    zero = F.lit(0.0)
    up = F.greatest(zero, south - lat, lat - north)
    across = F.when(lng.between(west, east), zero).otherwise(F.least(around(F.abs(lng - west)), around(F.abs(lng - east))))
    up_most = F.greatest(F.abs(lat - south), F.abs(lat - north))
    # the farthest meridian is an edge of the box, or the one on the other side of the earth
    beyond = F.pmod(lng, F.lit(360.0)) - 180
    across_most = F.when(beyond.between(west, east) | (beyond + 360).between(west, east), F.lit(180.0)).otherwise(F.greatest(around(F.abs(lng - west)), around(F.abs(lng - east))))
    edges = F.cos(F.radians(south)), F.cos(F.radians(north))
    narrow, wide = F.least(*edges), F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(*edges))

    def metres(up: Column, across: Column, shrink: Column) -> Column:
        a = F.pow(F.sin(F.radians(up) / 2), 2) + F.cos(F.radians(lat)) * shrink * F.pow(F.sin(F.radians(across) / 2), 2)
        return 2 * sc.EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(zero, a))))

    slack = 1e-9
    return metres(up, across, narrow) * (1 - slack), metres(up_most, across_most, wide) * (1 + slack)


#: Degrees that an edge is widened by, so that rounding never moves a point past it.
HAIR = 1e-9


def crossed(lat: Column, lng: Column, edge: Column) -> Column:
    """Whether a line eastwards from the place crosses the edge (x1, y1, x2, y2)."""
    return ((edge["y1"] > lat) != (edge["y2"] > lat)) & (lng < (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0)) + edge["x1"])


def held(lat: Column, lng: Column, edges: Column) -> Column:
    """Whether edges (p, r, x1, y1, x2, y2) of rings r (0: outer, others: holes) of polygons p hold
    the place: within an outer ring and in none of its holes."""
    rings = F.array_distinct(F.transform(edges, lambda e: F.struct(e["p"].alias("p"), e["r"].alias("r"))))
    odd = lambda ring: F.size(F.filter(edges, lambda e: (e["p"] == ring["p"]) & (e["r"] == ring["r"]) & F.coalesce(crossed(lat, lng, e), F.lit(False)))) % 2 == 1
    around = F.filter(rings, odd)
    return F.exists(around, lambda a: (a["r"] == 0) & ~F.exists(around, lambda b: (b["p"] == a["p"]) & (b["r"] > 0)))


def covering(zones: DataFrame, cell_deg: float) -> DataFrame:
    """(city, zona, ord, y, x, edges): the cells that hold some of a zone. Cells wholly inside have
    null edges; cells that an edge runs through have the edges of their row, all that decides there.

    zones: city, zona, ord, polygons array<array<array<array<double>>>>. Rows of cells come from
    edges, and cells from rows; nothing holds a whole polygon after the first step."""
    keys = ["city", "zona", "ord"]
    ring = zones.select(*keys, F.posexplode("polygons").alias("p", "polygon")).select(*keys, "p", F.posexplode("polygon").alias("r", "ring"))
    after = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    pairs = F.explode(F.zip_with("ring", after, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))))
    edge = ring.select(*keys, "p", "r", pairs.alias("e")).select(*keys, F.struct("p", "r", "e.*").alias("e"))
    cell = lambda x: F.floor(x / cell_deg)
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    rowed = edge.withColumn("y", F.explode(F.sequence(cell(low - HAIR), cell(high + HAIR))))
    rows = rowed.groupBy(*keys, "y").agg(F.collect_list("e").alias("edges"), F.min(F.least("e.x1", "e.x2")).alias("west"), F.max(F.greatest("e.x1", "e.x2")).alias("east"))
    # the part of the edge within the row
    slope = (F.col("e.x2") - F.col("e.x1")) / F.nullif(F.col("e.y2") - F.col("e.y1"), F.lit(0.0))
    at = lambda y: F.least(F.greatest(F.col("e.x1") + (F.least(F.greatest(y, low), high) - F.col("e.y1")) * slope, F.least("e.x1", "e.x2")), F.greatest("e.x1", "e.x2"))
    ends = F.coalesce(at(F.col("y") * cell_deg - HAIR), F.col("e.x1")), F.coalesce(at((F.col("y") + 1) * cell_deg + HAIR), F.col("e.x2"))
    cut = rowed.select(*keys, "y", F.explode(F.sequence(cell(F.least(*ends) - HAIR), cell(F.greatest(*ends) + HAIR))).alias("x")).distinct()
    every = rows.withColumn("x", F.explode(F.sequence(cell(F.col("west")), cell(F.col("east")))))
    both = every.join(cut.withColumn("cut", F.lit(True)), [*keys, "y", "x"], "left")
    centre = held((F.col("y") + 0.5) * cell_deg, (F.col("x") + 0.5) * cell_deg, F.col("edges"))
    return both.where(F.col("cut") | centre).select(*keys, "y", "x", F.when(F.col("cut"), F.col("edges")).alias("edges"))


def polygon_lookup(points: DataFrame, zones: DataFrame, centroid_fallback: bool = True, cell_deg: float = 0.01) -> DataFrame:
    """(id, zona, how) for points (id, lat, lng, city): the first zone in order whose polygons
    (rings after the first are holes) hold the point, else the one with the nearest centre.

    Points meet the zones' covering (see there) by city and cell. A cell inside a zone answers by
    itself; in a cell that an edge runs through, the edges of that row of cells are tested. The
    fallback compares a point with its city's centres, held in one array a city."""
    cells = covering(zones, cell_deg).withColumnsRenamed({"city": "z_city", "y": "z_y", "x": "z_x"})
    lat, lng = F.col("lat"), F.col("lng")
    placed = points.where("lat IS NOT NULL AND lng IS NOT NULL").select("id", "lat", "lng", "city", F.floor(lat / cell_deg).alias("__y"), F.floor(lng / cell_deg).alias("__x"))
    met = placed.join(cells, (F.col("city") == F.col("z_city")) & (F.col("__y") == F.col("z_y")) & (F.col("__x") == F.col("z_x")))
    hit = met.where(F.col("edges").isNull() | held(lat, lng, F.col("edges"))).groupBy("id").agg(F.min(F.struct("ord", "zona")).alias("z"))
    hit = hit.select("id", "z.zona", F.lit("polygon").alias("how"))
    if not centroid_fallback:
        return hit
    outer = F.flatten(F.transform("polygons", lambda p: p[0]))
    middle = lambda i: (F.array_min(F.transform(outer, lambda p: p[i])) + F.array_max(F.transform(outer, lambda p: p[i]))) / 2
    centres = zones.select("city", "zona", "ord", middle(0).alias("cx"), middle(1).alias("cy")).groupBy(F.col("city").alias("z_city")).agg(F.collect_list(F.struct("cx", "cy", "ord", "zona")).alias("centres"))
    rest = placed.join(hit, "id", "left_anti").join(centres, F.col("city") == F.col("z_city"))
    far = lambda c: F.struct(F.round(F.pow(lng - c["cx"], 2) + F.pow(lat - c["cy"], 2), 12).alias("d"), c["ord"].alias("ord"), c["zona"].alias("zona"))
    return hit.unionByName(rest.select("id", F.array_min(F.transform("centres", far))["zona"].alias("zona"), F.lit("centroid").alias("how")))


def outside_box(lat: Column, lng: Column, city: Column, boxes: dict[str, tuple]) -> Column:
    """True if the coordinates are known and lie outside the city's box."""
    out = F
    for name, (south, north, west, east) in boxes.items():
        out = out.when(F.lower(city) == name, ~(lat.between(south, north) & lng.between(west, east)))
    return F.coalesce(out.otherwise(False) & (sc.zero(lat) != 0) & (sc.zero(lng) != 0), F.lit(False))
