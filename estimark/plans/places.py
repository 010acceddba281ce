"""Queries on places: distances, nearest points, polygons, boxes, zone lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark import settings as st
from estimark.functions import scalars as sc
from estimark.operators import comps, geo, lookup
from estimark.plans.listings import SQL, listings
from estimark.plans.scores import HAVERSINE


def points(spark, sf_dir, table, key):
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    k = F.col(key)
    return df.select(k.alias("id"), F.col(f"{key[0]}_nationkey").alias("kind"), (45.38 + (k * 7919 % 1600).cast("double") / 10000).alias("lat"), (9.04 + (k * 104729 % 2400).cast("double") / 10000).alias("lng"))


POINTS = ", ".join(f"{t} AS (SELECT {t[0]}_{k} AS id, {t[0]}_nationkey AS kind, 45.38::DOUBLE + CAST({t[0]}_{k} * 7919 % 1600 AS DOUBLE) / 10000 AS lat, 9.04::DOUBLE + CAST({t[0]}_{k} * 104729 % 2400 AS DOUBLE) / 10000 AS lng FROM main.{t})" for t, k in (("supplier", "suppkey"), ("customer", "custkey"))).replace("supplier AS (", "sup AS (").replace("customer AS (", "cus AS (")
ZONES = [
    ("Z1", 0, [[[[9.05, 45.39], [9.12, 45.39], [9.12, 45.45], [9.05, 45.45]], [[9.07, 45.40], [9.09, 45.40], [9.09, 45.42], [9.07, 45.42]]]]),
    ("Z2", 1, [[[[9.10, 45.42], [9.20, 45.44], [9.16, 45.52], [9.08, 45.50]]]]),
    ("Z3", 2, [[[[9.20, 45.39], [9.26, 45.39], [9.23, 45.46]]], [[[9.21, 45.48], [9.25, 45.48], [9.25, 45.53], [9.21, 45.53]]]]),
]


def radius_join_counts(spark, sf_dir):
    """Suppliers within 2500 m of each supplier, by grid cells."""
    return comps.radius_counts(points(spark, sf_dir, "supplier", "s_suppkey"), 2500)


def nearest_poi(spark, sf_dir):
    """The nearest supplier of the customer's own nation."""
    sup = points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("id", "point_id")
    return geo.nearest(points(spark, sf_dir, "customer", "c_custkey"), sup, ["kind"])


def point_in_polygon(spark, sf_dir):
    zones = spark.createDataFrame([("milano", *z) for z in ZONES], "city string, zona string, ord long, polygons array<array<array<array<double>>>>")
    return geo.polygon_lookup(points(spark, sf_dir, "customer", "c_custkey").withColumn("city", F.when(F.col("kind") >= 0, "milano")), zones)


def outside_city(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.select("id", geo.outside_box(F.col("lat"), F.col("lng"), F.col("city"), st.CITY_BOXES).alias("is_outside"))


def geo_scores(spark, sf_dir):
    k = F.col("id")
    df = listings(spark, sf_dir).select("id", *[F.when(k % 13 == n, None).otherwise((k * m % top).cast("int")).alias(c) for n, (c, m, top) in enumerate([("metro_m", 37, 2500), ("tram_m", 53, 1300), ("supermarket_m", 71, 1300), ("park_m", 29, 1900), ("university_m", 43, 1900)])])
    return df.select("id", sc.geo_score().alias("geo_score"), F.bround(F.col("metro_m") / 60, 0).cast("int").alias("metro_walk_min"))


def nearest_bucket_counts(spark, sf_dir):
    """How many customers have their nearest supplier of the nation within each kilometre."""
    return nearest_poi(spark, sf_dir).groupBy(F.floor(F.col("distance_m") / 1000).alias("km")).agg(F.count("*").alias("n"))


KEYWORDS = [("th", 0, "K0"), ("the", 1, "K1"), ("ation", 2, "K2"), ("licen", 3, "K3"), ("ion", 4, "K4"), ("ung", 5, "K5"), ("que", 6, "K6")]


def keyword_zone_lookup(spark, sf_dir):
    """Documents' texts looked up as neighbourhood names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("head"))
    words = spark.createDataFrame(KEYWORDS, "keyword string, ord int, zone string")
    custom = spark.createDataFrame([("de", "C1"), ("as.", "C2")], "neighbourhood string, zone string")
    return lookup.keyword_zone(docs, "head", words, custom, "CITY").select("doc_id", "zone")


def synonym_lookup(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    table = nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("raw"), F.concat(F.lit("C_"), "n_name").alias("canonical"))
    return lookup.synonyms(nations.select("n_nationkey", "n_name"), "n_name", table).select("n_nationkey", "canonical")


def zone_prefix_semi(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    heads = nations.where("n_nationkey % 4 = 1").select(F.expr("substring(n_name, 1, greatest(3, length(n_name) - 1))").alias("h"))
    return lookup.prefix_semi(nations, heads, "n_name", "h")


def zone_price_priority(spark, sf_dir):
    """Each customer's order of the first priority, the earliest first."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return lookup.first_by_priority(orders.withColumn("rank", rank), ["o_custkey"], ["rank", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


QUERIES = {f.__name__: f for f in (radius_join_counts, nearest_poi, point_in_polygon, outside_city, geo_scores, nearest_bucket_counts, keyword_zone_lookup, synonym_lookup, zone_prefix_semi, zone_price_priority)}

_PIP_EDGES = "VALUES " + ", ".join(f"('{zona}', {ord_}, {p}, {r}, {ring[i][0]}::DOUBLE, {ring[i][1]}::DOUBLE, {ring[(i + 1) % len(ring)][0]}::DOUBLE, {ring[(i + 1) % len(ring)][1]}::DOUBLE)" for zona, ord_, polygons in ZONES for p, rings in enumerate(polygons) for r, ring in enumerate(rings) for i in range(len(ring)))
_NEAREST = f"""WITH {POINTS}, d AS (SELECT a.id, b.id AS point_id, CAST(round({HAVERSINE.replace('round(', '(', 1).removesuffix(', 3)')}), 0) AS BIGINT) AS distance_m FROM cus a JOIN sup b ON a.kind = b.kind),
nearest AS (SELECT id, point_id, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance_m, point_id) AS n FROM d) WHERE n = 1)"""
ORACLE_SQL = {
    "radius_join_counts": f"WITH {POINTS}, d AS (SELECT a.id, {HAVERSINE} AS m FROM sup a JOIN sup b ON a.id <> b.id) SELECT id, count(*) AS n, min(m) AS nearest_m FROM d WHERE m <= 2500 GROUP BY id",
    "nearest_poi": f"{_NEAREST} SELECT * FROM nearest",
    "nearest_bucket_counts": f"{_NEAREST} SELECT CAST(distance_m // 1000 AS BIGINT) AS km, count(*) AS n FROM nearest GROUP BY 1",
    "point_in_polygon": f"""WITH {POINTS}, e(zona, ord, p, r, x1, y1, x2, y2) AS ({_PIP_EDGES}),
hits AS (SELECT c.id, zona, ord, p, r, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM cus c CROSS JOIN e GROUP BY ALL),
polys AS (SELECT id, zona, ord, p, bool_or(inside AND r = 0) AND NOT bool_or(inside AND r > 0) AS holds FROM hits GROUP BY ALL),
first AS (SELECT id, arg_min(zona, ord) AS zona FROM polys WHERE holds GROUP BY id),
boxes AS (SELECT zona, ord, (min(x1) + max(x1)) / 2 AS cx, (min(y1) + max(y1)) / 2 AS cy FROM e WHERE r = 0 GROUP BY ALL),
far AS (SELECT c.id, zona, row_number() OVER (PARTITION BY c.id ORDER BY round(pow(lng - cx, 2) + pow(lat - cy, 2), 12), ord) AS n FROM cus c CROSS JOIN boxes)
SELECT id, zona, 'polygon' AS how FROM first UNION ALL SELECT id, zona, 'centroid' FROM far WHERE n = 1 AND id NOT IN (SELECT id FROM first)""",
    "outside_city": f"WITH {SQL}, b(name, s, n, w, e) AS (VALUES " + ", ".join(f"('{c}', {', '.join(map(str, x))})" for c, x in st.CITY_BOXES.items()) + ") SELECT id, coalesce(NOT (lat BETWEEN s AND n AND lng BETWEEN w AND e), FALSE) AS is_outside FROM listings LEFT JOIN b ON lower(city) = name",
    "geo_scores": f"WITH {SQL}, x AS (SELECT id, " + ", ".join(f"CASE WHEN id % 13 = {n} THEN NULL ELSE CAST(id * {m} % {top} AS INT) END AS {c}" for n, (c, m, top) in enumerate([("me", 37, 2500), ("tr", 53, 1300), ("su", 71, 1300), ("pa", 29, 1900), ("un", 43, 1900)])) + """ FROM listings)
SELECT id, CAST(least(100, CASE WHEN me <= 300 THEN 40 WHEN me <= 500 THEN 35 WHEN me <= 800 THEN 28 WHEN me <= 1200 THEN 18 WHEN me <= 2000 THEN 8 ELSE 0 END + CASE WHEN tr <= 200 THEN 15 WHEN tr <= 500 THEN 10 WHEN tr <= 1000 THEN 5 ELSE 0 END
 + CASE WHEN su <= 300 THEN 20 WHEN su <= 600 THEN 14 WHEN su <= 1000 THEN 8 ELSE 0 END + CASE WHEN pa <= 300 THEN 15 WHEN pa <= 800 THEN 10 WHEN pa <= 1500 THEN 5 ELSE 0 END + CASE WHEN un <= 500 THEN 10 WHEN un <= 1500 THEN 6 ELSE 0 END) AS INT) AS geo_score, CAST(round_even(me / 60, 0) AS INT) AS metro_walk_min FROM x""",
    "keyword_zone_lookup": "WITH d AS (SELECT doc_id, lower(text) AS h FROM documents), k(w, o, z) AS (VALUES " + ", ".join(f"('{w}', {o}, '{z}')" for w, o, z in KEYWORDS) + """),
m AS (SELECT doc_id, z, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, o) AS n FROM d JOIN k ON contains(h, w))
SELECT d.doc_id, CASE h WHEN 'de' THEN 'C1' WHEN 'as.' THEN 'C2' ELSE coalesce(m.z, 'CITY') END AS zone FROM d LEFT JOIN m ON d.doc_id = m.doc_id AND n = 1""",
    "synonym_lookup": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'C_' || n_name ELSE n_name END AS canonical FROM nation",
    "zone_prefix_semi": "SELECT n_nationkey, n_name FROM nation a WHERE EXISTS (SELECT 1 FROM (SELECT lower(substr(n_name, 1, greatest(3, length(n_name) - 1))) AS h FROM nation WHERE n_nationkey % 4 = 1) b WHERE starts_with(lower(a.n_name), h) OR starts_with(h, lower(a.n_name)))",
    "zone_price_priority": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank, o_orderdate, o_orderkey) AS n FROM (SELECT *, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS INT) AS rank FROM orders)) WHERE n = 1",
}
