"""Queries on filters, lookups and updates by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark import settings as st
from estimark.operators import digest, quality, rules
from estimark.plans.listings import SQL, listings
from estimark.plans.scores import AUDIT, QUALITY, R2


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(df, columns):
    return df.withColumns({n: F.expr(e) for n, e in columns.items()})


def sql_columns(columns):
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


PLACES = {"score_total": "CAST(id * 7 % 101 AS INT)", "neighbourhood": "CASE id % 5 WHEN 0 THEN 'Navigli Sud' WHEN 1 THEN 'Brera' WHEN 2 THEN NULL WHEN 3 THEN '—' ELSE 'Porta Venezia' END", "is_new": "id % 3 = 0", "dropped": "CASE WHEN id % 5 = 0 THEN TRUE END"}


def digest_filters(spark, sf_dir):
    df = exprs(listings(spark, sf_dir), PLACES)
    narrow = df.where(rules.digest_filter(30, 1500, 2, ("navigli", " Venezia"))).select("id", F.lit("narrow").alias("digest"))
    return narrow.unionByName(df.where(rules.digest_filter()).select("id", F.lit("open").alias("digest"))).groupBy("digest").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def scan_ranges(spark, sf_dir):
    return listings(spark, sf_dir).where(rules.in_ranges({"price": (90_500, 96_000), "sqm": (40, None), "rooms": (None, 3)})).select("id")


def saved_searches(spark, sf_dir):
    df = exprs(listings(spark, sf_dir), PLACES)
    test = rules.saved_search({"elevator": True}, {"score_total": 40, "sqm": 30}, {"rent_mo": 1800}, {"city": ["Milano", "Roma"]})
    return df.where(test).select("id", "score_total").orderBy(F.desc("score_total"), "id").limit(50)


GEO = {
    "latitude": "CASE WHEN id % 4 = 0 THEN lat END", "longitude": "CASE WHEN id % 4 = 0 THEN lng END", "address": "CASE id % 5 WHEN 0 THEN 'Via Roma 1' WHEN 1 THEN 'Posizione approssimativa' ELSE NULL END",
    "title": "CASE id % 6 WHEN 0 THEN 'Casa in Centro' WHEN 1 THEN 'Trilocale a Lodi' WHEN 2 THEN 'appartamento a due piani' ELSE NULL END",
}


def geocodable_listings(spark, sf_dir):
    return exprs(listings(spark, sf_dir), {**PLACES, **GEO}).where(rules.geocodable()).select("id")


def pending_places(spark, sf_dir):
    """Listings without places near them, against a cache of every third."""
    df = exprs(listings(spark, sf_dir), {"source": "'a'", "geo_score": "CASE WHEN id % 4 = 0 THEN 50 END", "metro_m": "CASE WHEN id % 16 = 0 THEN 600000 WHEN id % 4 = 0 THEN 300 END"}).select("id", "source", "geo_score", "metro_m")
    cache = listings(spark, sf_dir).where("id % 3 = 0").select("id", F.lit("a").alias("source"), F.expr("CASE WHEN id % 9 = 0 THEN NULL ELSE 40 END").alias("geo_score"), F.expr("CASE WHEN id % 5 = 0 THEN 60000 ELSE 10 END").alias("metro_m"))
    return rules.pending(df, cache).select("id")


SQUARES = [("milano", "B1", 9.0, 45.3, 9.14, 45.46), ("milano", "C2", 9.14, 45.3, 9.28, 45.46), ("roma", "D3", 9.0, 45.3, 9.1, 45.5)]


def squares(spark):
    ring = lambda x0, y0, x1, y1: [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]
    return spark.createDataFrame([(c, z, n, ring(*box), 10.0 + n if z != "C2" else None) for n, (c, z, *box) in enumerate(SQUARES)], "city string, zona string, ord int, polygons array<array<array<array<double>>>>, loc_mid double")


def inside_city(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", "lat", "lng", F.lower("city").alias("city"))
    return rules.in_city(df, squares(spark)).select("id", "in_city")


def zone_backfill(spark, sf_dir):
    """Zone prices where a listing has none, from the polygon around it."""
    df = listings(spark, sf_dir).select("id", "lat", "lng", F.lit("milano").alias("city"), F.lit(None).cast("string").alias("zona"), F.when(F.col("id") % 3 == 0, 99.0).alias("loc_mid"))
    return rules.backfill(df, squares(spark)).select("id", "zona", "loc_mid")


def zone_stubs(spark, sf_dir):
    zones = listings(spark, sf_dir).where("id % 3 = 0").groupBy(F.col("city"), F.col("zone").alias("zona")).agg(F.min(F.lit("B")).alias("fascia"), F.lit("x").alias("descr"), F.max("omi_mid").alias("loc_mid"))
    polygons = listings(spark, sf_dir).select("city", F.col("zone").alias("zona"))
    return rules.zone_metadata(polygons, zones).select("city", "zona", "fascia", "fascia_label", "descr", "loc_mid")


def station_names(spark, sf_dir):
    """Names and lines of the metro for entrances that have none."""
    near = listings(spark, sf_dir, dealt=True).where("lat IS NOT NULL").select("id", "lat", "lng", F.lit("milano").alias("city"), F.lit(400).alias("distance_m"), F.expr("CASE WHEN id % 4 = 0 THEN 'Gate' END").alias("name"), F.expr("CASE WHEN id % 5 = 0 THEN 'M9' ELSE '' END").alias("lines"))
    stations = spark.createDataFrame([("milano", 0, 45.46, 9.19, "Duomo", "M1, M3"), ("milano", 1, 45.461, 9.19, "Cordusio", "M1"), ("milano", 2, 45.48, 9.2, "Centrale", ""), ("roma", 3, 45.46, 9.19, "Termini", "MA")], "city string, ord int, lat double, lng double, name string, lines string")
    return rules.metro_names(near, stations).select("id", "name", "lines")


def lookup_defaults(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", F.lower("city").alias("city"), "zone", F.expr("CASE id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'E' WHEN 2 THEN NULL ELSE 'Z' END").alias("fascia"))
    ldi = df.where("city = 'milano'").select("city", "zone").distinct().withColumn("ldi", F.length("zone"))
    return rules.with_defaults(df, ldi).select("id", "ldi", "growth")


def card_grid(spark, sf_dir):
    top = exprs(listings(spark, sf_dir), PLACES).orderBy(F.desc("score_total"), "id").limit(24)
    return rules.grid(top, [F.desc("score_total"), "id"], 3).select("id", "grid_row", "grid_column")


def first_of_each(spark, sf_dir):
    return rules.keep_first(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def recycled_pages(spark, sf_dir):
    """Pages of ids, of which every fourth repeats the page before."""
    o = t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).alias("page"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 200 - 1).otherwise(F.col("o_orderkey")).alias("shown"))
    pages = o.groupBy("page").agg(F.collect_set("shown").alias("ids"))
    earlier = pages.select((F.col("page") + 1).alias("page"), F.col("ids").alias("before"))
    mixed = pages.join(earlier, "page", "left").select("page", F.when((F.col("page") % 4 == 0) & F.col("before").isNotNull(), F.col("before")).otherwise(F.col("ids")).alias("ids"))
    return rules.recycled(mixed, "page", "ids")


def json_arrays(spark, sf_dir):
    """Events' properties as elements of an array of texts, parsed one by one."""
    ev = t(spark, sf_dir, "events").select("event_id", F.array(F.col("props"), F.lit("  "), F.lit(None).cast("string"), F.lit("[1,2]")).alias("texts"))
    out = ev.select("event_id", rules.json_elements(F.col("texts")).alias("v"))
    return out.select("event_id", F.size("v").alias("n"), F.try_variant_get(F.col("v")[0], "$.k", "int").alias("k"), F.try_variant_get(F.col("v")[1], "$[1]", "int").alias("second"))


def zone_names(spark, sf_dir):
    """Neighbourhoods by city, sorted without regard to case."""
    names = listings(spark, sf_dir).select("city", F.expr("CASE WHEN id % 2 = 0 THEN lower(zone) ELSE zone END").alias("name")).distinct()
    rows = names.groupBy("city").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name"))).alias("x"))
    return rows.select("city", F.array_join(F.transform("x", lambda s: s["name"]), ",").alias("names"))


def source_counts(spark, sf_dir):
    return exprs(listings(spark, sf_dir), {"src": "CASE id % 4 WHEN 0 THEN 'polygon' WHEN 1 THEN 'centroid' WHEN 2 THEN NULL ELSE 'keyword' END"}).groupBy(F.coalesce("src", F.lit("missing")).alias("omi_source")).agg(F.count("*").alias("n"))


def digest_counts(spark, sf_dir):
    """Distinct new and cheaper listings of each rule."""
    df = t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("rule_id"), (F.col("event_id") % 300).alias("id"), (F.col("event_type") == "click").alias("is_new"), (F.col("event_type") == "purchase").alias("dropped"))
    return digest.counts(df)


def quality_gaps(spark, sf_dir):
    cover = quality.coverage(listings(spark, sf_dir), [f for fs in QUALITY.values() for f in fs])
    return rules.quality_gaps(cover, QUALITY["important"])


SOURCES = {"source": "CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'a' ELSE 'b' END", "omi_source": "CASE WHEN id % 7 = 0 THEN 'centroid' WHEN id % 7 = 1 THEN NULL ELSE 'polygon' END"}


def quality_summary(spark, sf_dir):
    df = exprs(listings(spark, sf_dir), SOURCES)
    return quality.summary(quality.audit(df, QUALITY), df)


def least_complete(spark, sf_dir):
    return quality.audit(exprs(listings(spark, sf_dir), {"omi_source": "'polygon'"}), QUALITY).select("id", "completeness_pct").orderBy("completeness_pct", "id").limit(30)


def gems_in_order(spark, sf_dir):
    return exprs(listings(spark, sf_dir), PLACES).where("score_total >= 80 AND elevator").select("id", "score_total").orderBy(F.desc("score_total"), "id")


def simple_sale_score(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", (F.col("id") % 101).cast("double").alias("pct"), F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 21 - 10 AS DOUBLE) / 50 END").alias("vs"), F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 9 AS DOUBLE) END").alias("gain"))
    return df.select("id", rules.simple_score(F.col("pct"), F.col("vs"), False).alias("rent_score"), rules.simple_score(F.col("pct"), F.col("vs"), True, F.col("gain")).alias("sale_score"))


def digest_display(spark, sf_dir):
    df = exprs(listings(spark, sf_dir), PLACES)
    return df.select("id", *rules.display(F.col("score_total"), F.when(F.col("id") % 9 > 0, F.col("rent_mo"))))


def active_areas(spark, sf_dir):
    """Areas of a nested tree that are switched on."""
    nested = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", (F.col("n_nationkey") % 3 == 0).alias("active"))).alias("areas"))
    return nested.select("n_regionkey", F.explode("areas").alias("a")).where("a.active").select("n_regionkey", F.col("a.n_name").alias("area"))


STORED = {
    "listing_type": "CASE WHEN id % 3 = 0 THEN 'rental' ELSE 'sale' END", "city": "CASE id % 4 WHEN 0 THEN 'milano' WHEN 1 THEN 'roma' WHEN 2 THEN 'napoli' ELSE 'la_maddalena' END", "ask_psqm": "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id * 37 % 2500 AS DOUBLE) END",
    "title": "CASE id % 23 WHEN 0 THEN 'Nuda Proprietà' WHEN 1 THEN 'Casa a Dubai' WHEN 2 THEN 'Vista mare' WHEN 3 THEN NULL ELSE 'Casa' END", "description": "CASE id % 29 WHEN 0 THEN 'con usufrutto' WHEN 1 THEN 'Invest abroad now' WHEN 2 THEN 'a Corsico' WHEN 3 THEN 'a soli 3 km' WHEN 4 THEN NULL ELSE 'bella' END",
    "is_auction": "id % 31 = 0", "is_nuda_proprieta": "CASE WHEN id % 37 = 0 THEN TRUE END", "is_fake": "CASE WHEN id % 41 = 0 THEN TRUE END", "excluded": "FALSE", "excluded_reason": "CAST(NULL AS {text})", "price_floor_gate_applied": "FALSE", "price_floor_reason": "CAST(NULL AS {text})", "is_stale": "FALSE",
    "extreme_underpricing": "FALSE", "hidden_gem": "id % 2 = 0", "good_value": "id % 2 = 1", "score_total": "CAST(id * 7 % 101 AS INT)", "ldi": "CAST(60 + id % 41 AS INT)", "delta_pct": "CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 90 - 80 AS DOUBLE) END",
    "score_physical": "CAST(55 + id % 40 AS INT)", "score_location": "CAST(50 + id % 50 AS INT)", "confidence": "CAST(40 + id % 60 AS INT)", "score_penalty": "CAST(55 + id % 45 AS INT)", "metro_m": "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id * 17 % 1000 AS INT) END",
    "is_misrepresented_address": "FALSE", "is_outside_city": "FALSE", "misrep_reason": "CAST(NULL AS {text})", "latitude": "lat", "longitude": "lng",
}
SHOWN = ["id", "excluded", "excluded_reason", "price_floor_gate_applied", "price_floor_reason", "is_stale", "is_nuda_proprieta", "is_fake", "extreme_underpricing", "hidden_gem", "good_value", "score_total", "is_misrepresented_address", "is_outside_city", "misrep_reason"]


def stored_sweeps(spark, sf_dir):
    """All updates of stored listings, in their order."""
    df = listings(spark, sf_dir)
    df = df.select("id", "sqm", "rooms", *[F.expr(e.format(text="STRING")).alias(n) for n, e in STORED.items()])
    return rules.swept(df).select(SHOWN)


def settings_change(spark, sf_dir):
    """Zone mappings saved and deleted, and the listings' zones looked up again."""
    saved = t(spark, sf_dir, "nation").select(F.col("n_name").alias("neighbourhood"), (F.col("n_regionkey") * 10).alias("zone"))
    changed = saved.where(F.length("neighbourhood") % 2 == 0).withColumn("zone", F.col("zone") + 1)
    now = rules.saved_mappings(saved, changed, saved.where(F.length("neighbourhood") == 5).select("neighbourhood"), "neighbourhood")
    use = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("neighbourhood"))
    return use.join(now, "neighbourhood", "left").groupBy("zone").agg(F.count("*").alias("n"))


def cache_delete(spark, sf_dir):
    """A cache without the rows of some ids, whatever their source."""
    cache = t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"))
    gone = t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return cache.join(gone, "id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        digest_filters, scan_ranges, saved_searches, geocodable_listings, pending_places, inside_city, zone_backfill, zone_stubs, station_names, lookup_defaults, card_grid, first_of_each, recycled_pages, json_arrays, zone_names, source_counts,
        digest_counts, quality_gaps, quality_summary, least_complete, gems_in_order, simple_sale_score, digest_display, active_areas, stored_sweeps, settings_change, cache_delete,
    )
}

_L = f"WITH {SQL}, p AS (SELECT *, {sql_columns(PLACES)} FROM listings)"
_IN = lambda c, z: next(f"lng >= {x0} AND lng < {x1} AND lat >= {y0} AND lat < {y1}" for a, b, x0, y0, x1, y1 in SQUARES if (a, b) == (c, z))
_BOX = lambda c: "lat BETWEEN {0} AND {2} AND lng BETWEEN {1} AND {3}".format(*rules.WIDE_BOXES[c])
_HAV = "round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({0}) - lat) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin(radians(({1}) - lng) / 2), 2)))), 0)"
_HAVE = {"floor_n": "floor_n IS NOT NULL", "elevator": "elevator IS NOT NULL", "condition": "condition IS NOT NULL", "is_external": "is_external IS NOT NULL", "rooms": "rooms IS NOT NULL"}


def _like(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _sweep_sql() -> str:
    """The same updates as one CTE each; columns that a step doesn't change go on as they are."""
    low_t, low_d = "lower(coalesce(title, ''))", "lower(coalesce(description, ''))"
    gone = lambda why: {"excluded": "TRUE", "excluded_reason": f"coalesce(excluded_reason, '{why}')", "is_stale": "TRUE"}
    steps = [(f"listing_type = 'sale' AND city = '{c}' AND ask_psqm < {v} AND excluded IS NOT TRUE", {"excluded": "TRUE", "price_floor_gate_applied": "TRUE", "price_floor_reason": f"'under {v} a square metre in {c}'", "is_stale": "TRUE"}) for c, v in st.MIN_SALE_PSQM.items()]
    steps += [
        (f"listing_type = 'sale' AND is_nuda_proprieta IS NOT TRUE AND ({_like(low_t, rules.BARE)} OR {_like(low_d, rules.BARE)})", {"is_nuda_proprieta": "TRUE", "excluded": "TRUE", "excluded_reason": "'bare ownership'", "is_stale": "TRUE"}),
        ("listing_type = 'sale' AND is_nuda_proprieta AND excluded IS NOT TRUE", gone("bare ownership")), ("excluded AND excluded_reason IS NULL AND price_floor_reason IS NOT NULL", {"excluded_reason": "price_floor_reason"}), ("listing_type = 'sale' AND is_auction AND excluded IS NOT TRUE", gone("auction")),
        (f"is_fake IS NOT TRUE AND ({_like(low_t, rules.ABROAD_TITLES)} OR {_like(low_d, rules.ABROAD_TEXTS)})", {"is_fake": "TRUE", **gone("bait")}),
        (f"is_fake IS NOT TRUE AND city NOT IN ('napoli', 'la_maddalena') AND ({_like(low_t, rules.SEA_TITLES)} OR {_like(low_d, rules.SEA_TITLES)})", {"is_fake": "TRUE", **gone("sea view inland")}),
    ]
    quiet = "is_fake IS NOT TRUE AND is_auction IS NOT TRUE AND is_nuda_proprieta IS NOT TRUE AND excluded IS NOT TRUE AND extreme_underpricing IS NOT TRUE"
    steps += [(f"{quiet} AND delta_pct < {x}", {"extreme_underpricing": "TRUE", "hidden_gem": "FALSE", "good_value": "FALSE", "score_total": "least(score_total, 55)"}) for x in (-60, -40)]
    fails = lambda m: f"(score_total < {m[0]} OR ldi < {m[1]} OR delta_pct IS NULL OR delta_pct > {m[2]} OR score_physical < {m[3]} OR score_location < {m[4]} OR confidence < {m[5]} OR score_penalty < {m[6]})"
    s = st.Settings()
    steps += [(f"listing_type = 'rental' AND hidden_gem AND ({fails(s.gem)} OR metro_m IS NULL OR metro_m > 800 OR coalesce(sqm / rooms < 22, FALSE))", {"hidden_gem": "FALSE"}), (f"listing_type = 'rental' AND good_value AND {fails(s.good_value)}", {"good_value": "FALSE"})]
    moved, milan = {"is_misrepresented_address": "TRUE", "is_fake": "TRUE"}, "listing_type = 'sale' AND city = 'milano' AND is_misrepresented_address IS NOT TRUE AND description IS NOT NULL"
    steps += [(f"{milan} AND {_like(low_d, rules.NEXT_TO_MILAN)}", {**moved, **gone("another municipality"), "misrep_reason": "coalesce(misrep_reason, 'names a neighbour')"}), (f"{milan} AND regexp_matches({low_d}, '{rules.SOME_KM}')", {**moved, **gone("some km away"), "misrep_reason": "coalesce(misrep_reason, 'some km')"})]
    for c in ("milano", "roma", "napoli"):
        y0, y1, x0, x1 = st.CITY_BOXES[c]
        steps.append((f"listing_type = 'sale' AND city = '{c}' AND is_outside_city IS NOT TRUE AND NOT (latitude BETWEEN {y0} AND {y1} AND longitude BETWEEN {x0} AND {x1})", {"is_outside_city": "TRUE", "is_fake": "TRUE", **gone("outside the city"), "misrep_reason": "coalesce(misrep_reason, 'outside the city')"}))
    ctes = [f"u0 AS (SELECT id, sqm, rooms, {sql_columns({n: e.format(text='VARCHAR') for n, e in STORED.items()})} FROM listings)"]
    for k, (cond, changes) in enumerate(steps):
        ctes.append(f"u{k + 1} AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {cond} THEN {v} ELSE {c} END AS {c}' for c, v in changes.items())}) FROM u{k})")
    return f"WITH {SQL}, {', '.join(ctes)} SELECT {', '.join(SHOWN)} FROM u{len(steps)}"


ORACLE_SQL = {
    "digest_filters": f"{_L} SELECT 'narrow' AS digest, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM p WHERE score_total >= 30 AND rent_mo <= 1500 AND rooms >= 2 AND (lower(neighbourhood) LIKE '%navigli%' OR lower(neighbourhood) LIKE '%venezia%') UNION ALL SELECT 'open', count(*), CAST(sum(id) AS BIGINT) FROM p",
    "scan_ranges": f"WITH {SQL} SELECT id FROM listings WHERE price BETWEEN 90500 AND 96000 AND coalesce(sqm >= 40, TRUE) AND coalesce(rooms <= 3, TRUE)",
    "saved_searches": f"{_L} SELECT id, score_total FROM p WHERE (is_new OR dropped) AND elevator AND score_total >= 40 AND sqm >= 30 AND rent_mo <= 1800 AND city IN ('Milano', 'Roma') ORDER BY score_total DESC, id LIMIT 50",
    "geocodable_listings": f"{_L} SELECT id FROM p WHERE (id % 4 = 0 AND lat IS NOT NULL) OR id % 5 = 0 OR id % 6 IN (0, 1) OR id % 5 IN (0, 1, 4)",
    "pending_places": f"WITH {SQL} SELECT id FROM listings WHERE CASE WHEN id % 4 = 0 THEN id % 16 = 0 ELSE id % 3 <> 0 OR id % 9 = 0 OR id % 5 = 0 END",
    "inside_city": f"WITH {SQL}, x AS (SELECT id, lat, lng, lower(city) AS city FROM listings) SELECT id, coalesce(CASE WHEN city = 'milano' THEN ({_IN('milano', 'B1')}) OR ({_IN('milano', 'C2')}) OR ({_BOX('milano')}) WHEN city = 'roma' THEN ({_IN('roma', 'D3')}) OR ({_BOX('roma')}) WHEN city = 'napoli' THEN {_BOX('napoli')} ELSE {_BOX('milano')} END, FALSE) AS in_city FROM x",
    "zone_backfill": f"WITH {SQL}, x AS (SELECT id, CASE WHEN id % 3 = 0 OR lat IS NULL THEN NULL WHEN {_IN('milano', 'B1')} THEN 'B1' WHEN {_IN('milano', 'C2')} THEN 'C2' END AS zona FROM listings) SELECT id, zona, CASE WHEN id % 3 = 0 THEN 99.0::DOUBLE WHEN zona = 'B1' THEN 10.0::DOUBLE END AS loc_mid FROM x",
    "zone_stubs": f"WITH {SQL}, z AS (SELECT city, zone, max(omi_mid) AS m FROM listings WHERE id % 3 = 0 GROUP BY ALL), d AS (SELECT DISTINCT city, zone FROM listings) SELECT d.city, d.zone AS zona, CASE WHEN z.zone IS NULL THEN substr(d.zone, 1, 1) ELSE 'B' END AS fascia, 'Centrale' AS fascia_label, CASE WHEN z.zone IS NULL THEN '' ELSE 'x' END AS descr, z.m AS loc_mid FROM d LEFT JOIN z ON d.city = z.city AND d.zone = z.zone",
    "station_names": f"WITH {SQL}, x AS (SELECT id, {_HAV.format('45.46::DOUBLE', '9.19::DOUBLE')} AS d0, {_HAV.format('45.461::DOUBLE', '9.19::DOUBLE')} AS d1 FROM listings WHERE lat IS NOT NULL) SELECT id, CASE WHEN id % 4 = 0 THEN 'Gate' WHEN id % 5 = 0 THEN NULL WHEN d0 <= 500 THEN 'Duomo' WHEN d1 <= 500 THEN 'Cordusio' END AS name, CASE WHEN id % 5 = 0 THEN 'M9' WHEN d0 <= 500 THEN 'M1, M3' WHEN d1 <= 500 THEN 'M1' END AS lines FROM x",
    "lookup_defaults": f"WITH {SQL}, x AS (SELECT id, lower(city) AS city, zone FROM listings), m AS (SELECT DISTINCT zone FROM x WHERE city = 'milano') SELECT id, CAST(CASE WHEN city = 'milano' THEN length(zone) ELSE 50 END AS INT) AS ldi, CAST((CASE city WHEN 'roma' THEN [0.020, 0.008, 0.015, 0.015] WHEN 'napoli' THEN [0.015, 0.008, 0.012, 0.012] ELSE [0.025, 0.010, 0.020, 0.020] END)[id % 4 + 1] AS DOUBLE) AS growth FROM x",
    "card_grid": f"{_L}, r AS (SELECT id, row_number() OVER (ORDER BY score_total DESC, id) - 1 AS n FROM p) SELECT id, CAST(n // 3 AS INT) AS grid_row, CAST(n % 3 AS INT) AS grid_column FROM r WHERE n < 24",
    "first_of_each": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "recycled_pages": """WITH o AS (SELECT o_orderkey % 200 AS page, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 - 1 ELSE o_orderkey END AS shown FROM orders), p AS (SELECT page, list(DISTINCT shown) AS ids FROM o GROUP BY page),
m AS (SELECT a.page, CASE WHEN a.page % 4 = 0 AND b.page IS NOT NULL THEN b.ids ELSE a.ids END AS ids FROM p a LEFT JOIN p b ON a.page = b.page + 1), u AS (SELECT page, unnest(ids) AS i FROM m), f AS (SELECT i, min(page) AS first FROM u GROUP BY i)
SELECT page, bool_and(first < page) AS recycled FROM u JOIN f USING (i) GROUP BY page""",
    "json_arrays": "SELECT event_id, 2::INT AS n, CAST(json_extract(props, '$.k') AS INT) AS k, 2::INT AS second FROM events",
    "zone_names": f"WITH {SQL}, n AS (SELECT DISTINCT city, CASE WHEN id % 2 = 0 THEN lower(zone) ELSE zone END AS name FROM listings) SELECT city, string_agg(name, ',' ORDER BY lower(name), name) AS names FROM n GROUP BY city",
    "source_counts": f"WITH {SQL} SELECT (['polygon', 'centroid', 'missing', 'keyword'])[id % 4 + 1] AS omi_source, count(*) AS n FROM listings GROUP BY 1",
    "digest_counts": "SELECT user_id % 50 AS rule_id, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 300 END) AS n_new, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id % 300 END) AS n_dropped FROM events GROUP BY 1",
    "quality_gaps": f"WITH {SQL}, g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (NOT ({x})) AS n_missing, count(*) AS n FROM listings" for f, x in _HAVE.items()) + f") SELECT field, n_missing FROM g WHERE {R2('CAST(n - n_missing AS DOUBLE) / n * 100', 1)} < 80",
    "quality_summary": f"""{AUDIT}, s AS (SELECT *, {sql_columns(SOURCES)} FROM listings)
SELECT 'total' AS what, 'all' AS name, count(*) AS n, {R2('CAST(sum(CAST(completeness_pct AS DECIMAL(18,6))) AS DOUBLE) / count(*)', 1)} AS value FROM audit UNION ALL SELECT 'grade', grade, count(*), NULL FROM audit GROUP BY grade
UNION ALL SELECT 'enrich', 'again', count(*) FILTER (needs_reenrichment), NULL FROM audit UNION ALL SELECT 'source', CASE WHEN source = '' THEN 'unknown' ELSE source END, count(*), NULL FROM s GROUP BY 2 UNION ALL SELECT 'zone source', coalesce(omi_source, 'missing'), count(*), NULL FROM s GROUP BY 2""",
    "least_complete": f"{AUDIT} SELECT id, completeness_pct FROM audit ORDER BY completeness_pct, id LIMIT 30",
    "gems_in_order": f"{_L} SELECT id, score_total FROM p WHERE score_total >= 80 AND elevator ORDER BY score_total DESC, id",
    "simple_sale_score": f"""WITH {SQL}, x AS (SELECT id, CAST(id % 101 AS DOUBLE) AS pct, CASE WHEN id % 7 = 0 THEN 50 ELSE greatest(0, least(100, 50 - 250 * (CAST(id % 21 - 10 AS DOUBLE) / 50))) END AS price, CASE WHEN id % 5 = 0 THEN 50 ELSE greatest(0, least(100, (CAST(id % 9 AS DOUBLE) - 2.5::DOUBLE) / 4.5::DOUBLE * 100)) END AS gain FROM listings)
SELECT id, {R2('price * 0.60::DOUBLE + (100 - pct) * 0.40::DOUBLE', 1)} AS rent_score, {R2('price * 0.40::DOUBLE + gain * 0.35::DOUBLE + (100 - pct) * 0.25::DOUBLE', 1)} AS sale_score FROM x""",
    "digest_display": f"{_L} SELECT id, CASE WHEN score_total >= 70 THEN 'high' WHEN score_total >= 50 THEN 'medium' ELSE 'low' END AS band, CASE WHEN id % 9 > 0 THEN '€' || format('{{:,}}', rent_mo) ELSE 'n/a' END AS rent_text FROM p",
    "active_areas": "SELECT n_regionkey, n_name AS area FROM nation WHERE n_nationkey % 3 = 0",
    "stored_sweeps": _sweep_sql(),
    "settings_change": "WITH s AS (SELECT n_name, n_regionkey * 10 + CASE WHEN length(n_name) % 2 = 0 THEN 1 ELSE 0 END AS zone FROM nation WHERE length(n_name) <> 5) SELECT CAST(s.zone AS INT) AS zone, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN s ON nation.n_name = s.n_name GROUP BY 1",
    "cache_delete": "SELECT event_type AS source, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1",
}
