"""Filters, lookups and updates that the listing engine applies by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estimark import settings as st
from estimark.functions import prose as pr
from estimark.functions import scalars as sc
from estimark.operators import comps, geo
from estimark.operators.lifecycle import sweep

# Fixed values that results depend on.
BARE = ["nuda propriet", "nuda prop", "usufrutto", "diritto di abitazione"]
ABROAD_TITLES = ["albania", "tirana", "durres", "saranda", "dubai", "emirati arabi", "montenegro", "podgorica", "turchia", "istanbul", "marocco", "marrakech", "shop like a billionaire"]
ABROAD_TEXTS = ["shop like a billionaire", "invest abroad", "acquista all'estero", "investi all'estero"]
SEA_TITLES = ["spiaggia privata", "marina privata", "vista mare", "fronte mare"]
BY_THE_SEA = ["napoli", "la_maddalena"]
NEXT_TO_MILAN = [
    "opera (mi)", "opera(mi)", "opera, mi", "rozzano (mi)", "rozzano, mi", "locate triulzi", "locate di triulzi", "pieve emanuele", "san donato milanese", "san giuliano milanese", "segrate (mi)", "segrate, mi", "cologno monzese", "sesto san giovanni",
    "cinisello balsamo", "cusano milanino", "paderno dugnano", "buccinasco", "corsico", "cesano boscone", "trezzano sul naviglio", "assago", "pioltello", "vimodrone", "cernusco sul naviglio", "settimo milanese", "novate milanese", "baranzate",
]
SOME_KM = r"a\s+(solo|soli)\s+\d+\s*km|a\s+\d+\s*km\s+(ca\.?|circa)\s+da"
#: city: (south, west, north, east), wider than the city
WIDE_BOXES = {"milano": (45.38, 9.02, 45.56, 9.32), "roma": (41.75, 12.30, 42.00, 12.70), "napoli": (40.78, 14.14, 40.92, 14.38), "la_maddalena": (41.17, 9.35, 41.25, 9.47)}
BELTS = {"A": "Pregio", "B": "Centrale", "C": "Semicentrale", "D": "Periferica", "E": "Periferica", "R": "Rurale"}
FARTHEST_M = 50_000
#: Yearly price growth by city and belt; other cities are taken for Milan, other belts for C.
GROWTH = {
    "milano": {"A": 0.030, "B": 0.025, "C": 0.020, "D": 0.015, "E": 0.010, "R": 0.010}, "roma": {"A": 0.025, "B": 0.020, "C": 0.015, "D": 0.010, "E": 0.008, "R": 0.008},
    "napoli": {"A": 0.020, "B": 0.015, "C": 0.012, "D": 0.010, "E": 0.008, "R": 0.008}, "la_maddalena": {"A": 0.015, "B": 0.010, "C": 0.008, "D": 0.005, "E": 0.005, "R": 0.005},
}
DEFAULT_LDI = 50


def digest_filter(min_score: int = 0, max_rent: int = 0, min_rooms: int = 0, areas: tuple[str, ...] = ()) -> Column:
    """Keeps what a digest asks for; 0 and no areas ask for nothing. An area is any part of the
    neighbourhood's name."""
    name = F.lower(F.coalesce("neighbourhood", F.lit("")))
    tests = [F.lit(True)]
    tests += [sc.zero("score_total") >= min_score] if min_score else []
    tests += [sc.zero("rent_mo") <= max_rent] if max_rent else []
    tests += [sc.zero("rooms") >= min_rooms] if min_rooms else []
    wanted = [a.strip().lower() for a in areas if a]
    tests += [sc.any_of(name, wanted)] if wanted else []
    return reduce(lambda a, b: a & b, tests)


def in_ranges(ranges: dict[str, tuple]) -> Column:
    """Keeps rows whose columns lie in (least, most); None is open, and so is a missing value."""
    tests = [F.lit(True)]
    for name, (low, high) in ranges.items():
        tests += [F.coalesce(F.col(name) >= low, F.lit(True))] if low is not None else []
        tests += [F.coalesce(F.col(name) <= high, F.lit(True))] if high is not None else []
    return reduce(lambda a, b: a & b, tests)


def saved_search(equal: dict | None = None, least: dict | None = None, most: dict | None = None, among: dict | None = None) -> Column:
    """A saved search over columns, on listings that are new or cheaper today."""
    tests = [F.coalesce("is_new", F.lit(False)) | F.coalesce("dropped", F.lit(False))]
    tests += [F.col(k) == v for k, v in (equal or {}).items()] + [F.col(k) >= v for k, v in (least or {}).items()]
    tests += [F.col(k) <= v for k, v in (most or {}).items()] + [F.col(k).isin(list(v)) for k, v in (among or {}).items()]
    return reduce(lambda a, b: a & b, tests)


def in_city(points: DataFrame, zones: DataFrame) -> DataFrame:
    """``points`` (id, lat, lng, city) with ``in_city``: within a polygon of the city, else within
    its wide box (Milan's, where the city has none)."""
    hit = geo.polygon_lookup(points, zones, centroid_fallback=False).select("id", F.lit(True).alias("__hit"))
    city, lat, lng = F.lower("city"), F.col("lat"), F.col("lng")
    inside = lambda box: lat.between(box[0], box[2]) & lng.between(box[1], box[3])
    box = F
    for name, bounds in WIDE_BOXES.items():
        box = box.when(city == name, inside(bounds))
    return points.join(hit, "id", "left").withColumn("in_city", F.coalesce("__hit", box.otherwise(inside(WIDE_BOXES["milano"])), F.lit(False))).drop("__hit")


def geocodable() -> Column:
    """Coordinates, an address that isn't a placeholder, a title that names a place, or a
    neighbourhood."""
    c = F.col
    hood = F.trim(F.coalesce("neighbourhood", F.lit("")))
    title = F.trim(F.coalesce("title", F.lit("")))
    named = title.rlike(r"(?i)\s+in\s+") | title.rlike(r"\s+a\s+(?=[A-ZÀ-ɏ])")
    return ((sc.zero("latitude") != 0) & (sc.zero("longitude") != 0)) | ~pr.hidden(c("address")) | named | (~F.lower(hood).isin("—", "-", "") & ~hood.rlike(pr.PLACEHOLDER))


def pending(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Listings that still need the places near them: neither they nor their cached row
    (source, id) has a score of the place, or it comes from another city (a metro further away
    than 50 km)."""
    kept = cache.select("source", "id", F.col("geo_score").alias("__score"), F.col("metro_m").alias("__m"))
    joined = listings.join(kept, ["source", "id"], "left")
    far = lambda c: F.coalesce(F.col(c) > FARTHEST_M, F.lit(False))
    needs = F.when(F.col("geo_score").isNotNull(), far("metro_m")).otherwise(F.col("__score").isNull() | far("__m"))
    return joined.where(needs).select(listings.columns)


def zone_metadata(polygons: DataFrame, zones: DataFrame) -> DataFrame:
    """One row a polygon's zone: its prices, or a stub whose belt is the code's first letter."""
    joined = polygons.select("city", "zona").distinct().join(zones, ["city", "zona"], "left")
    belt = F.coalesce("fascia", F.substring("zona", 1, 1))
    return joined.withColumn("fascia", belt).withColumns({"fascia_label": sc.lookup(F.col("fascia"), BELTS, "Periferica"), "descr": F.coalesce("descr", F.lit(""))})


def metro_names(near: DataFrame, stations: DataFrame) -> DataFrame:
    """``near`` (id, lat, lng, city, distance_m, name, lines) with lines and name from the first
    station in order with lines at most 100 m further, where the nearest entrance has none.
    stations: city, ord, lat, lng, name, lines."""
    some = stations.where("lines <> ''").select("city", "lat", "lng", "ord", "name", "lines", F.lit(0).alias("side"))
    # entrances of one place and distance ask once
    asks = F.coalesce("lines", F.lit("")) == ""
    bare = near.where(asks).select("city", "lat", "lng", F.col("distance_m").alias("own_m")).distinct().withColumns({"radius": F.col("own_m") + 101, "side": F.lit(1)})
    pairs = comps.radius_pairs(bare, some, "radius", "side").where((F.col("city") == F.col("c_city")) & (F.round("distance_m", 0) <= F.col("own_m") + 100))
    place = ["city", "lat", "lng", "own_m"]
    found = pairs.groupBy(*place).agg(F.min(F.struct(F.col("c_ord").alias("ord"), F.col("c_name").alias("__name"), F.col("c_lines").alias("__lines"))).alias("s"))
    found = found.select(*[F.col(c).alias(f"__{c}") for c in place], "s")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    same = [F.col(c) == F.col(f"__{c}") for c in ("city", "lat", "lng")]
    out = near.join(found, [asks, *same, F.col("distance_m") == F.col("__own_m")], "left")
    return out.withColumns({"lines": F.coalesce(empty("lines"), F.col("s.__lines")), "name": F.coalesce(empty("name"), F.col("s.__name"))}).drop("s", *[f"__{c}" for c in place])


def with_defaults(listings: DataFrame, ldi: DataFrame) -> DataFrame:
    """``listings`` with the zone's desirability (city, zone; 50 if unknown) and price growth by
    city and belt."""
    city = F.when(F.col("city").isin(list(GROWTH)), F.col("city")).otherwise("milano")
    belt = F.upper(F.coalesce("fascia", F.lit("C")))
    table = {f"{name}>{k}": v for name, rates in GROWTH.items() for k, v in rates.items()}
    growth = F.coalesce(sc.lookup(F.concat_ws(">", city, belt), table, None), sc.lookup(city, {name: rates["C"] for name, rates in GROWTH.items()}, None))
    return listings.join(ldi.select("city", "zone", "ldi"), ["city", "zone"], "left").withColumns({"ldi": F.coalesce("ldi", F.lit(DEFAULT_LDI)), "growth": growth})


def grid(rows: DataFrame, order: list, width: int = 3) -> DataFrame:
    """``rows`` with the line and column of a grid that is filled in order. One line of cards for
    all rows: give it few, such as a digest's."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    return rows.withColumns({"grid_row": F.floor(n / width).cast("int"), "grid_column": (n % width).cast("int")})


def keep_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def recycled(pages: DataFrame, page: str, ids: str) -> DataFrame:
    """(page, recycled): whether a page shows only ids that earlier pages showed, too. A row for
    each id and page: an id is new where it appears first."""
    rows = pages.select(page, F.explode_outer(ids).alias("__id"))
    first = rows.groupBy("__id").agg(F.min(page).alias("__first"))
    return rows.join(first, "__id", "left").groupBy(page).agg((F.count_if(F.col("__id").isNotNull() & (F.col("__first") == F.col(page))) == 0).alias("recycled"))


def json_elements(texts: Column) -> Column:
    """An array of texts as an array of variants: each element parsed, blank ones skipped."""
    return F.transform(F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.try_parse_json(x))


def backfill(listings: DataFrame, zones: DataFrame) -> DataFrame:
    """``listings`` (id, lat, lng, city, zona, loc_mid) with zona and loc_mid of the polygon
    around them, where they have no zone price. zones: as in ``geo.polygon_lookup``, with loc_mid."""
    bare = listings.where("loc_mid IS NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    hit = geo.polygon_lookup(bare.select("id", "lat", "lng", "city"), zones, centroid_fallback=False)
    prices = zones.select(F.col("city").alias("__city"), F.col("zona").alias("__zona"), F.col("loc_mid").alias("__mid"))
    found = hit.join(bare.select("id", "city"), "id").join(prices, (F.col("city") == F.col("__city")) & (F.col("zona") == F.col("__zona"))).select("id", "__zona", "__mid")
    return listings.join(found, "id", "left").withColumns({"zona": F.coalesce("__zona", "zona"), "loc_mid": F.coalesce("loc_mid", "__mid")}).select(listings.columns)


def all_sweeps() -> list[tuple[Column, dict[str, Column]]]:
    """The updates of stored listings in their order: price floors, bare ownership, reasons,
    auctions, bait, sea views inland, extreme prices, badges, neighbours of Milan, boxes."""
    c, lit = F.col, F.lit
    off = lambda name: ~F.coalesce(c(name), lit(False))
    sale, rental = c("listing_type") == "sale", c("listing_type") == "rental"
    title, text = F.lower(F.coalesce("title", lit(""))), F.lower(F.coalesce("description", lit("")))
    gone = lambda why: {"excluded": lit(True), "excluded_reason": F.coalesce("excluded_reason", lit(why)), "is_stale": lit(True)}
    steps: list[tuple[Column, dict[str, Column]]] = []
    for city, least in st.MIN_SALE_PSQM.items():
        reason = F.concat(lit("under "), lit(str(least)), lit(" a square metre in "), lit(city))
        steps.append((sale & (c("city") == city) & (c("ask_psqm") < least) & off("excluded"), {"excluded": lit(True), "price_floor_gate_applied": lit(True), "price_floor_reason": reason, "is_stale": lit(True)}))
    steps.append((sale & off("is_nuda_proprieta") & (sc.any_of(title, BARE) | sc.any_of(text, BARE)), {"is_nuda_proprieta": lit(True), "excluded": lit(True), "excluded_reason": lit("bare ownership"), "is_stale": lit(True)}))
    steps.append((sale & c("is_nuda_proprieta") & off("excluded"), gone("bare ownership")))
    steps.append((c("excluded") & c("excluded_reason").isNull() & c("price_floor_reason").isNotNull(), {"excluded_reason": c("price_floor_reason")}))
    steps.append((sale & c("is_auction") & off("excluded"), gone("auction")))
    steps.append((off("is_fake") & (sc.any_of(title, ABROAD_TITLES) | sc.any_of(text, ABROAD_TEXTS)), {"is_fake": lit(True), **gone("bait")}))
    steps.append((off("is_fake") & ~c("city").isin(BY_THE_SEA) & (sc.any_of(title, SEA_TITLES) | sc.any_of(text, SEA_TITLES)), {"is_fake": lit(True), **gone("sea view inland")}))
    quiet = off("is_fake") & off("is_auction") & off("is_nuda_proprieta") & off("excluded") & off("extreme_underpricing")
    for limit in (-60, -40):
        steps.append((quiet & (c("delta_pct") < limit), {"extreme_underpricing": lit(True), "hidden_gem": lit(False), "good_value": lit(False), "score_total": F.least("score_total", lit(55))}))
    fails = lambda m: reduce(lambda a, b: a | b, [sc.zero(n) < v for n, v in zip(("score_total", "ldi", "score_physical", "score_location", "confidence", "score_penalty"), (m[0], m[1], m[3], m[4], m[5], m[6]), strict=True)]) | c("delta_pct").isNull() | F.coalesce(c("delta_pct") > m[2], lit(False))
    s = st.Settings()
    tight = (sc.zero("rooms") > 0) & F.coalesce(c("sqm") / F.nullif("rooms", lit(0)) < s.gem_min_sqm_per_room, lit(False))
    steps.append((rental & c("hidden_gem") & (fails(s.gem) | c("metro_m").isNull() | (c("metro_m") > s.gem_metro_max_m) | tight), {"hidden_gem": lit(False)}))
    steps.append((rental & c("good_value") & fails(s.good_value), {"good_value": lit(False)}))
    moved = {"is_misrepresented_address": lit(True), "is_fake": lit(True)}
    milan = sale & (c("city") == "milano") & off("is_misrepresented_address") & c("description").isNotNull()
    steps.append((milan & sc.any_of(text, NEXT_TO_MILAN), {**moved, **gone("another municipality"), "misrep_reason": F.coalesce("misrep_reason", lit("names a neighbour"))}))
    steps.append((milan & text.rlike(SOME_KM), {**moved, **gone("some km away"), "misrep_reason": F.coalesce("misrep_reason", lit("some km"))}))
    for city in ("milano", "roma", "napoli"):
        outside = geo.outside_box(c("latitude"), c("longitude"), c("city"), {city: st.CITY_BOXES[city]})
        steps.append((sale & (c("city") == city) & off("is_outside_city") & outside, {"is_outside_city": lit(True), "is_fake": lit(True), **gone("outside the city"), "misrep_reason": F.coalesce("misrep_reason", lit("outside the city"))}))
    return steps


def swept(rows: DataFrame) -> DataFrame:
    return sweep(rows, all_sweeps())


def simple_score(percentile: Column, vs: Column, sale: bool, yield_pct: Column | None = None) -> Column:
    """The plain score: price against the zone, percentile, and for sales the yield."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    price = F.when(vs.isNull(), 50.0).otherwise(clamp(50 - 250 * vs))
    if not sale:
        return sc.exactly(price * 0.60 + (100 - percentile) * 0.40, 1)
    gain = F.when(yield_pct.isNull(), 50.0).otherwise(clamp((yield_pct - 2.5) / 4.5 * 100))
    return sc.exactly(price * 0.40 + gain * 0.35 + (100 - percentile) * 0.25, 1)


def saved_mappings(stored: DataFrame, saved: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Mappings after some were saved (a row replaces the stored one of its key) and others
    deleted; what was looked up in them is looked up again by joining the result."""
    kept = stored.join(saved.select(key), key, "left_anti").unionByName(saved)
    return kept.join(deleted.select(key), key, "left_anti")


def quality_gaps(coverage: DataFrame, critical: list[str], below: float = 80.0) -> DataFrame:
    """Critical fields known for less than ``below`` percent of rows, most missing first."""
    return coverage.where(F.col("field").isin(critical) & (F.col("coverage_pct") < below)).select("field", "n_missing").orderBy(F.desc("n_missing"), "field")


def display(score: Column, rent: Column) -> list[Column]:
    """A score's band and a rent as a digest shows them."""
    return [F.when(score >= 70, "high").when(score >= 50, "medium").when(score.isNotNull(), "low").otherwise("none").alias("band"), F.when(sc.zero(rent) > 0, F.concat(F.lit("€"), F.format_number(rent, 0))).otherwise("n/a").alias("rent_text")]




def badge_colors(score: Column, fascia: Column, vs_zone: Column) -> list[Column]:
    """(score_bg, score_color, score_border, fascia_bg, fascia_color, vs_bg, vs_color): colours of a
    score, a belt and a distance to the zone's price; grey, grey and amber where one is unknown."""
    pick = lambda i: F.when(score >= 70, st.GREEN[i]).when(score >= 50, st.AMBER[i]).when(score.isNotNull(), st.RED[i]).otherwise(st.GREY[i])
    belt = lambda i: sc.lookup(F.upper(F.coalesce(fascia, F.lit(""))), {k: v[i] for k, v in st.FASCIA_COLORS.items()}, st.GREY[i])
    vs = lambda i: F.when(vs_zone <= 0, st.VS_ZONE_COLORS[0][i]).when(vs_zone >= 10, st.VS_ZONE_COLORS[2][i]).otherwise(st.VS_ZONE_COLORS[1][i])
    return [*[pick(i).alias(f"score_{n}") for i, n in enumerate(("bg", "color", "border"))], *[belt(i).alias(f"fascia_{n}") for i, n in enumerate(("bg", "color"))], *[vs(i).alias(f"vs_{n}") for i, n in enumerate(("bg", "color"))]]


def floor_display(floor_n: Column, floor: Column) -> Column:
    """A floor as a narrow cell shows it: by its number, else by what its text says."""
    text = F.trim(F.coalesce(floor, F.lit("")))
    number = F.regexp_extract(text, r"(\d+)", 1)
    said = F.when(number != "", F.concat(F.lit("Floor "), number)).when(text.rlike("(?i)terra|ground"), "Ground").when(text != "", F.substring(text, 1, 14))
    return F.when(floor_n == 0, "Ground").when(floor_n < 0, "Basement").when(floor_n > 0, F.concat(F.lit("Floor "), floor_n.cast("string"))).otherwise(said)


def thousands(n: Column) -> Column:
    """A whole number with commas; a dash where it is unknown."""
    return F.coalesce(F.format_number(n.cast("double").cast("long"), 0), F.lit("–"))


def contract_options(city: Column, zone_name: Column, neighbourhood: Column) -> Column:
    """The names of the rental contracts that a listing may have: the free one always, the agreed
    one in cities with an agreement, the short one in places that ask for it."""
    where = F.lower(F.concat_ws(" | ", zone_name, neighbourhood))
    short = F.lit(False)
    for name, places in st.TRANSITORIO_PLACES.items():
        short = short | ((F.lower(city) == name) & sc.any_of(where, places))
    agreed = F.lower(city).isin(st.CONCORDATO_CITIES)
    return F.array_compact(F.array(F.lit("libero"), F.when(agreed, F.lit("concordato")), F.when(short, F.lit("transitorio"))))


def contract_profiles(listings: DataFrame, city: str = "city", zone_name: str = "omi_descr", neighbourhood: str = "neighbourhood") -> DataFrame:
    """One row a listing and contract it may have, with the contract's factors and costs."""
    options = listings.withColumn("contract", F.explode(contract_options(F.col(city), F.col(zone_name), F.col(neighbourhood))))
    return options.withColumns({field: sc.lookup(F.col("contract"), {k: float(v[i]) for k, v in st.CONTRACTS.items()}, None) for i, field in enumerate(st.CONTRACT_FIELDS)})


def with_stored(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The pool of comparables of a scan: its rows, and the stored ones of other keys."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
