"""Queries on sales: composite score, badges, reasons, and checks of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import scoring
from estimark.plans.listings import SQL, listings
from estimark.plans.scores import PHYS, R2, S
from estimark.settings import Settings

#: Sales over the listings: what differs, as SQL that both engines read.
SALE = {
    "rent_mo": "CAST(NULL AS INT)", "ask_psqm": "CASE WHEN id % 50 = 7 THEN CAST(300 AS DOUBLE) ELSE CAST(CAST(FLOOR(ask_psqm * 220) AS INT) AS DOUBLE) END",
    "price": "CAST(CASE WHEN id % 50 = 7 THEN 300 ELSE CAST(FLOOR(ask_psqm * 220) AS INT) END * coalesce(sqm, 50) AS INT)",
}
EXTRA = {
    "compr_mid": "CASE WHEN id % 19 = 0 THEN NULL ELSE CAST(3000 + id % 7 * 500 AS DOUBLE) END", "compr_max": "CASE WHEN id % 19 = 0 THEN NULL ELSE CAST(3300 + id % 7 * 550 AS DOUBLE) END", "loc_mid": "omi_mid",
    "blended_median": "CASE WHEN id % 19 = 0 THEN CAST(4000 AS DOUBLE) ELSE CAST(3000 + id % 7 * 500 AS DOUBLE) END", "ldi": "CAST(id % 101 AS DOUBLE)", "geo_score": "CAST(id * 3 % 101 AS INT)", "confidence": "CAST(id % 5 * 20 AS INT)", "n_comps": "CAST(id % 40 AS INT)",
    "boost": "id % 2 = 0", "corporate": "id % 31 = 0", "condo_fee_flag": "CASE WHEN id % 8 = 0 THEN 'high_condo_fees' END", "metro_walk_min": "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 25 AS INT) END", "metro_m": "CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id * 17 % 1500 AS INT) END",
    "metro_name": "CASE WHEN id % 4 = 0 THEN 'Duomo' END", "park_m": "CAST(id * 13 % 1200 AS INT)", "supermarket_m": "CAST(id * 29 % 900 AS INT)", "floor_label": "CASE WHEN floor_n = 1 AND id % 2 = 0 THEN 'Piano rialzato' END",
}


def sales(spark, sf_dir):
    df = listings(spark, sf_dir, dealt=True)
    df = df.select(*[F.expr(SALE[n]).alias(n) if n in SALE else F.col(n) for n in df.columns])
    df = df.withColumns({n: F.expr(e) for n, e in EXTRA.items()})
    kinds = {"fake": F.col("id") % 37 == 0, "nuda": F.col("id") % 41 == 0, "auction": F.col("id") % 43 == 0}
    df = df.withColumn("excluded_reason", scoring.excluded_reason(kinds, F.col("city")))
    df = df.withColumn("delta_pct", sc.exactly((F.col("ask_psqm") - F.col("blended_median")) / F.col("blended_median"), 4))
    return scoring.composite_sale(df, S)


COLUMNS = ["id", "excluded_reason", "delta_label", "score_price", "score_physical", "score_location", "score_penalty", "score_total", "score_was_capped", "gate", "extreme_underpricing", "hidden_gem", "good_value", "comps_label", "confidence_label", "estimated_yield_pct", "vs_omi_pct", "vs_omi_label"]
LOOSE = Settings(gem=(60, 40, 5, 45, 40, 20, 55), good_value=(50, 20, 20, 40, 20, 20, 40))


def composite_sale(spark, sf_dir):
    return sales(spark, sf_dir).select(*COLUMNS)


def sale_badges(spark, sf_dir):
    """The stand-alone tests for sales, under thresholds that the data can pass."""
    return sales(spark, sf_dir).select("id", *scoring.sale_gates(LOOSE))


def best_sales(spark, sf_dir):
    """Scored sales with a price a square metre, best first."""
    df = sales(spark, sf_dir).where("excluded_reason IS NULL AND ask_psqm > 0")
    return df.select("id", "score_total").orderBy(F.desc("score_total"), "id").limit(50)


def all_reasons(spark, sf_dir):
    df = sales(spark, sf_dir).where("excluded_reason IS NULL").withColumn("room_flag", sc.room_flag(F.col("sqm"), F.col("rooms")))
    top = scoring.weightiest(scoring.reasons_table())
    return df.select("id", F.concat_ws(" ", *[F.when(r.isNotNull(), F.concat_ws(":", r["component"], r["sentiment"], r["key"])) for r in top]).alias("reasons"))


def explained(spark, sf_dir):
    return sales(spark, sf_dir).where("excluded_reason IS NULL").withColumn("room_flag", sc.room_flag(F.col("sqm"), F.col("rooms")))


def sale_explanations(spark, sf_dir):
    return explained(spark, sf_dir).select("id", F.array_join(scoring.full_explanation(sale=True), " | ").alias("lines"))


def rent_explanations(spark, sf_dir):
    """The lines for rentals, over the same scores."""
    return explained(spark, sf_dir).select("id", F.array_join(scoring.full_explanation(), " | ").alias("lines"))


def score_violations(spark, sf_dir):
    """How many sales break each rule of the scores; every count must be 0."""
    c = F.col
    rules = {
        "excluded but scored": c("excluded_reason").isNotNull() & (c("score_total") != 0), "far above comparables": (c("delta_label") > 10) & (c("score_total") > 50), "above comparables": (c("delta_label") > 5) & (c("score_total") > 62),
        "below ground": (c("floor_n") < 0) & (c("score_total") > 55), "gem under its total": c("hidden_gem") & (c("score_total") < S.gem[0]), "gem and good value": c("hidden_gem") & c("good_value"), "gate and badge": c("gate") & (c("hidden_gem") | c("good_value")),
    }
    counts = sales(spark, sf_dir).agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


QUERIES = {f.__name__: f for f in (composite_sale, sale_badges, best_sales, all_reasons, sale_explanations, rent_explanations, score_violations)}

_KIND = "CASE WHEN id % 37 = 0 THEN 'fake' WHEN id % 41 = 0 THEN 'nuda_proprieta' WHEN id % 43 = 0 THEN 'auction' WHEN ask_psqm <> 0 AND coalesce(sqm, 0) <> 0 AND price <> 0 AND ask_psqm < CASE city WHEN 'Milano' THEN 800 WHEN 'Roma' THEN 600 ELSE 400 END THEN 'price_floor' END"
_GATE = lambda m, cmp: f"score_total {cmp} {m[0]} AND l >= {m[1]} AND coalesce(delta_label <= {m[2]}, FALSE) AND score_physical >= {m[3]} AND score_location >= {m[4]} AND confidence >= {m[5]} AND score_penalty >= {m[6]}"
SCORED = f"""WITH {SQL.replace('listings AS', 'raw_listings AS', 1)}, listings AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in SALE.items())}) FROM raw_listings){PHYS},
s0 AS (SELECT * EXCLUDE (score_penalty), CAST(greatest(0, score_penalty - CASE WHEN ask_psqm > compr_max * 1.3::DOUBLE THEN 20 ELSE 0 END) AS INT) AS score_penalty FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in EXTRA.items())}, {_KIND} AS excluded_reason FROM phys)),
s1 AS (SELECT *, {R2('(ask_psqm - blended_median) / blended_median', 4)} AS d FROM s0),
s2 AS (SELECT *, {R2('d * 100', 1)} AS delta_label, CASE WHEN d <= -0.15 THEN 100 WHEN d <= -0.03 THEN 100 - (d + 0.15::DOUBLE) / (-0.03::DOUBLE + 0.15::DOUBLE) * 50 WHEN d <= 0.03 THEN 50 WHEN d <= 0.2 THEN 50 - (d - 0.03::DOUBLE) / (0.2::DOUBLE - 0.03::DOUBLE) * 50 ELSE 0 END::DOUBLE AS raw0, abs(price - blended_median * sqm) AS diff FROM s1),
s3 AS (SELECT *, CASE WHEN raw0 < 50 AND coalesce(sqm, 0) > 0 AND price > 0 THEN 50 - (50 - raw0) * CASE WHEN diff < 50 THEN 0.7 WHEN diff > 100 THEN 1.0 ELSE 0.7::DOUBLE + 0.3::DOUBLE * (diff - 50) / 50 END ELSE raw0 END::DOUBLE AS ps FROM s2),
s4 AS (SELECT *, CAST(round_even(CAST(ps AS DECIMAL(18,6)), 0) AS INT) AS sp, CAST(round_even(CAST(CASE WHEN d <= 0 AND boost THEN least(100, ps * (1 + greatest(0, (ldi - 50) / 50 * 0.10::DOUBLE))) ELSE ps END AS DECIMAL(18,6)), 0) AS INT) AS boosted FROM s3),
s5 AS (SELECT *, CAST(greatest(0, least(100, round_even(CAST(boosted * 0.45::DOUBLE + score_physical * 0.25::DOUBLE + geo_score * 0.20::DOUBLE + score_penalty * 0.10::DOUBLE AS DECIMAL(18,6)), 0))) AS INT) AS t0 FROM s4),
s6 AS (SELECT *, CASE WHEN score_physical < 40 THEN least(t0, 75) ELSE t0 END AS r6 FROM s5),
s7 AS (SELECT *, least(r6, CASE WHEN delta_label <= 0 THEN 100 WHEN delta_label <= 5 THEN 72 WHEN delta_label <= 10 THEN 62 WHEN delta_label <= 20 THEN 50 ELSE 38 END, CASE WHEN floor_n < 0 THEN 55 ELSE 100 END) AS c0,
  CASE WHEN sqm > 0 AND sqm < 60 AND ask_psqm > 0 THEN CASE WHEN ask_psqm >= 7000 THEN 55 WHEN ask_psqm >= 5800 AND sqm <= 58 THEN 65 WHEN ask_psqm >= 5000 AND sqm <= 45 THEN 70 END END AS top FROM s6),
s8 AS (SELECT *, coalesce(top < c0, FALSE) AS fired, least(c0, coalesce(top, 100)) AS score_total, geo_score AS score_location, ldi AS l, delta_label < -40 AS extreme, excluded_reason IS NULL AS live FROM s7),
s9 AS (SELECT *, NOT fired AND {_GATE(S.gem, '>=')} AS gem, NOT fired AND {_GATE(S.good_value, '>')} AS good FROM s8),
out AS (SELECT id, floor_n, sqm, rooms, condition, elevator, bathrooms, has_balcony, year_built, days_on_market, room_flag, floor_label, spese_condominiali, ask_psqm, compr_max, n_comps, corporate, condo_fee_flag, metro_walk_min, metro_m, park_m, supermarket_m, ldi, confidence, excluded_reason, delta_label,
  CASE WHEN live THEN sp ELSE 0 END AS score_price, CASE WHEN live THEN score_physical ELSE 0 END AS score_physical, CASE WHEN live THEN score_location ELSE 0 END AS score_location, CASE WHEN live THEN score_penalty ELSE 0 END AS score_penalty,
  CAST(CASE WHEN NOT live THEN 0 WHEN extreme THEN least(score_total, 55) ELSE score_total END AS INT) AS score_total, live AND score_total < r6 AS score_was_capped, live AND fired AS gate, live AND extreme AS extreme_underpricing, live AND gem AND NOT extreme AS hidden_gem, live AND good AND NOT gem AND NOT extreme AS good_value,
  CASE WHEN NOT live THEN NULL WHEN abs(delta_label) < 0.5 THEN 'at comps median' WHEN delta_label > 0 THEN '+' || printf('%.1f', delta_label) || '% above nearby sales' ELSE printf('%.1f', delta_label) || '% below nearby sales' END AS comps_label,
  CASE WHEN NOT live THEN NULL WHEN confidence >= 70 THEN 'High' WHEN confidence >= 40 THEN 'Medium' ELSE 'Low' END AS confidence_label,
  CASE WHEN live AND loc_mid > 0 AND sqm > 0 AND price > 0 THEN {R2("loc_mid * sqm * CASE WHEN sqm < 50 THEN 1.20 WHEN sqm <= 85 THEN 1.0 WHEN sqm <= 115 THEN 0.9 WHEN sqm <= 145 THEN 0.82 ELSE 0.75 END::DOUBLE * CASE WHEN condition = 'Ottimo' THEN 1.0 WHEN condition = 'da ristrutturare' THEN 0.70 ELSE 0.85 END::DOUBLE * 12 / price * 100")} END AS estimated_yield_pct,
  CASE WHEN live THEN {R2('(ask_psqm - compr_mid) / compr_mid * 100', 1)} END AS vs_omi_pct FROM s9),
scored AS (SELECT *, CASE WHEN abs(vs_omi_pct) < 0.5 THEN 'at OMI' WHEN vs_omi_pct > 0 THEN '+' || printf('%.1f', vs_omi_pct) || '% above OMI' WHEN vs_omi_pct IS NOT NULL THEN printf('%.1f', vs_omi_pct) || '% below OMI' END AS vs_omi_label FROM out)"""


def _ladder(n: int, component: str, steps: list[tuple[str, str, int, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {{'w': {w}, 'n': {n}, 'c': '{component}', 'm': '{mood}', 'k': '{key}'}}" for cond, mood, w, key in steps) + " END"


_STRONG = "(CASE WHEN renovated THEN 1 ELSE 0 END + CASE WHEN floor_n >= 3 AND elevator THEN 1 ELSE 0 END + CASE WHEN bathrooms >= 2 THEN 1 ELSE 0 END + CASE WHEN has_balcony THEN 1 ELSE 0 END + CASE WHEN year_built >= 2010 THEN 1 ELSE 0 END)"
_WEAK = "((floor_n <= 2 AND coalesce(NOT elevator, TRUE)) IS TRUE OR (state IN ('buono', 'abitabile') AND strong = 0) OR (year_built >= 1960 AND year_built < 1990 AND NOT renovated) IS TRUE OR (NOT has_balcony) IS TRUE)"
_AWAY = "((walk >= 10) IS TRUE OR park_m > 600 OR supermarket_m > 500)"
_ROWS = [
    _ladder(0, "Price", [("n_comps >= 10 AND delta_label <= -15", "positive", 9, "far_below"), ("n_comps >= 10 AND delta_label <= -8", "positive", 6, "far_below"), ("n_comps >= 10 AND delta_label <= -3", "neutral", 2, "below"), ("n_comps >= 10 AND delta_label < 5", "neutral", 1, "at_market"), ("n_comps >= 10 AND delta_label < 8", "neutral", 2, "above"), ("n_comps >= 10 AND delta_label < 15", "negative", 6, "far_above"), ("n_comps >= 10 AND delta_label >= 15", "negative", 9, "far_above")]),
    _ladder(1, "Price", [("gate", "negative", 11, "gate")]),
    _ladder(2, "Price", [("corporate", "negative", 8, "corporate")]),
    _ladder(3, "Price", [("condo_fee_flag = 'high_condo_fees'", "negative", 7, "high_condo")]),
    _ladder(4, "Price", [("corporate", "negative", 8, "corporate_let")]),
    _ladder(5, "Location", [("walk <= 3", "positive", 7, "very_close"), ("walk <= 7", "positive", 4, "close"), ("walk >= 18", "negative", 6, "far"), ("walk >= 13", "negative", 4, "limited")]),
    _ladder(6, "Location", [("ldi >= 80 AND delta_label <= -8", "positive", 9, "bargain"), ("ldi <= 20 AND score_total >= 70", "negative", 4, "weak_zone")]),
    _ladder(7, "Property", [("strong >= 2", "positive", 5, "strengths")]),
    _ladder(8, "Property", [("floor_n < 0", "negative", 9, "subterranean"), ("floor_n = 0", "negative", 6, "ground"), ("floor_label = 'Piano rialzato'", "negative", 5, "rialzato"), ("floor_n > 2 AND NOT elevator", "negative", 8, "no_lift")]),
    _ladder(9, "Property", [("state = 'da ristrutturare'", "negative", 6, "renovation")]),
    _ladder(10, "Property", [("room_flag = 'severe'", "negative", 8, "studio_partition"), ("room_flag = 'tight'", "negative", 5, "cramped_layout"), ("room_flag = 'micro_studio'", "negative", 8, "small_studio"), ("room_flag = 'small_studio'", "negative", 6, "small_studio"), ("room_flag = 'compact_studio'", "negative", 3, "small_studio")]),
    _ladder(11, "Property", [("year_built < 1960 AND NOT renovated", "negative", 4, "old_unrenovated")]),
    _ladder(12, "Penalty", [("days_on_market > 90", "negative", 5, "stale"), ("days_on_market <= 7", "positive", 2, "fresh")]),
    _ladder(13, "Price", [("estimated_yield_pct >= 5", "positive", 6, "strong_yield"), ("estimated_yield_pct < 3", "negative", 5, "weak_yield_pct")]),
]
_POOR = "len(list_filter(found, lambda r: r.c = '{}' AND r.m = 'negative')) = 0"
_MORE = [
    _ladder(100, "Property", [(f"score_physical <= 55 AND {_POOR.format('Property')} AND {_WEAK}", "negative", 4, "below_avg"), (f"score_physical <= 55 AND {_POOR.format('Property')}", "negative", 3, "limited")]),
    _ladder(101, "Location", [(f"score_location <= 55 AND {_POOR.format('Location')} AND {_AWAY}", "negative", 4, "below_avg"), (f"score_location <= 55 AND {_POOR.format('Location')} AND coalesce(walk > 5, TRUE)", "negative", 3, "quiet")]),
]
_WHOLE = "CAST(round_even(CAST(abs(delta_label) AS DECIMAL(18,6)), 0) AS INT)"
_VERDICT = "CASE WHEN score_total >= 85 THEN 'rare find' WHEN score_total >= 72 THEN 'solid' WHEN score_total >= 60 THEN 'reasonable' WHEN score_total >= 45 THEN 'overpriced' ELSE 'not worth the time' END"
_PRICE = f"CASE WHEN delta_label <= -10 THEN {_WHOLE} || '% under ' || n_comps || ' others' WHEN delta_label <= -3 THEN {_WHOLE} || '% under' WHEN delta_label <= 5 THEN 'in line' WHEN delta_label <= 15 THEN {_WHOLE} || '% over' WHEN delta_label > 15 THEN 'far over, ' || {_WHOLE} || '%' END"
_PLACE = "CASE WHEN metro_walk_min <= 5 THEN 'metro in ' || metro_walk_min || ' min, excellent' WHEN metro_walk_min <= 12 THEN 'metro in ' || metro_walk_min || ' min, decent' WHEN metro_walk_min IS NOT NULL THEN 'metro in ' || metro_walk_min || ' min, limited' END"
_YIELD = "CASE WHEN estimated_yield_pct >= 5 THEN 'strong yield' WHEN estimated_yield_pct >= 3.5 THEN 'fair yield' WHEN estimated_yield_pct IS NOT NULL THEN 'weak yield' END"
_FLAT = "CASE WHEN floor_n < 0 THEN 'below ground' WHEN floor_n = 0 THEN 'ground floor' WHEN floor_n > 2 AND NOT elevator THEN 'floor ' || floor_n || ', no lift' WHEN room_flag = 'severe' THEN 'cramped' WHEN room_flag = 'tight' THEN 'tight' WHEN room_flag IS NOT NULL THEN replace(room_flag, '_', ' ') WHEN condition = 'Ottimo' THEN CASE WHEN floor_n >= 3 AND elevator THEN 'renovated, floor ' || floor_n || ' with lift' ELSE 'renovated' END END"


def _lines(sale: bool) -> str:
    corporate = "FALSE" if sale else "corporate"
    leads = [f"CASE WHEN score_was_capped AND delta_label > 0 AND NOT gate AND NOT {corporate} THEN 'capped, ' || {_WHOLE} || '% over' END", "CASE WHEN gate THEN 'capped, poor value on ' || coalesce(sqm, 0) || ' m2' END"]
    leads += [] if sale else ["CASE WHEN condo_fee_flag IS NOT NULL THEN 'fees of ' || coalesce(spese_condominiali, 0) END", "CASE WHEN corporate THEN 'corporate let' END", "CASE WHEN corporate THEN 'capped at 75' END"]
    body = [_VERDICT, _PRICE, _YIELD if sale else _PLACE, _FLAT]
    more = "CASE WHEN ask_psqm > compr_max * 1.3::DOUBLE THEN 'over the zone''s ceiling' END" if sale else "CASE WHEN days_on_market > 90 THEN 'listed for ' || days_on_market || ' days' WHEN days_on_market > 45 THEN days_on_market || ' days on the market' END"
    kept = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    return f"{SCORED}, b AS (SELECT s.*, {kept(body)} AS body, {kept(leads)} AS leads, {more} AS more FROM scored s WHERE excluded_reason IS NULL) SELECT id, array_to_string(list_concat(leads, body, CASE WHEN len(body) < 4 AND more IS NOT NULL THEN [more] ELSE [] END)[1:4], ' | ') AS lines FROM b"


ORACLE_SQL = {
    "sale_explanations": _lines(True),
    "rent_explanations": _lines(False),
    "composite_sale": f"{SCORED} SELECT {', '.join(COLUMNS)} FROM scored",
    "sale_badges": f"{SCORED}, g AS (SELECT *, ldi AS l FROM scored), h AS (SELECT id, {_GATE(LOOSE.gem, '>=')} AS is_sale_gem, {_GATE(LOOSE.good_value, '>=')} AS v FROM g) SELECT id, is_sale_gem, v AND NOT is_sale_gem AS is_sale_good_value FROM h",
    "best_sales": f"{SCORED} SELECT id, score_total FROM scored WHERE excluded_reason IS NULL AND ask_psqm > 0 ORDER BY score_total DESC, id LIMIT 50",
    "all_reasons": f"""{SCORED}, w AS (SELECT *, coalesce(metro_walk_min, CASE WHEN metro_m > 0 THEN greatest(1, CAST(round_even(CAST(metro_m / 70 AS DECIMAL(18,6)), 0) AS INT)) END) AS walk, coalesce(lower(condition), '') AS state, lower(condition) IN ('ottimo', 'nuova costruzione') AND lower(condition) = 'ottimo' AS ren FROM scored WHERE excluded_reason IS NULL),
w1 AS (SELECT *, coalesce(ren, FALSE) AS renovated FROM w), w2 AS (SELECT *, {_STRONG} AS strong FROM w1),
f AS (SELECT *, list_filter([{', '.join(_ROWS)}], lambda r: r IS NOT NULL) AS found FROM w2),
a AS (SELECT id, list_concat(found, list_filter([{', '.join(_MORE)}], lambda r: r IS NOT NULL)) AS everything FROM f),
u AS (SELECT id, unnest(everything) AS r FROM a), k AS (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY r.w DESC, r.n) AS k FROM u)
SELECT a.id, coalesce(string_agg(r.c || ':' || r.m || ':' || r.k, ' ' ORDER BY k) FILTER (k <= 3), '') AS reasons FROM a LEFT JOIN k USING (id) GROUP BY a.id""",
    "score_violations": f"""{SCORED} SELECT unnest(['excluded but scored', 'far above comparables', 'above comparables', 'below ground', 'gem under its total', 'gem and good value', 'gate and badge']) AS rule,
unnest([count(*) FILTER (excluded_reason IS NOT NULL AND score_total <> 0), count(*) FILTER (delta_label > 10 AND score_total > 50), count(*) FILTER (delta_label > 5 AND score_total > 62), count(*) FILTER (floor_n < 0 AND score_total > 55), count(*) FILTER (hidden_gem AND score_total < 80), count(*) FILTER (hidden_gem AND good_value), count(*) FILTER (gate AND (hidden_gem OR good_value))]) AS n FROM scored""",
}
