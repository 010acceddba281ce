"""Queries on benchmarks, scores, quality and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import bands, comps, digest, lookup, quality, ranks, rules, scoring
from estimark.plans.listings import SQL, listings
from estimark.settings import Settings

S = Settings(year=2026)
BAND = "b.sqm BETWEEN a.sqm * (1 - CASE WHEN a.sqm <= 50 THEN 0.15 WHEN a.sqm <= 75 THEN 0.20 ELSE 0.25 END) AND a.sqm * (1 + CASE WHEN a.sqm <= 50 THEN 0.15 WHEN a.sqm <= 75 THEN 0.20 ELSE 0.25 END)"
BAND = BAND.replace("0.15", "0.15::DOUBLE").replace("0.20", "0.20::DOUBLE").replace("0.25", "0.25::DOUBLE")
HAVERSINE = "round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))), 3)"
R2 = lambda x, n=2: f"CAST(ROUND(CAST({x} AS DECIMAL(18,6)), {n}) AS DOUBLE)"
CGROUP = "CASE WHEN condition IS NULL THEN 'unknown' WHEN lower(condition) LIKE '%da %ristruttur%' THEN 'needs_work' WHEN lower(condition) LIKE '%ottim%' OR lower(condition) LIKE '%costruz%' THEN 'premium' WHEN lower(condition) IN ('buono', 'abitabile') THEN 'standard' ELSE 'unknown' END"
FACTOR = "CASE WHEN a.cgroup = 'unknown' THEN 1 WHEN b.cgroup = 'premium' AND a.cgroup = 'standard' THEN 0.78 WHEN b.cgroup = 'premium' AND a.cgroup = 'needs_work' THEN 0.62 WHEN b.cgroup = 'standard' AND a.cgroup = 'premium' THEN 1.28 WHEN b.cgroup = 'standard' AND a.cgroup = 'needs_work' THEN 0.80 WHEN b.cgroup = 'needs_work' AND a.cgroup = 'premium' THEN 1.61 WHEN b.cgroup = 'needs_work' AND a.cgroup = 'standard' THEN 1.25 ELSE 1 END::DOUBLE"


def robust_sql(source: str, keys: str) -> str:
    """CTEs t1..stats over ``source`` (keys, prices list): trimmed prices and their statistics."""
    pick = lambda p: f"(s[CAST(floor((n_comps - 1) * {p}::DOUBLE) AS INT) + 1] + (s[CAST(ceil((n_comps - 1) * {p}::DOUBLE) AS INT) + 1] - s[CAST(floor((n_comps - 1) * {p}::DOUBLE) AS INT) + 1]) * ((n_comps - 1) * {p}::DOUBLE - floor((n_comps - 1) * {p}::DOUBLE)))"
    return f"""
t1 AS (SELECT {keys}, list_sort(prices) AS s, len(prices) AS n FROM {source}),
t2 AS (SELECT {keys}, n AS n_raw, s AS s0, CASE WHEN n >= 4 THEN list_filter(s, lambda v: v >= s[n // 4 + 1] - (s[3 * n // 4 + 1] - s[n // 4 + 1]) * 1.5::DOUBLE AND v <= s[3 * n // 4 + 1] + (s[3 * n // 4 + 1] - s[n // 4 + 1]) * 1.5::DOUBLE) ELSE s END AS s FROM t1),
t3 AS (SELECT {keys}, n_raw, CASE WHEN len(s) = 0 THEN s0 ELSE s END AS s FROM t2),
t4 AS (SELECT {keys}, n_raw, CASE WHEN len(s) >= 30 THEN s[greatest(1, CAST(floor(len(s) * 0.05::DOUBLE) AS INT)) + 1 : len(s) - greatest(1, CAST(floor(len(s) * 0.12::DOUBLE) AS INT))]
  WHEN len(s) >= 15 THEN s[1 : len(s) - greatest(1, CAST(floor(len(s) * 0.08::DOUBLE) AS INT))] ELSE s END AS s FROM t3),
stats AS (SELECT {keys}, n_raw, n_comps, {pick(0.5)} AS median, {pick(0.4)} AS p40, {pick(0.6)} AS p60,
  CASE WHEN n_comps < 2 THEN 0 ELSE list_aggregate(s, 'stddev_samp') END AS stdev FROM (SELECT *, len(s) AS n_comps FROM t4))"""


def bench_input(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("psqm", F.col("ask_psqm"))


def comps_zone_median(spark, sf_dir):
    """The ten best offers against the robust median of comparables of their zone."""
    base = bench_input(spark, sf_dir).select("id", "zone", "psqm", "sqm", F.lit("unknown").alias("cgroup"))
    out = bands.band_stats(base.where("sqm > 0"), base, "zone", None, ["psqm", "zone"]).where("n_raw >= 5")
    delta = sc.exactly((F.col("psqm") - F.col("median")) / F.col("median"), 4)
    return out.select("id", "zone", "n_raw", "n_comps", sc.exactly(F.col("median"), 2).alias("median"), delta.alias("delta_pct")).orderBy("delta_pct", "id").limit(10)


def comps_cascade(spark, sf_dir):
    return comps.cascade(bench_input(spark, sf_dir), S)


def comps_cascade_sale(spark, sf_dir):
    """The same for sales: prices a square metre, a wider spread, more weight on the zone price."""
    df = bench_input(spark, sf_dir).withColumns({"psqm": sc.exactly(F.col("price") / F.col("sqm"), 0), "omi_mid": F.col("omi_mid") * 160})
    return comps.cascade(df, S, sale=True)


def robust_trim_stats(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_size", F.col("p_retailprice").cast("double").alias("x"))
    out = comps.robust(part.groupBy("p_brand", "p_size").agg(F.collect_list("x").alias("prices")), "prices")
    return out.select("p_brand", "p_size", "n_raw", "n_comps", *[sc.exactly(F.col(c), 2).alias(c) for c in ("median", "p40", "p60", "stdev")])


def comp_top_k(spark, sf_dir):
    base = bench_input(spark, sf_dir).select("id", "psqm", "sqm", "zone", "lat", "lng")
    return bands.top_comparables(base.where("sqm > 0"), base, "zone", 30).select("id", F.concat_ws(",", F.transform("comp_ids", lambda x: x.cast("string"))).alias("comp_ids"))


def physical_scores(spark, sf_dir):
    df = listings(spark, sf_dir)
    return df.select("id", sc.exactly(sc.floor_coefficient(F.col("floor_n"), F.col("elevator")), 4).alias("floor_coefficient"), sc.condition_group(F.col("condition")).alias("condition_group"),
                     sc.room_flag(F.col("sqm"), F.col("rooms")).alias("room_flag"), sc.property_score(S.year).alias("score_physical"), sc.penalty_score(S).alias("score_penalty"))


def with_scores(spark, sf_dir):
    """Listings scored against a benchmark that the SQL can state: 20 or the zone price."""
    df = listings(spark, sf_dir).withColumns({
        "blended_median": F.coalesce("omi_mid", F.lit(20.0)), "ldi": (F.col("id") % 101).cast("double"), "geo_score": (F.col("id") * 3 % 101).cast("int"), "confidence": (F.col("id") % 5 * 20).cast("int"),
        "n_comps": (F.col("id") % 40).cast("int"), "boost": F.col("id") % 2 == 0, "corporate": F.col("id") % 31 == 0,
    })
    return scoring.composite(df.withColumn("delta_pct", sc.exactly((F.col("ask_psqm") - F.col("blended_median")) / F.col("blended_median"), 4)), S)


def composite_score(spark, sf_dir):
    return with_scores(spark, sf_dir).select("id", "delta_label", "score_price", "score_total", "score_was_capped", "gate", "extreme_underpricing", "hidden_gem", "good_value", "comps_label", "confidence_label")


def gem_gate(spark, sf_dir):
    df = with_scores(spark, sf_dir).withColumn("metro_m", (F.col("id") * 17 % 1500).cast("int"))
    loose = Settings(gem=(50, 30, 30, 40, 40, 20, 50))
    return df.select("id", scoring.gem_gate(loose).alias("strict_gem"))


def good_value_gate(spark, sf_dir):
    """The stand-alone test at thresholds that some rows meet exactly."""
    df = with_scores(spark, sf_dir).withColumn("metro_m", (F.col("id") * 17 % 1500).cast("int"))
    loose = Settings(gem=(50, 30, 30, 40, 40, 20, 50), good_value=(45, 20, 40, 30, 20, 20, 50))
    return df.select("id", scoring.good_value_gate(loose).alias("good_value"))


def explanations(spark, sf_dir):
    return with_scores(spark, sf_dir).select("id", F.concat_ws(" | ", scoring.explanation()).alias("bullets"))


def score_reasons(spark, sf_dir):
    c = F.col
    reasons = [
        (c("delta_label") < -5, "price", "below comparables", F.abs("delta_label")), (c("delta_label") > 5, "price", "above comparables", F.abs("delta_label")),
        (c("floor_n") < 0, "property", "below ground", F.lit(40)), (c("score_physical") >= 70, "property", "in good shape", c("score_physical") / 4),
        (c("geo_score") >= 70, "location", "well served", c("geo_score") / 4), (c("days_on_market") > 60, "market", "slow to sell", F.lit(12)), (c("score_penalty") < 70, "penalty", "has drawbacks", 100 - c("score_penalty")),
    ]
    return with_scores(spark, sf_dir).select("id", F.concat_ws(" | ", scoring.top_reasons(reasons)).alias("reasons"))


def effective_rent(spark, sf_dir):
    return listings(spark, sf_dir).select("id", *sc.effective_rent())


def suggested_rent(spark, sf_dir):
    return listings(spark, sf_dir).select("id", *scoring.suggested_rent())


def excluded_listings(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("ask_psqm", F.col("ask_psqm") * 30)
    kinds = {"fake": F.col("id") % 37 == 0, "nuda": F.col("id") % 41 == 0, "auction": F.col("id") % 43 == 0}
    return df.select("id", scoring.excluded_reason(kinds, F.col("city")).alias("excluded_reason")).where("excluded_reason IS NOT NULL")


def fascia_percentile(spark, sf_dir):
    """Share of the fascia's listings that are no dearer (50 where none has a price), and the simple
    score built on it. Brushed fascias' prices are unknown here, so they have no peers."""
    df = listings(spark, sf_dir).withColumn("ask_psqm", F.when(F.col("fascia").contains("BRUSHED"), None).otherwise(F.col("ask_psqm"))).where("ask_psqm > 0 OR ask_psqm IS NULL")
    df = ranks.share_up_to(df, "fascia", "ask_psqm", "share").withColumn("pct", F.coalesce(F.col("share") * 100, F.lit(50.0)))
    vs = (F.col("ask_psqm") - F.col("omi_mid")) / F.col("omi_mid")
    return df.select("id", sc.exactly(F.col("pct"), 2).alias("fascia_pct"), rules.simple_score(F.col("pct"), vs, False).alias("simple_score"))


def ldi_by_zone(spark, sf_dir):
    zones = listings(spark, sf_dir).groupBy("fascia", "zone").agg(F.avg(F.col("ask_psqm").cast("decimal(18,6)")).cast("decimal(18,6)").cast("double").alias("mid"))
    out = lookup.desirability(zones, "fascia", "mid").join(lookup.upper_fifth(zones, "fascia", "mid"), "fascia")
    return out.select("fascia", "zone", sc.exactly(F.col("ldi"), 2).alias("ldi"), sc.exactly(F.col("threshold"), 4).alias("threshold"))


QUALITY = {"critical": ["id", "rent_mo", "sqm", "lat", "lng", "omi_mid"], "important": ["floor_n", "elevator", "condition", "is_external", "rooms"], "useful": ["has_balcony", "has_parking", "energy_class", "heating_type", "furnished", "year_built"]}


def quality_audit(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("omi_source", F.when(F.col("id") % 7 == 0, "centroid").otherwise("polygon"))
    return quality.audit(df, QUALITY)


def quality_grades(spark, sf_dir):
    return quality_audit(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n"), F.count_if("needs_reenrichment").alias("n_reenrich"))


def field_coverage(spark, sf_dir):
    return quality.coverage(listings(spark, sf_dir), [f for fs in QUALITY.values() for f in fs])


def digest_topk(spark, sf_dir):
    rules = spark.createDataFrame([(1, "Milano", 1500, None, None, True), (2, "Roma", None, 40, 40, True), (3, "Napoli", 1200, 30, 20, False), (4, "Torino", 2000, 25, 30, True), (5, "Milano", None, None, 50, True)], "rule_id int, city string, max_rent int, min_sqm int, min_score int, active boolean")
    df = listings(spark, sf_dir).select("id", "city", "rent_mo", "sqm", (F.col("id") * 7 % 101).cast("int").alias("score_total"), (F.col("id") % 3 == 0).alias("is_new"), (F.col("id") % 5 == 0).alias("dropped"))
    return digest.matches(rules, df, 50)


def digest_hour(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4 != 0).alias("active"), F.when(F.col("c_custkey") % 10 == 0, None).when(F.col("c_custkey") % 11 == 0, "soon").otherwise(F.concat((F.col("c_custkey") % 24).cast("string"), F.lit(":30"))).alias("send_time_utc"))
    return digest.due(users, 7).select("id")


def filtered_counts(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.count_if("elevator").alias("n_lift"), F.count_if(F.col("floor_n") < 0).alias("n_below"), F.max("floor_n").alias("top_floor"))


def condition_lists(spark, sf_dir):
    """Ids of each zone's renovation cases, in order of price."""
    df = listings(spark, sf_dir).where("condition = 'da ristrutturare'").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("ask_psqm", "id"))).alias("x"))
    return df.select("zone", F.concat_ws(",", F.transform("x", lambda s: s["id"].cast("string"))).alias("ids"))


def top_scores(spark, sf_dir):
    return with_scores(spark, sf_dir).select("id", "score_total").orderBy(F.desc(F.coalesce("score_total", F.lit(0))), "id").limit(24)


QUERIES = {f.__name__: f for f in (comps_zone_median, comps_cascade, comps_cascade_sale, robust_trim_stats, comp_top_k, physical_scores, composite_score, gem_gate, good_value_gate, explanations, score_reasons, effective_rent, suggested_rent, excluded_listings, fascia_percentile,
                                   ldi_by_zone, quality_audit, quality_grades, field_coverage, digest_topk, digest_hour, filtered_counts, condition_lists, top_scores)}

FLOOR_UP = "CASE WHEN floor_n <= -2 THEN -0.25 WHEN floor_n = -1 THEN -0.20 WHEN floor_n <= 1 THEN -0.10 WHEN floor_n = 2 THEN -0.03 WHEN floor_n = 3 THEN 0.0 WHEN floor_n <= 5 THEN 0.05 WHEN floor_n <= 9 THEN 0.10 ELSE 0.20 END::DOUBLE"
FLOOR_DOWN = "CASE WHEN floor_n <= -2 THEN -0.25 WHEN floor_n = -1 THEN -0.20 WHEN floor_n <= 1 THEN -0.10 WHEN floor_n = 2 THEN -0.15 WHEN floor_n = 3 THEN -0.20 WHEN floor_n <= 5 THEN -0.25 WHEN floor_n <= 9 THEN -0.30 ELSE -0.20 END::DOUBLE"
PHYS = f""",
p0 AS (SELECT *, {FLOOR_UP} AS up, {FLOOR_DOWN} AS down, {CGROUP} AS cg, lower(condition) AS cond, 2026 - year_built AS age,
  CASE WHEN coalesce(sqm, 0) > 0 THEN CASE WHEN coalesce(rooms, 0) >= 2 THEN CASE WHEN sqm / rooms < 10 THEN 'severe' WHEN sqm / rooms < 14 THEN 'tight' END
    WHEN sqm < 30 THEN 'micro_studio' WHEN sqm < 38 THEN 'small_studio' WHEN sqm < 45 THEN 'compact_studio' END END AS room_flag FROM listings),
p1 AS (SELECT *, CASE WHEN floor_n IS NULL THEN 0 WHEN elevator IS NULL THEN CASE WHEN floor_n > 3 THEN down * 0.6::DOUBLE + up * 0.4::DOUBLE ELSE (up + down) / 2 END WHEN elevator THEN up ELSE down END::DOUBLE AS fl FROM p0),
p2 AS (SELECT *, fl + CASE WHEN cond LIKE 'da ristruttur%' THEN -0.10 WHEN cond IN ('ottimo', 'nuova costruzione') THEN 0.10 ELSE 0 END::DOUBLE
  + CASE WHEN year_built <= 1900 OR year_built IS NULL THEN 0 WHEN age > 40 AND cond IN ('ottimo', 'nuova costruzione') THEN 0.05 WHEN age > 20 AND age <= 40 AND cond IN ('ottimo', 'nuova costruzione') THEN 0.02 WHEN age > 40 AND cond LIKE 'da %' THEN -0.05 ELSE 0 END::DOUBLE
  + CASE WHEN is_external THEN 0.05 ELSE 0 END::DOUBLE + CASE upper(energy_class) WHEN 'A4' THEN 0.08 WHEN 'B' THEN 0.04 WHEN 'C' THEN 0.02 WHEN 'E' THEN -0.02 WHEN 'G' THEN -0.06 ELSE 0 END::DOUBLE
  + CASE WHEN has_balcony THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN has_parking THEN 0.04 ELSE 0 END::DOUBLE
  + CASE WHEN heating_type = 'Autonomo' THEN 0.05 WHEN heating_type LIKE '%valvole' THEN 0.02 WHEN heating_type = 'assente' THEN -0.03 ELSE 0 END::DOUBLE
  + CASE WHEN furnished THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN bathrooms >= 2 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN photo_count < 5 THEN -0.05 ELSE 0 END::DOUBLE
  + CASE WHEN days_on_market > 60 THEN -0.07 WHEN days_on_market > 30 THEN -0.03 ELSE 0 END::DOUBLE
  + CASE WHEN spese_condominiali > rent_mo * 0.20::DOUBLE THEN -0.10 WHEN spese_condominiali > rent_mo * 0.12::DOUBLE THEN -0.04 ELSE 0 END::DOUBLE
  + CASE room_flag WHEN 'severe' THEN -0.20 WHEN 'tight' THEN -0.10 WHEN 'micro_studio' THEN -0.25 WHEN 'small_studio' THEN -0.15 WHEN 'compact_studio' THEN -0.08 ELSE 0 END::DOUBLE AS adj FROM p1),
phys AS (SELECT *, CAST(greatest(0, least(100, round_even(CAST(50 + adj * 150 AS DECIMAL(18,6)), 0))) AS INT) AS score_physical,
  CAST(greatest(0, 100 - CASE WHEN floor_n <= -2 THEN 55 WHEN floor_n = -1 THEN 40 WHEN floor_n = 0 THEN 20 ELSE 0 END - CASE WHEN NOT elevator AND floor_n >= 5 THEN 25 WHEN NOT elevator AND floor_n >= 4 THEN 15 ELSE 0 END
   - CASE WHEN sqm > 0 AND rooms > 0 AND sqm / rooms < 12 THEN 15 ELSE 0 END - CASE WHEN days_on_market > 60 THEN 25 WHEN days_on_market > 30 THEN 10 ELSE 0 END - CASE WHEN spese_condominiali > rent_mo * 0.25::DOUBLE THEN 15 ELSE 0 END) AS INT) AS score_penalty FROM p2)"""
SCORED = f"""WITH {SQL}{PHYS},
q0 AS (SELECT *, coalesce(omi_mid, 20.0::DOUBLE) AS blended, CAST(id % 101 AS DOUBLE) AS ldi, CAST(id * 3 % 101 AS INT) AS geo_score, CAST(id % 5 * 20 AS INT) AS confidence, CAST(id % 40 AS INT) AS n_comps, id % 2 = 0 AS boost, id % 31 = 0 AS corporate FROM phys),
q1 AS (SELECT *, {R2('(ask_psqm - blended) / blended', 4)} AS d FROM q0),
q2 AS (SELECT *, {R2('d * 100', 1)} AS delta_label, CASE WHEN d <= -0.15 THEN 100 WHEN d <= -0.03 THEN 100 - (d + 0.15::DOUBLE) / (-0.03::DOUBLE + 0.15::DOUBLE) * 50 WHEN d <= 0.03 THEN 50 WHEN d <= 0.2 THEN 50 - (d - 0.03::DOUBLE) / (0.2::DOUBLE - 0.03::DOUBLE) * 50 ELSE 0 END::DOUBLE AS raw0, abs(rent_mo - blended * sqm) AS diff FROM q1),
q3 AS (SELECT *, CASE WHEN raw0 < 50 AND coalesce(sqm, 0) > 0 AND blended > 0 AND rent_mo > 0 THEN 50 - (50 - raw0) * CASE WHEN diff < 50 THEN 0.7 WHEN diff > 100 THEN 1.0 ELSE 0.7::DOUBLE + 0.3::DOUBLE * (diff - 50) / 50 END ELSE raw0 END::DOUBLE AS ps FROM q2),
q4 AS (SELECT *, CAST(round_even(CAST(CASE WHEN d <= 0 AND boost THEN least(100, ps * (1 + greatest(0, (ldi - 50) / 50 * 0.10::DOUBLE))) ELSE ps END AS DECIMAL(18,6)), 0) AS INT) AS score_price FROM q3),
q5 AS (SELECT *, CAST(greatest(0, least(100, round_even(CAST(score_price * 0.45::DOUBLE + score_physical * 0.25::DOUBLE + geo_score * 0.20::DOUBLE + score_penalty * 0.10::DOUBLE AS DECIMAL(18,6)), 0))) AS INT) AS t0 FROM q4),
q6 AS (SELECT *, CASE WHEN score_physical < 40 THEN least(t0, 75) ELSE t0 END AS raw FROM q5),
q7 AS (SELECT *, least(raw, CASE WHEN delta_label <= 0 THEN 100 WHEN delta_label <= 5 THEN 72 WHEN delta_label <= 10 THEN 62 WHEN delta_label <= 20 THEN 50 ELSE 38 END, CASE WHEN floor_n < 0 THEN 55 ELSE 100 END) AS c0,
  CASE WHEN sqm > 0 AND sqm < 60 AND ask_psqm > 0 THEN CASE WHEN ask_psqm >= 7000 THEN 55 WHEN ask_psqm >= 5800 AND sqm <= 58 THEN 65 WHEN ask_psqm >= 5000 AND sqm <= 45 THEN 70 END END AS top FROM q6),
q8 AS (SELECT *, coalesce(top < c0, FALSE) AS gate, CASE WHEN corporate THEN least(c0, coalesce(top, 100), 75) ELSE least(c0, coalesce(top, 100)) END AS capped, delta_label < -40 AS extreme FROM q7),
q9 AS (SELECT *, NOT gate AND NOT corporate AND capped >= 80 AND ldi >= 70 AND delta_label <= -12 AND score_physical >= 62 AND geo_score >= 62 AND confidence >= 60 AND score_penalty >= 75 AS gem,
  NOT gate AND NOT corporate AND capped > 70 AND ldi >= 50 AND delta_label <= -7 AND score_physical >= 50 AND geo_score >= 50 AND confidence >= 45 AND score_penalty >= 60 AS good FROM q8),
scored AS (SELECT *, gem AND NOT extreme AS hidden_gem, good AND NOT gem AND NOT extreme AS good_value, CAST(CASE WHEN extreme THEN least(capped, 55) ELSE capped END AS INT) AS score_total, capped < raw AS score_was_capped FROM q9)"""
WHOLE = "CAST(CAST(round_even(CAST(abs(delta_label) AS DECIMAL(18,6)), 0) AS INT) AS VARCHAR)"

def cascade_sql(ask: str = "ask_psqm", omi: str = "omi_mid", spread: int = 3, thin: str = "") -> str:
    return f"""WITH {SQL}, base AS (SELECT * REPLACE ({ask} AS ask_psqm, {omi} AS omi_mid), {CGROUP} AS cgroup FROM listings),
pairs AS (SELECT a.id, a.cgroup, a.cgroup = b.cgroup AND a.cgroup <> 'unknown' AND a.zone = b.zone AS same, a.zone = b.zone AS z, a.fascia = b.fascia AS f, CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN {HAVERSINE} END AS d, b.ask_psqm AS raw, b.ask_psqm * {FACTOR} AS adj
  FROM base a JOIN base b ON a.id <> b.id WHERE b.ask_psqm > 0 AND a.ask_psqm > 0 AND (coalesce(a.sqm, 0) <= 0 OR {BAND})),
c AS (SELECT id, list(raw) FILTER (same) AS s1, list(adj) FILTER (z) AS s2, list(adj) FILTER (f AND d <= 800) AS s3, list(adj) FILTER (f) AS s4, list(adj) FILTER (d <= 500) AS r1, list(adj) FILTER (d <= 800) AS r2, list(adj) FILTER (d <= 1200) AS r3 FROM pairs GROUP BY id),
w AS (SELECT *, CASE WHEN len(s1) >= 15 THEN 'zone_stratified' WHEN len(s2) >= 15 THEN 'zone_any_condition' WHEN len(s3) >= 5 THEN 'radius_800m_same_fascia' WHEN len(s4) >= 5 THEN 'fascia_fallback' WHEN len(r1) >= 5 THEN 'comps_500' WHEN len(r2) >= 5 THEN 'comps_800' WHEN len(r3) >= 5 THEN 'comps_1200' WHEN len(s2) >= 5 THEN 'omi_zone' END AS source FROM c),
pool AS (SELECT id, source, CASE source WHEN 'zone_stratified' THEN s1 WHEN 'zone_any_condition' THEN s2 WHEN 'radius_800m_same_fascia' THEN s3 WHEN 'fascia_fallback' THEN s4 WHEN 'comps_500' THEN r1 WHEN 'comps_800' THEN r2 WHEN 'comps_1200' THEN r3 ELSE s2 END AS prices FROM w WHERE source IS NOT NULL),
{robust_sql('pool', 'id, source')},
j AS (SELECT base.id, base.cgroup, base.omi_mid AS omi, base.ask_psqm AS ask, source, n_raw, n_comps, median, p40, p60, least(100, CASE WHEN n_comps >= 40 THEN 40 WHEN n_comps >= 20 THEN 20 ELSE 0 END + CASE WHEN source = 'zone_stratified' THEN 40 WHEN source LIKE '%zone%' THEN 10 ELSE 0 END + CASE WHEN stdev < {spread} THEN 20 ELSE 0 END) AS conf,
  source IS NULL AND coalesce(omi_mid, 0) > 0 AND ask_psqm > 0 AS only_omi FROM base LEFT JOIN stats ON base.id = stats.id),
k AS (SELECT *, CASE WHEN source IS NULL THEN CASE WHEN only_omi THEN omi END WHEN coalesce(omi, 0) <= 0 THEN median {thin} ELSE median * CASE WHEN conf >= 70 THEN 1.0 WHEN conf >= 40 THEN 0.8 ELSE 0.5 END::DOUBLE + omi * (1 - CASE WHEN conf >= 70 THEN 1.0 WHEN conf >= 40 THEN 0.8 ELSE 0.5 END::DOUBLE) END AS blended FROM j)
SELECT id, cgroup AS condition_group, coalesce(source, CASE WHEN only_omi THEN 'omi_only' ELSE 'none' END) AS benchmark_source, {R2('CASE WHEN only_omi THEN omi ELSE median END')} AS median, {R2('CASE WHEN only_omi THEN omi ELSE p40 END')} AS p40, {R2('CASE WHEN only_omi THEN omi ELSE p60 END')} AS p60, {R2('blended')} AS blended_median, {R2('(ask - blended) / nullif(blended, 0)', 4)} AS delta_pct,
  CAST(CASE WHEN source IS NOT NULL THEN conf WHEN only_omi THEN 15 ELSE 0 END AS INT) AS confidence, CAST(coalesce(n_comps, 0) AS INT) AS n_comps, CAST(coalesce(n_raw, 0) AS INT) AS n_raw FROM k"""


ORACLE_SQL = {
    "comps_zone_median": f"""WITH {SQL}, pool AS (SELECT a.id, a.zone, a.ask_psqm AS psqm, list(b.ask_psqm) AS prices FROM listings a JOIN listings b ON a.zone = b.zone AND a.id <> b.id WHERE b.ask_psqm > 0 AND a.sqm > 0 AND {BAND} GROUP BY ALL),
{robust_sql('pool', 'id, zone, psqm')} SELECT id, zone, CAST(n_raw AS INT) AS n_raw, CAST(n_comps AS INT) AS n_comps, {R2('median')} AS median, {R2('(psqm - median) / median', 4)} AS delta_pct FROM stats WHERE n_raw >= 5 ORDER BY delta_pct, id LIMIT 10""",
    "comps_cascade": cascade_sql(),
    "comps_cascade_sale": cascade_sql(R2("price / sqm", 0), "omi_mid * 160", 1500, "WHEN n_comps < 15 THEN median * 0.4::DOUBLE + omi * 0.6::DOUBLE"),
    "robust_trim_stats": f"WITH pool AS (SELECT p_brand, p_size, list(p_retailprice) AS prices FROM part GROUP BY ALL), {robust_sql('pool', 'p_brand, p_size')} SELECT p_brand, p_size, CAST(n_raw AS INT) AS n_raw, CAST(n_comps AS INT) AS n_comps, {R2('median')} AS median, {R2('p40')} AS p40, {R2('p60')} AS p60, {R2('stdev')} AS stdev FROM stats",
    "comp_top_k": f"""WITH {SQL}, r AS (SELECT a.id, b.id AS c_id, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN {HAVERSINE} END, b.ask_psqm), b.id) AS n FROM listings a JOIN listings b ON a.zone = b.zone AND a.id <> b.id WHERE b.ask_psqm > 0 AND a.sqm > 0 AND {BAND})
SELECT id, string_agg(CAST(c_id AS VARCHAR), ',' ORDER BY n) AS comp_ids FROM r WHERE n <= 30 GROUP BY id""",
    "physical_scores": f"WITH {SQL}{PHYS} SELECT id, {R2('fl', 4)} AS floor_coefficient, cg AS condition_group, room_flag, score_physical, score_penalty FROM phys",
    "composite_score": f"""{SCORED} SELECT id, delta_label, score_price, score_total, score_was_capped, gate, extreme AS extreme_underpricing, hidden_gem, good_value,
  CASE WHEN abs(delta_label) < 0.5 THEN 'at comps median' WHEN delta_label > 0 THEN '+' || printf('%.1f', delta_label) || '% above comps' ELSE printf('%.1f', delta_label) || '% below comps' END AS comps_label, CASE WHEN confidence >= 70 THEN 'High' WHEN confidence >= 40 THEN 'Medium' ELSE 'Low' END AS confidence_label FROM scored""",
    "gem_gate": f"{SCORED} SELECT id, coalesce(score_total >= 50 AND ldi >= 30 AND delta_label <= 30 AND score_physical >= 40 AND geo_score >= 40 AND confidence >= 20 AND score_penalty >= 50 AND id * 17 % 1500 <= 800 AND sqm / rooms >= 22, FALSE) AS strict_gem FROM scored",
    "good_value_gate": f"""{SCORED}, g AS (SELECT *, coalesce(score_total >= 50 AND ldi >= 30 AND delta_label <= 30 AND score_physical >= 40 AND geo_score >= 40 AND confidence >= 20 AND score_penalty >= 50 AND id * 17 % 1500 <= 800 AND sqm / rooms >= 22, FALSE) AS strict FROM scored)
SELECT id, NOT strict AND coalesce(score_total >= 45 AND ldi >= 20 AND delta_label <= 40 AND score_physical >= 30 AND geo_score >= 20 AND confidence >= 20 AND score_penalty >= 50, FALSE) AS good_value FROM g""",
    "explanations": f"""{SCORED} SELECT id, array_to_string(list_filter([CASE WHEN gate THEN 'Capped: poor absolute value.' END, CASE WHEN corporate THEN 'A corporate or short-term let.' END,
  CASE WHEN score_total >= 85 THEN 'A rare find.' WHEN score_total >= 72 THEN 'Solid for the area.' WHEN score_total >= 60 THEN 'Reasonable, with caveats.' WHEN score_total >= 45 THEN 'Overpriced for what it is.' ELSE 'Not worth the time.' END,
  CASE WHEN delta_label <= -10 THEN {WHOLE} || '% below ' || n_comps || ' comparable flats.' WHEN delta_label <= -3 THEN 'Slightly below comparable flats: ' || {WHOLE} || '%.' WHEN delta_label <= 5 THEN 'In line with comparable flats.' WHEN delta_label <= 15 THEN {WHOLE} || '% above comparable flats.' ELSE 'Far above comparable flats: ' || {WHOLE} || '%.' END,
  CASE WHEN floor_n < 0 THEN 'Below ground.' WHEN floor_n = 0 THEN 'Ground floor: light and noise.' WHEN floor_n > 2 AND NOT elevator THEN 'Floor ' || floor_n || ' without a lift.' END,
  CASE WHEN days_on_market > 90 THEN 'Listed for ' || days_on_market || ' days.' WHEN days_on_market > 45 THEN 'On the market for ' || days_on_market || ' days.' END], lambda x: x IS NOT NULL)[1:4], ' | ') AS bullets FROM scored""",
    "score_reasons": f"""{SCORED}, reasons AS (SELECT id, unnest([
  CASE WHEN delta_label < -5 THEN {{'w': abs(delta_label), 'n': 0, 't': 'price: below comparables'}} END, CASE WHEN delta_label > 5 THEN {{'w': abs(delta_label), 'n': 1, 't': 'price: above comparables'}} END,
  CASE WHEN floor_n < 0 THEN {{'w': 40.0::DOUBLE, 'n': 2, 't': 'property: below ground'}} END, CASE WHEN score_physical >= 70 THEN {{'w': score_physical / 4, 'n': 3, 't': 'property: in good shape'}} END,
  CASE WHEN geo_score >= 70 THEN {{'w': geo_score / 4, 'n': 4, 't': 'location: well served'}} END, CASE WHEN days_on_market > 60 THEN {{'w': 12.0::DOUBLE, 'n': 5, 't': 'market: slow to sell'}} END,
  CASE WHEN score_penalty < 70 THEN {{'w': CAST(100 - score_penalty AS DOUBLE), 'n': 6, 't': 'penalty: has drawbacks'}} END]) AS r FROM scored),
ranked AS (SELECT id, r.t AS t, row_number() OVER (PARTITION BY id ORDER BY r.w DESC, r.n) AS k FROM reasons WHERE r IS NOT NULL)
SELECT s.id, coalesce(string_agg(t, ' | ' ORDER BY k) FILTER (k <= 3), '') AS reasons FROM scored s LEFT JOIN ranked USING (id) GROUP BY s.id""",
    "effective_rent": f"""WITH {SQL}, x AS (SELECT id, CAST(rent_mo AS DOUBLE) AS rent, CAST(coalesce(spese_condominiali, 0) AS DOUBLE) AS fee, coalesce(sqm, 0) AS m, ask_psqm FROM listings),
y AS (SELECT *, CASE WHEN fee > rent * 0.30::DOUBLE THEN rent * 0.15::DOUBLE ELSE fee END AS kept FROM x)
SELECT id, {R2('rent + kept')} AS effective_rent_mo, {R2('(rent + kept) / nullif(m, 0)')} AS effective_psqm_rent, {R2('kept / rent * 100', 1)} AS condo_pct_of_rent, CASE WHEN m = 0 THEN ask_psqm ELSE {R2('(rent + least(fee, rent * 0.20::DOUBLE)) / nullif(m, 0)')} END AS ask_psqm_effective,
  CASE WHEN fee >= rent * 0.20::DOUBLE THEN 'high_condo_fees' WHEN fee >= rent * 0.12::DOUBLE THEN 'elevated_condo_fees' END AS condo_fee_flag FROM y""",
    "suggested_rent": f"""WITH {SQL}, x AS (SELECT id, price, CASE WHEN coalesce(omi_mid, 0) > 0 AND coalesce(sqm, 0) > 0 THEN CAST(round_even(CAST(omi_mid * CASE WHEN sqm < 50 THEN 1.20 WHEN sqm <= 85 THEN 1.0 WHEN sqm <= 115 THEN 0.9 WHEN sqm <= 145 THEN 0.82 ELSE 0.75 END::DOUBLE * CASE WHEN lower(condition) IN ('ottimo', 'nuova costruzione') THEN 1.0 WHEN condition = 'da ristrutturare' THEN 0.70 ELSE 0.85 END::DOUBLE * sqm / 25 AS DECIMAL(18,6)), 0) AS INT) * 25 END AS r FROM listings)
SELECT id, r AS suggested_rent_mo, CASE WHEN r IS NOT NULL AND price > 0 THEN {R2('CAST(r * 12 AS DOUBLE) / price * 100')} END AS estimated_yield_pct FROM x""",
    "excluded_listings": f"""WITH {SQL}, x AS (SELECT id, CASE WHEN id % 37 = 0 THEN 'fake' WHEN id % 41 = 0 THEN 'nuda_proprieta' WHEN id % 43 = 0 THEN 'auction' WHEN sqm IS NOT NULL AND ask_psqm * 30 <> 0 AND price <> 0 AND ask_psqm * 30 < CASE city WHEN 'Milano' THEN 800 WHEN 'Roma' THEN 600 ELSE 400 END THEN 'price_floor' END AS excluded_reason FROM listings) SELECT * FROM x WHERE excluded_reason IS NOT NULL""",
    "fascia_percentile": f"""WITH {SQL}, l AS (SELECT * REPLACE (CASE WHEN contains(fascia, 'BRUSHED') THEN NULL ELSE ask_psqm END AS ask_psqm) FROM listings),
p AS (SELECT id, cume_dist() OVER (PARTITION BY fascia ORDER BY ask_psqm) * 100 AS pct FROM l WHERE ask_psqm > 0),
x AS (SELECT l.id, coalesce(pct, 50) AS pct, (ask_psqm - omi_mid) / omi_mid AS vs FROM l LEFT JOIN p ON l.id = p.id WHERE ask_psqm > 0 OR ask_psqm IS NULL)
SELECT id, {R2('pct')} AS fascia_pct, {R2('CASE WHEN vs IS NULL THEN 50 ELSE greatest(0, least(100, 50 - 250 * vs)) END * 0.60::DOUBLE + (100 - pct) * 0.40::DOUBLE', 1)} AS simple_score FROM x""",
    "ldi_by_zone": f"""WITH {SQL}, z AS (SELECT fascia, zone, CAST(CAST(sum(CAST(ask_psqm AS DECIMAL(18,6))) / count(*) AS DECIMAL(18,6)) AS DOUBLE) AS mid FROM listings GROUP BY ALL),
m AS (SELECT fascia, min(mid) AS lo, max(mid) AS hi, list_sort(list(mid)) AS s FROM z GROUP BY fascia)
SELECT fascia, zone, {R2('CASE WHEN hi = lo THEN 50 ELSE (mid - lo) / (hi - lo) * 100 END')} AS ldi, {R2('s[least(CAST(floor(len(s) * 0.8::DOUBLE) AS INT), len(s) - 1) + 1]', 4)} AS threshold FROM z JOIN m USING (fascia)""",
}
_HAVE = {"critical": ["id IS NOT NULL", "coalesce(rent_mo, 0) <> 0", "coalesce(sqm, 0) <> 0", "lat IS NOT NULL", "lng IS NOT NULL", "omi_mid IS NOT NULL"], **{g: [f"{f} IS NOT NULL" for f in QUALITY[g]] for g in ("important", "useful")}}
_CNT = {g: "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in xs) + ")" for g, xs in _HAVE.items()}
_MISS = {g: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({x}) THEN '{f}' END" for x, f in zip(_HAVE[g], QUALITY[g], strict=True)) + "], lambda x: x IS NOT NULL), ',')" for g in _HAVE}
_TOTAL = 3 * 6 + 2 * 5 + 6
AUDIT = f"""WITH {SQL}, a AS (SELECT id, {R2(f"CAST({_CNT['critical']} * 3 + {_CNT['important']} * 2 + {_CNT['useful']} AS DOUBLE) / {_TOTAL} * 100", 1)} AS completeness_pct, {R2(f"CAST({_CNT['critical']} AS DOUBLE) / 6 * 100", 1)} AS critical_score, {R2(f"CAST({_CNT['important']} AS DOUBLE) / 5 * 100", 1)} AS important_score,
  {_MISS['critical']} AS critical_missing, {_MISS['important']} AS important_missing, {_MISS['useful']} AS useful_missing FROM listings),
audit AS (SELECT id, completeness_pct, critical_score, important_score, CASE WHEN completeness_pct >= 90 THEN 'A' WHEN completeness_pct >= 75 THEN 'B' WHEN completeness_pct >= 60 THEN 'C' WHEN completeness_pct >= 40 THEN 'D' ELSE 'F' END AS grade, critical_missing, important_missing, useful_missing, critical_missing <> '' OR id % 7 = 0 AS needs_reenrichment FROM a)"""
ORACLE_SQL |= {
    "quality_audit": f"{AUDIT} SELECT * FROM audit",
    "quality_grades": f"{AUDIT} SELECT grade, count(*) AS n, count(*) FILTER (needs_reenrichment) AS n_reenrich FROM audit GROUP BY grade",
    "field_coverage": f"WITH {SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (NOT ({x})) AS n_missing, {R2(f'CAST(count(*) FILTER ({x}) AS DOUBLE) / count(*) * 100', 1)} AS coverage_pct FROM listings" for g in QUALITY for f, x in zip(QUALITY[g], _HAVE[g], strict=True)),
    "digest_topk": f"""WITH {SQL}, rules(rule_id, city, max_rent, min_sqm, min_score, active) AS (VALUES (1, 'Milano', 1500, NULL, NULL, TRUE), (2, 'Roma', NULL, 40, 40, TRUE), (3, 'Napoli', 1200, 30, 20, FALSE), (4, 'Torino', 2000, 25, 30, TRUE), (5, 'Milano', NULL, NULL, 50, TRUE)),
h AS (SELECT rule_id, id, CAST(id * 7 % 101 AS INT) AS score_total FROM listings l JOIN rules r ON l.city = r.city WHERE active AND (id % 3 = 0 OR id % 5 = 0) AND (max_rent IS NULL OR rent_mo <= max_rent) AND (min_sqm IS NULL OR sqm >= min_sqm) AND (min_score IS NULL OR id * 7 % 101 >= min_score)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY score_total DESC, id) AS INT) AS rank FROM h) SELECT rule_id, id, score_total, rank FROM r WHERE rank <= 50""",
    "digest_hour": "SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 AND (c_custkey % 10 = 0 OR c_custkey % 11 = 0 OR c_custkey % 24 = 7)",
    "filtered_counts": f"WITH {SQL} SELECT city, count(*) AS n, count(*) FILTER (elevator) AS n_lift, count(*) FILTER (floor_n < 0) AS n_below, max(floor_n) AS top_floor FROM listings GROUP BY city",
    "condition_lists": f"WITH {SQL} SELECT zone, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ask_psqm, id) AS ids FROM listings WHERE condition = 'da ristrutturare' GROUP BY zone",
    "top_scores": f"{SCORED} SELECT id, score_total FROM scored ORDER BY coalesce(score_total, 0) DESC, id LIMIT 24",
}
