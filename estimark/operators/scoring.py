"""Composite scores with their ceilings, gates, badges and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark import settings as st
from estimark.functions import scalars as sc


def excluded_reason(kind: dict[str, Column], city: Column) -> Column:
    """Why a sale listing isn't scored: bait, bare ownership, auction, or a price per square
    metre under the city's floor."""
    floor = sc.lookup(F.lower(F.coalesce(city, F.lit("milano"))), st.MIN_SALE_PSQM, st.DEFAULT_MIN_SALE_PSQM)
    known = (sc.zero("ask_psqm") != 0) & (sc.zero("sqm") != 0) & (sc.zero("price") != 0)
    return F.when(kind["fake"], "fake").when(kind["nuda"], "nuda_proprieta").when(kind["auction"], "auction").when(known & (F.col("ask_psqm") < floor), "price_floor")


def composite(listings: DataFrame, s: st.Settings) -> DataFrame:
    """Adds score_physical, score_penalty, score_price, score_total, the ceilings' flags, badges
    and labels. listings has the physical columns, geo_score, ldi, delta_pct, blended_median,
    confidence, ask_psqm, omi_mid, boost (may the zone's price be boosted) and corporate."""
    c = F.col
    df = listings.withColumns({"score_physical": sc.property_score(s.year), "score_penalty": sc.penalty_score(s), "score_location": F.coalesce("geo_score", F.lit(50))})
    # caps are terms of least() (which skips nulls), so no stage repeats the one before it
    known = c("delta_pct").isNotNull() & (F.coalesce("blended_median", F.lit(0.0)) > 0)
    price = F.when(known, sc.price_score(c("delta_pct"), c("rent_mo"), c("blended_median"), c("sqm"), s)).otherwise(50.0)
    bonus = F.greatest(F.lit(0.0), (F.coalesce("ldi", F.lit(50.0)) - 50) / 50 * 0.10)
    boost = F.when((c("delta_pct") <= 0) & c("boost"), 1 + bonus).otherwise(1.0)
    df = df.withColumns({"delta_label": sc.exactly(c("delta_pct") * 100, 1), "score_price": sc.half_even(F.least(F.lit(100.0), price * boost))})
    total = sc.half_even(c("score_price") * s.w_price + c("score_physical") * s.w_property + c("score_location") * s.w_location + c("score_penalty") * s.w_penalty)
    df = df.withColumn("raw", F.least(F.greatest(F.lit(0), total), F.lit(100), F.when(c("score_physical") < 40, 75)))
    df = df.withColumn("capped", F.least("raw", sc.price_ceiling(c("delta_label")), F.when(c("floor_n") < 0, 55)))
    gate = sc.value_gate(c("ask_psqm"), c("sqm"))
    df = df.withColumn("gate", F.coalesce(gate < c("capped"), F.lit(False))).withColumn("capped", F.least("capped", gate, F.when(c("corporate"), 75)))
    extreme = F.coalesce(c("delta_label") < -40, F.lit(False))

    def badge(m: tuple, above: Column) -> Column:
        _, ldi, delta, prop, loc, conf, pen = m
        return F.coalesce(
            ~c("gate") & ~c("corporate") & above & (F.coalesce("ldi", F.lit(50.0)) >= ldi) & (c("delta_label") <= delta) & (c("score_physical") >= prop) & (c("score_location") >= loc) & (c("confidence") >= conf) & (c("score_penalty") >= pen),
            F.lit(False),
        )

    gem = badge(s.gem, c("capped") >= s.gem[0])
    good = ~gem & badge(s.good_value, c("capped") > s.good_value[0])
    return df.withColumns({
        "hidden_gem": gem & ~extreme, "good_value": good & ~extreme, "extreme_underpricing": extreme,
        "score_total": F.least("capped", F.when(extreme, 55)), "score_was_capped": c("capped") < c("raw"),
        "comps_label": sc.label(c("delta_label"), "at comps median", "comps"), "confidence_label": F.when(c("confidence") >= 70, "High").when(c("confidence") >= 40, "Medium").otherwise("Low"),
    }).drop("raw", "capped")


def gem_gate(s: st.Settings) -> Column:
    """The strict hidden-gem test on scored rows, with its metro and room-size gates."""
    total, ldi, delta, prop, loc, conf, pen = s.gem
    c = F.col
    test = (c("score_total") >= total) & (c("ldi") >= ldi) & (c("delta_label") <= delta) & (c("score_physical") >= prop) & (c("score_location") >= loc) & (c("confidence") >= conf) & (c("score_penalty") >= pen)
    return F.coalesce(test & (c("metro_m") <= s.gem_metro_max_m) & (c("sqm") / F.nullif(c("rooms"), F.lit(0)) >= s.gem_min_sqm_per_room), F.lit(False))


def good_value_gate(s: st.Settings) -> Column:
    """The stand-alone good-value test of rentals: no gem, and at or above each of its thresholds
    (at its total, too)."""
    return ~gem_gate(s) & sale_gate(s.good_value, sc.zero("score_total") >= s.good_value[0])


def sale_penalty(s: st.Settings) -> Column:
    """The penalty score, less 20 for asking more than 1.3 times the zone's highest price."""
    above = (sc.zero("ask_psqm") > 0) & (sc.zero("compr_max") > 0) & (F.col("ask_psqm") > F.col("compr_max") * 1.3)
    return F.greatest(F.lit(0), sc.penalty_score(s) - F.when(above, 20).otherwise(0))


def sale_gate(m: tuple, total: Column) -> Column:
    """Whether a scored sale passes the thresholds m (total, ldi, delta, property, location,
    confidence, penalty), ``total`` being the comparison with the first of them."""
    c = F.col
    _, ldi, delta, prop, loc, conf, pen = m
    tests = total & (sc.zero("ldi") >= ldi) & (c("delta_label") <= delta) & (sc.zero("score_physical") >= prop) & (sc.zero("score_location") >= loc) & (sc.zero("confidence") >= conf) & (sc.zero("score_penalty") >= pen)
    return F.coalesce(tests, F.lit(False))


def sale_gates(s: st.Settings) -> list[Column]:
    """The stand-alone tests for sales: a gem, and a good value that is none (at its total, too)."""
    gem = sale_gate(s.gem, sc.zero("score_total") >= s.gem[0])
    return [gem.alias("is_sale_gem"), (~gem & sale_gate(s.good_value, sc.zero("score_total") >= s.good_value[0])).alias("is_sale_good_value")]


def zone_price_label(ask: Column, mid: Column) -> list[Column]:
    """How far the price lies from the zone's middle price, in percent and in words."""
    known = (F.coalesce(mid, F.lit(0)) > 0) & (F.coalesce(ask, F.lit(0)) > 0)
    pct = F.when(known, sc.exactly((ask - mid) / mid * 100, 1))
    return [pct.alias("vs_omi_pct"), sc.label(pct, "at OMI", "OMI").alias("vs_omi_label")]


def composite_sale(listings: DataFrame, s: st.Settings) -> DataFrame:
    """As ``composite``, for sales: prices of purchase (ask_psqm, price, compr_mid, compr_max), no
    corporate ceiling, the purchase sum in the place of the rent, and excluded listings scored 0.
    listings has excluded_reason (null: scored), loc_mid (rent of the zone) and the columns of
    ``composite`` but corporate and omi_mid."""
    c = F.col
    df = listings.withColumns({"score_physical": sc.property_score(s.year), "score_penalty": sale_penalty(s), "score_location": F.coalesce("geo_score", F.lit(50))})
    known = c("delta_pct").isNotNull() & (F.coalesce("blended_median", F.lit(0.0)) > 0)
    price = F.when(known, sc.price_score(c("delta_pct"), c("price"), c("blended_median"), c("sqm"), s)).otherwise(50.0)
    bonus = F.greatest(F.lit(0.0), (F.coalesce("ldi", F.lit(50.0)) - 50) / 50 * 0.10)
    boost = F.when((c("delta_pct") <= 0) & c("boost"), 1 + bonus).otherwise(1.0)
    df = df.withColumns({"delta_label": sc.exactly(c("delta_pct") * 100, 1), "score_price": sc.half_even(price), "boosted": sc.half_even(F.least(F.lit(100.0), price * boost))})
    total = sc.half_even(c("boosted") * s.w_price + c("score_physical") * s.w_property + c("score_location") * s.w_location + c("score_penalty") * s.w_penalty)
    df = df.withColumn("raw", F.least(F.greatest(F.lit(0), total), F.lit(100), F.when(c("score_physical") < 40, 75)))
    df = df.withColumn("capped", F.least("raw", sc.price_ceiling(c("delta_label")), F.when(c("floor_n") < 0, 55)))
    gate = sc.value_gate(c("ask_psqm"), c("sqm"))
    df = df.withColumn("gate", F.coalesce(gate < c("capped"), F.lit(False))).withColumn("capped", F.least("capped", gate))
    gem = ~c("gate") & sale_gate(s.gem, c("capped") >= s.gem[0])
    good = ~gem & ~c("gate") & sale_gate(s.good_value, c("capped") > s.good_value[0])
    extreme = F.coalesce(c("delta_label") < -40, F.lit(False))
    rent = c("loc_mid") * c("sqm") * surface_share(c("sqm")) * condition_share(c("condition"))
    scored = c("excluded_reason").isNull()
    yields = F.when((sc.zero("loc_mid") > 0) & (sc.zero("sqm") > 0) & (sc.zero("price") > 0), sc.exactly(rent * 12 / c("price") * 100, 2))
    return df.withColumns({
        "hidden_gem": scored & gem & ~extreme, "good_value": scored & good & ~extreme, "extreme_underpricing": scored & extreme, "score_was_capped": scored & (c("capped") < c("raw")), "gate": scored & c("gate"),
        "score_total": F.when(scored, F.least("capped", F.when(extreme, 55))).otherwise(0), **{k: F.when(scored, c(k)).otherwise(0) for k in ("score_price", "score_physical", "score_location", "score_penalty")},
        "comps_label": F.when(scored, sc.label(c("delta_label"), "at comps median", "nearby sales")), "confidence_label": F.when(scored, F.when(c("confidence") >= 70, "High").when(c("confidence") >= 40, "Medium").otherwise("Low")),
        "estimated_yield_pct": F.when(scored, yields),
    }).withColumns(dict(zip(["vs_omi_pct", "vs_omi_label"], [F.when(scored, x) for x in zone_price_label(c("ask_psqm"), c("compr_mid"))], strict=True))).drop("raw", "capped", "boosted")


def surface_share(sqm: Column) -> Column:
    """Share of the zone's rent a square metre that a flat of this size asks."""
    return F.when(sqm < 50, 1.20).when(sqm <= 85, 1.0).when(sqm <= 115, 0.90).when(sqm <= 145, 0.82).otherwise(0.75)


def condition_share(condition: Column) -> Column:
    cond = F.lower(F.coalesce(condition, F.lit("")))
    return F.when(sc.any_of(cond, ["ristrutturato", "ottimo", "nuovo", "eccellente"]), 1.0).when(sc.any_of(cond, ["da ristrutturare", "fatiscente"]), 0.70).otherwise(0.85)


def reasons_table() -> Column:
    """All reasons of a scored listing, as (weight, rank, component, sentiment, key, text), null where
    one doesn't hold; the listing has the columns of ``composite`` or ``composite_sale`` and of the
    places near it. No lambda stands around the list: below one, Spark interprets everything for
    each row. Words are ours; which reasons hold, their weights and their order are fixed values."""
    c = F.col
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows: list[Column] = []
    bad: dict[str, Column] = {}  # whether a component has a reason against it

    def add(holds: Column, component: str, mood: str, weight: int, key: str, text: Column | str) -> None:
        text = F.lit(text) if isinstance(text, str) else text
        if mood == "negative":
            bad[component] = bad.get(component, F.lit(False)) | F.coalesce(holds, F.lit(False))
        rows.append(F.when(holds, F.struct(F.lit(weight).alias("weight"), F.lit(-len(rows)).alias("rank"), F.lit(component).alias("component"), F.lit(mood).alias("sentiment"), F.lit(key).alias("key"), text.alias("text"))))

    def ladder(component: str, steps: list[tuple[Column, str, int, str, Column | str]]) -> None:
        """The first step that holds."""
        before = F.lit(False)
        for holds, mood, weight, key, text in steps:
            holds = F.coalesce(holds, F.lit(False))
            add(~before & holds, component, mood, weight, key, text)
            before = before | holds

    d, pct, up = c("delta_label"), sc.half_even(F.abs("delta_label")), sc.half_even(c("delta_label"))
    enough = c("n_comps") >= 10
    below, above = t(pct, " % below similar flats"), t(up, " % above similar flats")
    ladder("Price", [
        (enough & (d <= -15), "positive", 9, "far_below", below), (enough & (d <= -8), "positive", 6, "far_below", below), (enough & (d <= -3), "neutral", 2, "below", t(pct, " % below comparable ones")), (enough & (d < 5), "neutral", 1, "at_market", "priced like similar flats"),
        (enough & (d < 8), "neutral", 2, "above", t(up, " % above comparable ones")), (enough & (d < 15), "negative", 6, "far_above", above), (enough & (d >= 15), "negative", 9, "far_above", above),
    ])
    add(c("gate"), "Price", "negative", 11, "gate", t("poor value at ", sc.half_even(c("ask_psqm").cast("double")), " a square metre, score held at ", c("score_total")))
    add(c("corporate"), "Price", "negative", 8, "corporate", "corporate ceiling of 75")
    add(c("condo_fee_flag") == "high_condo_fees", "Price", "negative", 7, "high_condo", t("fees of ", sc.zero("spese_condominiali"), " a month"))
    add(c("corporate"), "Price", "negative", 8, "corporate_let", "let by a company, furnished and short")
    walk = F.coalesce(c("metro_walk_min"), F.when(sc.zero("metro_m") > 0, F.greatest(F.lit(1), sc.half_even(c("metro_m") / 70))))
    station = t(walk, " min to ", F.coalesce(F.nullif("metro_name", F.lit("")), F.lit("the metro")))
    ladder("Location", [(walk <= 3, "positive", 7, "very_close", station), (walk <= 7, "positive", 4, "close", station), (walk >= 18, "negative", 6, "far", station), (walk >= 13, "negative", 4, "limited", station)])
    ldi, total = sc.zero("ldi"), sc.zero("score_total")
    ladder("Location", [((ldi >= 80) & (d <= -8), "positive", 9, "bargain", "cheap in a sought-after zone"), ((ldi <= 20) & (total >= 70), "negative", 4, "weak_zone", "a zone in low demand")])

    state, floor, year = F.lower(F.coalesce("condition", F.lit(""))), c("floor_n"), c("year_built")
    to_do = state.contains("da ") & state.contains("ristruttur")
    renovated = sc.any_of(state, ["ottim", "ristruttur", "nuovo"]) & ~to_do
    held = lambda x: F.coalesce(x, F.lit(False))
    strong = F.array_compact(F.array(F.when(renovated, "renovated"), F.when(held((floor >= 3) & c("elevator")), t("floor ", floor, " with lift")), F.when(held(c("bathrooms") >= 2), t(c("bathrooms"), " bathrooms")), F.when(held(c("has_balcony")), "balcony"), F.when(held(year >= 2010), "built since 2010")))
    add(F.size(strong) >= 2, "Property", "positive", 5, "strengths", F.array_join(F.slice(strong, 1, 3), ", "))
    raised = F.lower(F.coalesce("floor_label", F.lit(""))).contains("rialzato")
    stairs = (floor > 2) & ~c("elevator")
    ladder("Property", [(floor < 0, "negative", 9, "subterranean", "below ground"), (floor == 0, "negative", 6, "ground", "ground floor"), (raised, "negative", 5, "rialzato", "raised ground floor"), (stairs, "negative", 8, "no_lift", t("floor ", floor, " without a lift"))])
    ladder("Property", [(to_do, "negative", 6, "renovation", "needs renovation"), (state.contains("fatiscent"), "negative", 7, "renovation", "in poor condition")])
    size, flag = c("sqm"), c("room_flag")
    across, sized = t(size, " m2 in ", c("rooms"), " rooms"), t(size, " m2")
    several = (sc.zero("sqm") > 0) & (sc.zero("rooms") > 0)
    ladder("Property", [
        ((flag == "severe") & several, "negative", 8, "studio_partition", across), ((flag == "tight") & several, "negative", 5, "cramped_layout", across),
        ((flag == "micro_studio") & (sc.zero("sqm") > 0), "negative", 8, "small_studio", sized), ((flag == "small_studio") & (sc.zero("sqm") > 0), "negative", 6, "small_studio", sized), ((flag == "compact_studio") & (sc.zero("sqm") > 0), "negative", 3, "small_studio", sized),
    ])
    old = (sc.zero("year_built") > 0) & (year < 1960) & ~renovated
    add(old, "Property", "negative", 4, "old_unrenovated", t("built in ", year, ", not renovated"))
    dom = c("days_on_market")
    ladder("Penalty", [(dom > 90, "negative", 5, "stale", t(dom, " days on the market")), ((dom >= 0) & (dom <= 7), "positive", 2, "fresh", "new on the market")])
    gain = c("estimated_yield_pct")
    ladder("Price", [(gain >= 5.0, "positive", 6, "strong_yield", t("yields ", sc.exactly(gain, 1), " % a year")), (gain < 3.0, "negative", 5, "weak_yield_pct", t("yields ", sc.exactly(gain, 1), " % a year"))])

    # what stands for a poor component without a reason of its own
    flat, place = bad["Property"], bad["Location"]
    low = F.when(c("elevator").isNull(), " without a known lift").otherwise(" without a lift")
    weak = F.array_compact(F.array(F.when(held(floor <= 2) & ~held(c("elevator")), F.concat(F.lit("floor "), floor.cast("string"), low)), F.when(state.isin("buono", "abitabile") & (F.size(strong) == 0), "plain condition"),
                                   F.when(held((year >= 1960) & (year < 1990)) & ~renovated, t("built in the ", year, "s, not renovated")), F.when(held(~c("has_balcony")), "no balcony")))
    poor = held(c("score_physical") <= 55) & ~flat
    add(poor & (F.size(weak) > 0), "Property", "negative", 4, "below_avg", F.array_join(F.slice(weak, 1, 2), ", "))
    add(poor & (F.size(weak) == 0), "Property", "negative", 3, "limited", "little that stands out")
    away = F.array_compact(F.array(F.when(held(walk >= 10), t(walk, " min to the metro")), F.when(held(c("park_m") > 600), "no park within 600 m"), F.when(held(c("supermarket_m") > 500), t("supermarket in ", c("supermarket_m").cast("int"), " m"))))
    remote = held(F.coalesce("score_location", "geo_score") <= 55) & ~place
    add(remote & (F.size(away) > 0), "Location", "negative", 4, "below_avg", F.array_join(F.slice(away, 1, 2), ", "))
    add(remote & (F.size(away) == 0) & F.coalesce(walk > 5, F.lit(True)), "Location", "negative", 3, "quiet", "a quiet part of the city")
    return F.array(*rows)


def weightiest(reasons: Column, k: int = 3) -> list[Column]:
    """The k weightiest reasons, ties in their order; null where fewer hold."""
    best = F.sort_array(reasons, asc=False)
    return [F.get(best, F.lit(n)) for n in range(k)]


def suggested_rent() -> list[Column]:
    """Monthly rent by the zone's price, size and condition, to 25 euros, and its yield."""
    sqm, cond = F.col("sqm"), F.lower(F.coalesce("condition", F.lit("")))
    size = F.when(sqm < 50, 1.20).when(sqm <= 85, 1.0).when(sqm <= 115, 0.90).when(sqm <= 145, 0.82).otherwise(0.75)
    state = F.when(sc.any_of(cond, ["ottim", "ristrutturato", "nuov"]), 1.0).when(cond.contains("da ristrutturare"), 0.70).otherwise(0.85)
    known = (sc.zero("omi_mid") > 0) & (sc.zero("sqm") > 0)
    rent = F.when(known, sc.half_even(F.col("omi_mid") * size * state * sqm / 25) * 25)
    return [rent.alias("suggested_rent_mo"), F.when(known & (sc.zero("price") > 0), sc.exactly(rent * 12 / F.col("price") * 100, 2)).alias("estimated_yield_pct")]


def bullets(columns: list[Column], most: int = 4) -> Column:
    """The first of several optional lines."""
    return F.slice(F.array_compact(F.array(*columns)), 1, most)


def explanation() -> Column:
    """Up to four lines on a scored listing."""
    c, d = F.col, F.col("delta_label")
    whole = lambda x: sc.half_even(F.abs(x)).cast("string")
    verdict = F.when(c("score_total") >= 85, "A rare find.").when(c("score_total") >= 72, "Solid for the area.").when(c("score_total") >= 60, "Reasonable, with caveats.").when(c("score_total") >= 45, "Overpriced for what it is.").otherwise("Not worth the time.")
    price = (
        F.when(d <= -10, F.concat(whole(d), F.lit("% below "), c("n_comps").cast("string"), F.lit(" comparable flats."))).when(d <= -3, F.concat(F.lit("Slightly below comparable flats: "), whole(d), F.lit("%.")))
        .when(d <= 5, "In line with comparable flats.").when(d <= 15, F.concat(whole(d), F.lit("% above comparable flats."))).when(d.isNotNull(), F.concat(F.lit("Far above comparable flats: "), whole(d), F.lit("%.")))
    )
    floor = (
        F.when(c("floor_n") < 0, "Below ground.").when(c("floor_n") == 0, "Ground floor: light and noise.").when((c("floor_n") > 2) & ~c("elevator"), F.concat(F.lit("Floor "), c("floor_n").cast("string"), F.lit(" without a lift.")))
    )
    waiting = F.when(c("days_on_market") > 90, F.concat(F.lit("Listed for "), c("days_on_market").cast("string"), F.lit(" days."))).when(c("days_on_market") > 45, F.concat(F.lit("On the market for "), c("days_on_market").cast("string"), F.lit(" days.")))
    first = [F.when(c("gate"), "Capped: poor absolute value."), F.when(c("corporate"), "A corporate or short-term let.")]
    return bullets([*first, verdict, price, floor, waiting])


def full_explanation(sale: bool = False) -> Column:
    """Up to four lines on a scored listing, in tags: what lowered the score first, then the
    verdict, the price, the place (rentals) or the yield (sales), the flat, and what else fits.
    The listing has the columns of ``reasons_table`` and score_was_capped."""
    c, d = F.col, F.col("delta_label")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    held = lambda x: F.coalesce(x, F.lit(False))
    total, size, floor = sc.zero("score_total"), c("sqm"), c("floor_n")
    verdict = F.when(total >= 85, "rare find").when(total >= 72, "solid").when(total >= 60, "reasonable").when(total >= 45, "overpriced").otherwise("not worth the time")
    pct = sc.half_even(F.abs(d))
    price = F.when(d <= -10, t(pct, "% under ", sc.zero("n_comps"), " others")).when(d <= -3, t(pct, "% under")).when(d <= 5, "in line").when(d <= 15, t(pct, "% over")).when(d > 15, t("far over, ", pct, "%"))
    walk, gain = c("metro_walk_min"), c("estimated_yield_pct") if sale else F.lit(None)
    place = F.when(walk <= 5, t("metro in ", walk, " min, excellent")).when(walk <= 12, t("metro in ", walk, " min, decent")).when(walk.isNotNull(), t("metro in ", walk, " min, limited"))
    yields = F.when(gain >= 5.0, "strong yield").when(gain >= 3.5, "fair yield").when(gain.isNotNull(), "weak yield")
    flag, several = c("room_flag"), (sc.zero("sqm") > 0) & (sc.zero("rooms") > 0)
    against = (
        F.when(floor < 0, "below ground").when(floor == 0, "ground floor").when(held((floor > 2) & ~c("elevator")), t("floor ", floor, ", no lift")).when(held(flag == "severe") & several, "cramped").when(held(flag == "tight") & several, "tight")
        .when(flag.isin("micro_studio", "small_studio", "compact_studio"), F.translate(flag, "_", " "))
    )
    state = F.lower(F.coalesce("condition", F.lit("")))
    renovated = sc.any_of(state, ["ottim", "ristruttur", "nuovo"]) & ~(state.contains("da ") & state.contains("ristruttur"))
    favour = F.when(renovated, F.when(held((floor >= 3) & c("elevator")), t("renovated, floor ", floor, " with lift")).otherwise("renovated"))
    body = [verdict, price, yields if sale else place, F.coalesce(against, favour)]
    dom = c("days_on_market")
    more = F.when(held(sc.zero("ask_psqm") > c("compr_max") * 1.3), "over the zone's ceiling") if sale else F.when(dom > 90, t("listed for ", dom, " days")).when(dom > 45, t(dom, " days on the market"))
    room = F.size(F.array_compact(F.array(*body))) < 4
    corporate = F.lit(False) if sale else held(c("corporate"))
    capped = held(c("score_was_capped") & (d > 0)) & ~held(c("gate")) & ~corporate
    leads = [F.when(capped, t("capped, ", sc.half_even(d), "% over")), F.when(c("gate"), t("capped, poor value on ", sc.zero("sqm"), " m2"))]
    leads += [] if sale else [F.when(c("condo_fee_flag") == "high_condo_fees", t("fees of ", sc.zero("spese_condominiali"))), F.when(corporate, "corporate let"), F.when(corporate, "capped at 75")]
    return bullets([*leads, *body, F.when(room, more)])


def top_reasons(candidates: list[tuple[Column, str, str, Column]], k: int = 3) -> Column:
    """The k weightiest of (holds, component, text, weight) candidates; ties in the order given."""
    rows = [F.when(holds, F.struct((-weight.cast("double")).alias("w"), F.lit(n).alias("n"), F.lit(component).alias("component"), F.lit(text).alias("text"))) for n, (holds, component, text, weight) in enumerate(candidates)]
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, k), lambda r: F.concat(r["component"], F.lit(": "), r["text"]))
