"""Scalar expressions over listing columns. Everything is a Column built from built-in functions.

Missing numbers count as 0 where a rule says so (``zero``); booleans have three values, and a
rule asks for true or false, never for "not true"."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimark import settings as st

EARTH_M = 6_371_000.0


def let(value: Column, use) -> Column:
    """``use`` of the value, which is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def zero(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(x, F.lit(0))


def exactly(x: Column, places: int) -> Column:
    """Rounded half up on six decimals, so binary noise below them doesn't decide."""
    return F.round(x.cast("decimal(18,6)"), places).cast("double")


def half_even(x: Column) -> Column:
    """Rounded to whole numbers, ties to even."""
    return F.bround(x.cast("decimal(18,6)"), 0).cast("int")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null without both places


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def condition_group(condition: Column) -> Column:
    c = F.trim(F.lower(condition))
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when((c == "da_ristrutturare") | (c.contains("da ") & c.contains("ristruttur")) | c.contains("fatiscent"), "needs_work")
        .when(any_of(c, ["ristruttur", "ottim", "nuovo", "costruz"]), "premium")
        .when(any_of(c, ["buon", "abitabil", "normale"]), "standard")
        .otherwise("unknown")
    )


def condition_factor(comparable: Column, target: Column) -> Column:
    return lookup(F.concat_ws(">", comparable, target), {f"{a}>{b}": v for (a, b), v in st.CONDITION_FACTORS.items()}, 1.0)


def size_band(sqm: Column) -> tuple[Column, Column]:
    share = F.when(sqm <= 50, 0.15).when(sqm <= 75, 0.20).otherwise(0.25)
    return sqm * (1 - share), sqm * (1 + share)


def floor_coefficient(floor: Column, lift: Column) -> Column:
    def by_bucket(k: int) -> Column:
        out = F
        for row in st.FLOORS[:-1]:
            out = out.when(floor <= row[0], row[k])
        return out.otherwise(st.FLOORS[-1][k])

    up, down = by_bucket(1), by_bucket(2)
    blended = F.when(floor > 3, down * 0.6 + up * 0.4).otherwise((up + down) / 2)
    return F.when(floor.isNull(), 0.0).when(lift.isNull(), blended).when(lift, up).otherwise(down)


def condition_key(condition: Column) -> Column:
    c = F.trim(F.lower(condition))
    return (
        F.when(c.isNull() | (c == ""), None).when(c.contains("fatiscente"), "fatiscente")
        .when(c.contains("da_ristrutturare") | (c.contains("da ") & c.contains("ristruttur")), "da_ristrutturare")
        .when(c.contains("ottim"), "ottimo").when(c.contains("nuov") | c.contains("costruz"), "nuova_costruzione")
        .when(c.contains("ristruttur"), "ristrutturato").when(c.contains("abitabil") & ~c.contains("buon"), "abitabile").otherwise("buono")
    )


def room_flag(sqm: Column, rooms: Column) -> Column:
    each = sqm / rooms
    shared = F.when(each < 10, "severe").when(each < 14, "tight")
    alone = F.when(sqm < 30, "micro_studio").when(sqm < 38, "small_studio").when(sqm < 45, "compact_studio")
    return F.when(zero(sqm) > 0, F.when(zero(rooms) >= 2, shared).otherwise(alone))


def property_score(year: int | Column | None = None) -> Column:
    """0-100 from the physical columns of a listing; 50 if none is known. year: to count ages from,
    today's if it isn't given."""
    c = F.col
    now = F.year(F.current_date()) if year is None else F.lit(year)
    key, age = condition_key(c("condition")), now - c("year_built")
    good, poor = key.isin("ottimo", "nuova_costruzione", "ristrutturato"), key.isin("da_ristrutturare", "fatiscente")
    heat = F.trim(F.lower("heating_type"))
    rent, fee = zero("rent_mo"), zero("spese_condominiali")
    flag = room_flag(c("sqm"), c("rooms"))
    parts = [
        floor_coefficient(c("floor_n"), c("elevator")),
        lookup(key, st.CONDITIONS, 0.0),
        F.when(c("year_built") <= 1900, 0.0).when((age > 40) & good, 0.05).when((age > 20) & (age <= 40) & good, 0.02).when((age > 40) & poor, -0.05),
        F.when(c("is_external"), 0.05), lookup(F.upper(F.trim("energy_class")), st.ENERGY, 0.0),
        F.when(c("has_balcony"), 0.04), F.when(c("has_parking"), 0.04),
        F.when(heat.contains("autonomous") | heat.contains("autonomo"), 0.05)
        .when(heat.contains("centraliz") & (heat.contains("valvol") | heat.contains("termost")), 0.02)
        .when(heat.contains("none") | heat.isin("no", "assente"), -0.03),
        F.when(c("furnished"), 0.08), F.when(c("bathrooms") >= 2, 0.03), F.when(c("photo_count") < 5, -0.05),
        F.when(c("days_on_market") > 60, -0.07).when(c("days_on_market") > 30, -0.03),
        F.when((rent > 0) & (fee > rent * 0.20), -0.10).when((rent > 0) & (fee > rent * 0.12), -0.04),
        lookup(flag, {"severe": -0.20, "tight": -0.10, "micro_studio": -0.25, "small_studio": -0.15, "compact_studio": -0.08}, 0.0),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.greatest(F.lit(0), F.least(F.lit(100), half_even(50 + total * 150)))


def penalty_score(s: st.Settings) -> Column:
    c, floor = F.col, F.col("floor_n")
    cuts = [
        F.when(floor <= -2, 55).when(floor == -1, 40).when(floor == 0, 20),
        F.when(~c("elevator") & (floor >= 5), 25).when(~c("elevator") & (floor >= 4), 15),
        F.when((c("sqm") > 0) & (c("rooms") > 0) & (c("sqm") / c("rooms") < 12), 15),
        F.when(c("days_on_market") > s.penalty_dom_stale, 25).when(c("days_on_market") > s.penalty_dom_warn, 10),
        F.when((zero("rent_mo") > 0) & (zero("spese_condominiali") > zero("rent_mo") * 0.25), 15),
    ]
    return F.greatest(F.lit(0), 100 - reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in cuts]))


def price_score(delta: Column, rent: Column, blended: Column, sqm: Column, s: st.Settings) -> Column:
    """0-100 by the distance to the benchmark; small monthly sums soften a bad score."""
    lo, hi, great, bad = s.price_neutral_lo, s.price_neutral_hi, s.price_great, s.price_bad
    raw = (
        F.when(delta <= great, 100.0).when(delta <= lo, 100 - (delta - great) / (lo - great) * 50).when(delta <= hi, 50.0)
        .when(delta <= bad, 50 - (delta - hi) / (bad - hi) * 50).otherwise(0.0)
    )
    diff = F.abs(rent - blended * sqm)
    factor = F.when(diff < s.euro_impact_small, 0.7).when(diff > s.euro_impact_large, 1.0).otherwise(0.7 + 0.3 * (diff - s.euro_impact_small) / (s.euro_impact_large - s.euro_impact_small))
    soft = F.when((raw < 50) & (zero(sqm) > 0) & (blended > 0) & (zero(rent) > 0), 50 - (50 - raw) * factor).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), soft))


def blend(median: Column, omi: Column, confidence: Column) -> Column:
    share = F.when(confidence >= 70, 1.0).when(confidence >= 40, 0.8).otherwise(0.5)
    return F.when(zero(omi) <= 0, median).otherwise(median * share + omi * (1 - share))


def blend_sale(median: Column, omi: Column, n: Column, confidence: Column) -> Column:
    return F.when(zero(omi) <= 0, median).when(n >= 15, blend(median, omi, confidence)).otherwise(median * 0.4 + omi * 0.6)


def price_ceiling(delta_pct: Column) -> Column:
    """The highest score at this distance to the benchmark; null if it is unknown."""
    return F.when(delta_pct <= 0, 100).when(delta_pct <= 5, 72).when(delta_pct <= 10, 62).when(delta_pct <= 20, 50).when(delta_pct > 20, 38)


def value_gate(psqm: Column, sqm: Column) -> Column:
    """The ceiling for small flats at high prices; null where none applies."""
    small = (zero(psqm) > 0) & (zero(sqm) > 0) & (zero(sqm) < 60)
    return F.when(small, F.when(psqm >= 7000, 55).when((psqm >= 5800) & (sqm <= 58), 65).when((psqm >= 5000) & (sqm <= 45), 70))


def geo_score() -> Column:
    steps = {
        "metro_m": [(300, 40), (500, 35), (800, 28), (1200, 18), (2000, 8)], "tram_m": [(200, 15), (500, 10), (1000, 5)],
        "supermarket_m": [(300, 20), (600, 14), (1000, 8)], "park_m": [(300, 15), (800, 10), (1500, 5)], "university_m": [(500, 10), (1500, 6)],
    }
    total = F.lit(0)
    for column, rows in steps.items():
        points = F
        for limit, value in rows:
            points = points.when(F.col(column) <= limit, value)
        total = total + F.coalesce(points, F.lit(0))
    return F.least(F.lit(100), total)


def effective_rent() -> list[Column]:
    rent, fee, sqm = (zero(x) for x in ("rent_mo", "spese_condominiali", "sqm"))
    kept = F.when((rent > 0) & (fee > rent * 0.30), rent * 0.15).otherwise(fee)
    total = rent + kept
    capped = F.least(fee, rent * 0.20)
    return [
        F.when(total != 0, exactly(total, 2)).alias("effective_rent_mo"),
        F.when((total != 0) & (sqm != 0), exactly(total / F.nullif(sqm, F.lit(0)), 2)).alias("effective_psqm_rent"),
        F.when(rent > 0, exactly(kept / F.nullif(rent, F.lit(0)) * 100, 1)).otherwise(0.0).alias("condo_pct_of_rent"),
        F.when((rent == 0) | (sqm == 0), zero("ask_psqm")).otherwise(exactly((rent + capped) / F.nullif(sqm, F.lit(0)), 2)).alias("ask_psqm_effective"),
        F.when((rent > 0) & (fee >= rent * 0.20), "high_condo_fees").when((rent > 0) & (fee >= rent * 0.12), "elevated_condo_fees").alias("condo_fee_flag"),
    ]


def label(delta: Column, middle: str, what: str) -> Column:
    return F.when(F.abs(delta) < 0.5, middle).when(delta > 0, F.concat(F.lit("+"), F.format_string("%.1f", delta), F.lit(f"% above {what}"))).when(delta.isNotNull(), F.concat(F.format_string("%.1f", delta), F.lit(f"% below {what}")))


FLOOR_CODES = {"T": 0, "PT": 0, "TERRA": 0, "PIANO TERRA": 0, "P.T.": 0, "PT.": 0, "RDC": 0, "GROUND": 0, "G": 0, "R": 1, "RIALZATO": 1, "PR": 1, "PIANO RIALZATO": 1,
               "S": -1, "S1": -1, "SEMI": -1, "SEMINTERRATO": -1, "I": -2, "INTERRATO": -2, "SOTTOSUOLO": -2, "S2": -2, "S3": -2, "S4": -2, "S5": -2}
RAISED = ["R", "RIALZATO", "PR", "PIANO RIALZATO"]


def parse_floor(raw: Column) -> tuple[Column, Column]:
    """Lowest floor of a floor text such as "S, 3" or "4 - 5", and its label."""
    codes = F.create_map(*[F.lit(x) for kv in FLOOR_CODES.items() for x in kv])
    tokens = F.filter(F.transform(F.split(raw, r",\s*|\s+[-–]\s+"), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    number = lambda t: F.coalesce(F.try_element_at(codes, t), F.nullif(F.regexp_extract(t, r"-?\d+", 0), F.lit("")).try_cast("int"))
    said = ~F.upper(F.trim(raw)).isin("", "NONE", "N/A")
    both = let(tokens, lambda ts: F.struct(F.when(said, F.array_min(F.transform(ts, number))).alias("floor"), F.exists(ts, lambda t: t.isin(RAISED)).alias("raised")))

    def named(x: Column) -> Column:
        floor = x["floor"]
        name = F.when(floor <= -2, "Interrato").when(floor == -1, "Seminterrato").when(floor == 0, "Piano terra").when((floor == 1) & x["raised"], "Piano rialzato").otherwise(F.concat(floor.cast("string"), F.lit("° piano")))
        return F.when(floor.isNotNull(), name)

    return both["floor"], let(both, named)


def digits_within(text: Column, lo: int, hi: int) -> Column:
    """All digits of the text as a number, if it lies within the range (else null)."""
    value = F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")).try_cast("long")
    return F.when(value.between(lo, hi), value)


ROOM_NAMES = {"monolocale": 1, "bilocale": 2, "trilocale": 3, "quadrilocale": 4, "pentalocale": 5, "esalocale": 6}


def parse_rooms(text: Column) -> Column:
    t, out = F.lower(text), F
    for word, n in ROOM_NAMES.items():
        out = out.when(t.contains(word), n)
    return out.otherwise(F.nullif(F.regexp_extract(t, r"([0-9]+)\s*local", 1), F.lit("")).try_cast("int"))


@functools.cache
def decomposed() -> tuple[str, str, dict[str, str]]:
    """By Unicode's compatibility decomposition: characters that become one ASCII character, what
    they become, and characters that become several."""
    one, to, several = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.decomposition(letter) == "":
            continue
        ascii_ = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(ascii_) == 1:
            one.append(letter)
            to.append(ascii_)
        elif ascii_:
            several[letter] = ascii_
    return "".join(one), "".join(to), several


@functools.cache
def class_of(letters: str) -> str:
    """A regular expression's class of the letters, as ranges of neighbours."""
    codes = sorted(map(ord, letters))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def slug(text: Column) -> Column:
    """A name as part of an address: letters without marks, runs of anything but letters and digits
    as one hyphen."""
    one, to, several = decomposed()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    plain = F.translate(F.when(text.rlike(class_of("".join(several))), spelled).otherwise(text), one, to)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(plain, r"[^\x00-\x7f]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
