"""Parsers of listings' texts, as Column expressions of built-in functions.

Nothing found is null. Texts are read whole unless a rule says how far it looks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimark import settings as st
from estimark.functions import scalars as sc


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def words_of(text: Column, separator: str = ",") -> Column:
    """Trimmed parts of a text that aren't empty."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


# Fixed values that results depend on.
ORDINALS = {"prim[oa]": 1, "second[oa]": 2, "terz[oa]": 3, "quart[oa]": 4, "quint[oa]": 5, "sest[oa]": 6, "settim[oa]": 7, "ottav[oa]": 8, "non[oa]": 9, "decim[oa]": 10}
NAMED_FLOORS = [(r"\bsemi[-\s]?nterrato\b", -1, "Seminterrato"), (r"\binterrato\b", -2, "Interrato"), (r"\bpiano\s+terra\b|\bp\.?\s*t\.?\b", 0, "Piano terra"), (r"\b(?:piano\s+)?rialzato\b", 0, "Piano rialzato")]
FEE = (
    r"(?i)\b(spese(?:\s*(?:condomin\w*|cond\.li|cond\b|annu\w+|mensil\w+))?|condominio)\b[\s:\-‐-―−]*"
    r"(?:di\s+|pari\s+a\s+)?(?:€|eur\w*\s*)?\s*(\d[\d.,]*)\s*(?:€|eur\w*)?"
)
FEE_UNKNOWN = r"(?i)da\s+definire|a\s+parte|esclus[aei]|incluse?"
FEE_YEARLY, FEE_MONTHLY = r"(?i)annu\w+|/\s*anno|all['’]?\s*anno", r"(?i)mensil\w+|/\s*mese|al\s+mese|/\s*mo\b"
PLACEHOLDER = r"(?i)posizione approssimativa"
NO = ("", "0", "no", "false")


def floor_in_prose(text: Column) -> tuple[Column, Column]:
    """Floor and label from a sentence such as "al 3° piano" or "secondo piano". Here a raised
    ground floor is floor 0; as a code of its own it is 1 (``parse_floor``)."""
    t = F.lower(text)
    number = F.coalesce(found(t, r"(?:al\s+)?(\d{1,2})\s*[°ºo]?\s*piano\b"), found(t, r"\bp\.\s*(\d{1,2})\b")).cast("int")
    floor, label = F, F
    for pattern, n, name in NAMED_FLOORS:
        floor, label = floor.when(t.rlike(pattern), n), label.when(t.rlike(pattern), name)
    floor = floor.when((number > 0) & (number < 25), number)
    for word, n in ORDINALS.items():
        floor = floor.when(t.rlike(rf"\b{word}\s+piano\b"), n)
    return floor.otherwise(None), label.otherwise(F.concat(floor.otherwise(None).cast("string"), F.lit("° piano")))


def surface(text: Column) -> Column:
    """The first number of a text, if it can be a flat's square metres."""
    n = found(text, r"(\d+)").try_cast("int")
    return F.when(n.between(10, 1000), n)


def rooms_beds_baths(*texts: Column) -> tuple[Column, Column, Column]:
    """Rooms, bedrooms and bathrooms named in the texts; more bedrooms than rooms are none."""
    t = F.lower(F.concat_ws(" ", *texts))
    rooms, beds, baths = sc.parse_rooms(t), found(t, r"(\d+)\s*camer[ae]").try_cast("int"), found(t, r"(\d+)\s*bagn[oi]").try_cast("int")
    return rooms, F.when(~F.coalesce(beds > rooms, F.lit(False)), beds), baths


def italian_number(text: Column) -> Column:
    """"1.250,50" is 1250.5: points group thousands, a comma begins the decimals."""
    plain = F.regexp_replace(text, r"\.", "")
    return F.regexp_replace(plain, ",", ".").try_cast("double")


def condo_fee(text: Column) -> Column:
    """Monthly condominium fee in euros: the first fee of 20 to 1,000 a month that isn't said to
    be included, excluded or open. What is said about a fee stands at most 10 characters before
    it or 40 behind it; yearly fees count a twelfth."""
    place = lambda x, state: F.position(x, state["text"], state["next"])

    def one(state: Column, match: Column) -> Column:
        return sc.let(place(match, state), lambda at: F.struct(
            state["text"].alias("text"), (at + F.length(match)).alias("next"),
            F.array_append(state["found"], F.struct(match.alias("match"), F.substring(state["text"], F.greatest(F.lit(1), at - 10), F.least(F.lit(10), at - 1) + F.length(match) + 40).alias("around"))).alias("found"),
        ))

    def fee(f: Column) -> Column:
        value = italian_number(F.regexp_extract(f["match"], FEE, 2))
        by_month = lambda v: F.when(v.isNotNull() & f["around"].rlike(FEE_YEARLY) & ~f["around"].rlike(FEE_MONTHLY), v / 12).otherwise(v)
        return sc.let(sc.let(value, by_month), lambda v: F.when(v.between(20, 1000) & ~f["around"].rlike(FEE_UNKNOWN), F.bround(v, 0).cast("int")))

    def first(t: Column) -> Column:
        start = F.struct(t.alias("text"), F.lit(1).alias("next"), F.array().cast("array<struct<match:string,around:string>>").alias("found"))
        # each step binds what it needs, as an expression is put in anew wherever its column is named
        return F.get(F.array_compact(F.transform(F.aggregate(F.regexp_extract_all(t, F.lit(FEE), F.lit(0)), start, one)["found"], fee)), F.lit(0))

    return sc.let(F.replace(text, F.lit("\u00a0"), F.lit(" ")), first)


def not_city(parts: Column, city: list[str]) -> Column:
    """Parts whose first word isn't a name of the city."""
    return F.filter(parts, lambda p: ~F.lower(F.split(p, r"\s+")[0]).isin(city))


def neighbourhood(address: Column, city: list[str]) -> Column:
    """The last part of an address before the city; the whole address if nothing else is left."""
    parts = not_city(words_of(address), city)
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.trim(address))


def street(address: Column, city: list[str]) -> Column:
    """The first two parts of an address that name neither the city nor a missing number."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: ~F.lower(p).isin(city) & ~p.rlike(r"(?i)^(s\.n\.c\.?|snc)$"))
    return F.regexp_replace(F.array_join(F.slice(parts, 1, 2), ", "), "^[, ]+|[, ]+$", "")


def address_in_title(title: Column) -> Column:
    """What follows " in " (or " a " before a capital) in a title."""
    t = F.trim(title)
    return F.coalesce(found(t, r"(?is)^.*?\s+in\s+(.+)$"), found(t, r"(?s)^.*?\s+a\s+([A-ZÀ-ɏ].*)$"))


def hidden(address: Column) -> Column:
    return F.coalesce(address, F.lit("")).rlike(PLACEHOLDER) | (F.trim(F.coalesce(address, F.lit(""))) == "")


def truth(raw: Column) -> Column:
    """True or false from a text; null stays unknown."""
    return F.when(raw.isNotNull(), ~F.lower(F.trim(raw)).isin(*NO))


def either(*raws: Column) -> Column:
    """The first value that isn't empty, a false or a zero; else the last one. A text such as
    "no" is a value."""
    return F.coalesce(*[F.when(~F.lower(F.trim(r)).isin("", "0", "false"), r) for r in raws[:-1]], raws[-1])


def published(*raws: Column) -> Column:
    """The first of several texts that begins with a date."""
    return F.coalesce(*[F.try_to_date(F.substring(r, 1, 10), "yyyy-MM-dd") for r in raws])


def canonical_condition(raw: Column) -> Column:
    """Condition by the words of a text; an unknown text stays as it is."""
    c = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(c.contains("da ristrutturare"), "da_ristrutturare").when(c.contains("fatiscente"), "fatiscente").when(c.contains("ristrutturato"), "ristrutturato")
        .when(sc.any_of(c, ["nuovo", "eccellente", "ottimo"]), "ottimo").when(sc.any_of(c, ["buono", "normale"]), "buono").when(sc.any_of(c, ["abitabile", "discreto"]), "abitabile").otherwise(F.coalesce(raw, F.lit("")))
    )


def poi_kind(tags: Column, south: Column, north: Column, west: Column, east: Column, lat: Column) -> Column:
    """Kind of a map element by its tags (a map). Parks with known bounds have 5,000 m2 at least."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    metro = (tag("station") == "subway") | (tag("railway") == "subway_entrance") | ((tag("railway") == "station") & (tag("subway") == "yes"))
    area = F.abs(north - south) * 111_000 * F.abs(east - west) * 111_000 * F.cos(F.radians(lat))
    return (
        F.when(F.coalesce(metro, F.lit(False)), "metro").when(tag("railway") == "tram_stop", "tram").when(tag("shop") == "supermarket", "supermarket")
        .when((tag("leisure") == "park") & F.coalesce(area >= 5000, F.lit(True)), "park").when(tag("amenity").isin("university", "college"), "university")
    )


def metro_lines(tags: Column) -> Column:
    """Sorted lines ("M1, M2") from the description, else from the first tag that names any."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    joined = lambda lines: F.array_join(F.array_sort(F.array_distinct(lines)), ", ")
    described = F.transform(F.regexp_extract_all(tag("description"), F.lit(r"[Mm]i(\d)"), F.lit(1)), lambda n: F.concat(F.lit("M"), n))

    def named(key: str) -> Column:
        parts = F.transform(words_of(F.translate(tag(key), ";", ",")), lambda p: F.upper(p))
        lines = F.transform(parts, lambda p: F.when(p.startswith("M") & (F.length(p) <= 3), p).when(p.rlike(r"^\d+$"), F.concat(F.lit("M"), p)))
        return F.array_compact(lines)

    first = F.coalesce(*[F.when(F.size(named(k)) > 0, joined(named(k))) for k in ("line", "lines", "network:metro", "ref")], F.lit(""))
    return F.when(F.size(described) > 0, joined(described)).otherwise(first)


def search_url(base: str, city: Column, areas: Column, filters: dict[str, Column]) -> Column:
    """A portal's search address: city, areas and the filters that are set."""
    query = F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in filters.items()])), "&")
    path = F.concat_ws("/", F.lit(base), sc.slug(city), F.nullif(F.array_join(F.transform(areas, sc.slug), ","), F.lit("")))
    return F.concat(path, F.lit("/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def portal_a_url(base: str, city: Column, area: Column, filters: dict[str, Column], page: Column) -> Column:
    """Portal A's search address: the city, the area if one is named, filters that are set (not 0)
    and the page from the second on as query parameters."""
    query = [F.when(sc.zero(v) != 0, F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in filters.items()]
    query.append(F.when(page > 1, F.concat(F.lit("pag="), page.cast("string"))))
    text = F.array_join(F.array_compact(F.array(*query)), "&")
    place = F.concat(F.lit(f"{base}/affitto-case/"), city, F.lit("/"), F.coalesce(F.concat(F.nullif(area, F.lit("")), F.lit("/")), F.lit("")))
    return F.concat(place, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def portal_b_url(base: str, city: Column, area: Column, most: Column, least_sqm: Column, least_rooms: Column, page: Column, sale: bool = False) -> Column:
    """Portal B's search address: filters are words of the path, each number of rooms from the least
    on has its own, rentals ask for long terms, and pages are files."""
    rooms = sc.zero(least_rooms)
    words = [F.when(sc.zero(most) != 0, F.concat(F.lit("prezzo_"), most.cast("string"))), F.when(sc.zero(least_sqm) != 0, F.concat(F.lit("dimensione_"), least_sqm.cast("string")))]
    words += [F.when((rooms != 0) & (rooms <= n), F.lit(word)) for n, word in st.ROOM_TOKENS.items()]
    words += [] if sale else [F.lit("affitto-lungo-termine")]
    text = F.array_join(F.array_compact(F.array(*words)), ",")
    place = F.coalesce(F.nullif(area, F.lit("")), F.concat(city, F.lit("-"), city))
    where = F.when(F.coalesce(area, F.lit("")) != "", F.concat(city, F.lit("/"), place)).otherwise(place)
    path = F.concat(F.lit(f"{base}/{'vendita' if sale else 'affitto'}-case/"), where, F.lit("/"))
    return F.concat(path, F.when(text != "", F.concat(F.lit("con-"), text, F.lit("/"))).otherwise(""), F.when(page > 1, F.concat(F.lit("lista-"), page.cast("string"), F.lit(".htm"))).otherwise(""))
