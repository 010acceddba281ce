"""Queries on raw portal rows: normalisation, parsers of prose, stored rows.

``part`` rows stand for raw rows; each field takes one of a few cases by the key, and the SQL
states what each case must become."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import prose as pr
from estimark.operators import flags, normalise
from estimark.plans.listings import SQL, listings, spread

K = "p_partkey"
CITY_NAMES = ["milano", "mi", "milan", "italia", "italy"]


def parts(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col(K).alias("k")), "k")


def case(values, shift=0):
    """One of the values by the key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col("k") + shift) % len(values) + 1).cast("int"))


def sql_case(values, kind="VARCHAR", shift=0):
    quoted = ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"(CAST([{quoted}] AS {kind}[]))[({K} + {shift}) % {len(values)} + 1]"


#: For each field of an item: cases of its JSON, and what they become.
SURFACE = ['"surface":"85 m²"', '"surface":"120"', '"surfaceValue":"60 m²"', '"surface":"n.d."', '"surface":"45 m²"', '"surface":null', '"surface":"72,5 m²"'], [85, 120, 60, None, 45, None, 725]
ROOMS = ['"rooms":"3"', '"roomsNumber":"2"', '"rooms":"5+"', '"y":0', '"numRooms":"4"'], [3, 2, None, None, 4]
TITLE = ["Bilocale in Via Roma", "Attico 3 locali", "Ampio quadrilocale", "Casa"], [2, 3, 4, None]
BEDS = ['"bedRoomsNumber":"1"', '"bedRoomsNumber":"0"', '"bedrooms":"9"'], [1, None, 9]
BATHS = ['"bathrooms":"2"', '"bathRooms":"x"'], [2, None]
FLOOR = ['"floor":{"abbreviation":"3","value":"9"}', '"floor":"S, 3"', '"floor":"T"', '"floor":"R"', '"floor":null', '"floor":{"value":"S2"}'], [3, -1, 0, 1, None, -2], ["3° piano", "Seminterrato", "Piano terra", "Piano rialzato", None, "Interrato"]
LIFT = ['"elevator":true', '"elevator":false', '"elevator":"no"', '"elevator":false,"hasElevator":"sì"'], [True, None, False, True]
OUTSIDE = ['"isExternal":true', '"ga4Exposure":"Esterno"', '"isExternal":false'], [True, True, None]
BALCONY = ['"hasBalcony":true', '"balcony":"no"', '"hasBalcony":false,"garden":"si"', '"features":[{"type":"BALCONY","label":"Balcone vista"},{"type":"x","label":"Posto in garage"}]', '"features":[]'], [True, False, True, True, None], [None, None, None, True, None]
HEAT = ['"heatingType":"Riscaldamento autonomo"', '"heating":"centralizzato"', '"heatingType":"a gas"', '"y2":0'], ["autonomous", "centralised", "unknown", None]
FURNISHED = ['"furnished":true', '"isFurnished":"Arredato"', '"furnished":"no"', '"y3":0', '"furnished":false'], [True, True, False, None, None]
PHOTOS = ['"multimedia":{"photos":[{"urls":{"large":"a.jpg"}},{"urls":{"medium":""},"url":"b.jpg"},{"urls":null}]}', '"multimedia":{"photos":[]}', '"y4":0'], ["a.jpg,b.jpg", "", ""], [3, 0, 0], ["a.jpg", None, None]
DATES = ['"publicationDate":"2024-03-05T10:00"', '"publicationDate":"n.d.","insertionDate":"2024-02-01"', '"y5":0'], ["2024-03-05", "2024-02-01", None], [26, 59, None]
STATE = ['"ga4Condition":"Ottimo / Ristrutturato"', '"condition":"Da ristrutturare"', '"condition":"Buono"', '"y6":0'], ["Ottimo / Ristrutturato", "Da ristrutturare", "Buono", "Appartamento"], ["ristrutturato", "da_ristrutturare", "buono", "Appartamento"]
SELLER = ['"advertiser":{"agency":{"id":"7","displayName":"Casa","type":"agency","url":"u"},"private":{"name":"Mario"}}', '"advertiser":{"private":{"name":"Mario","label":"private"}}', '"y7":0'], ["7", "", ""], ["Casa", "Mario", ""], ["agency", "private", ""], ["u", "", ""]
FEES = ['"expenses":"€ 120"', '"description":"Spese condominiali: € 1.200 annue, luminoso"', '"description":"spese incluse 90 euro"', '"y8":0', '"description":"spese escluse. Bellissimo e luminoso appartamento con vista. Condominio 85,5 euro al mese"'], [120, 100, None, None, 86]
PLACE = ['"location":{"microzone":{"name":"Navigli"},"city":"Milano","address":"Via A, 3","latitude":45.45,"longitude":9.17}', '"location":{"macrozone":"Centro","city":"Milano"}', '"location":{"city":"Milano"}'], ["Navigli", "Centro", "Milano"]


def items(spark, sf_dir, price):
    """One JSON item a row."""
    inner = [case(x[0]) for x in (SURFACE, ROOMS, BEDS, BATHS, FLOOR, LIFT, OUTSIDE, BALCONY, HEAT, FURNISHED, PHOTOS, STATE, FEES, PLACE)]
    outer = [F.concat(F.lit('"title":"'), case(TITLE[0]), F.lit('"')), case(DATES[0]), case(SELLER[0]), F.lit('"typology":{"name":"Appartamento"},"energyClass":"g"')]
    body = F.concat(F.lit('{"realEstate":{"id":"'), F.col("k").cast("string"), F.lit('","price":{"value":'), price, F.lit("},"), F.concat_ws(",", *outer), F.lit(',"properties":[{'), F.concat_ws(",", *inner), F.lit("}]}}"))
    return parts(spark, sf_dir).select(body.alias("body"))


def joined(df):
    return df.withColumn("photos", F.concat_ws(",", "photos")).withColumn("published_date", F.col("published_date").cast("string"))


def portal_a_rentals(spark, sf_dir):
    price = F.when(F.col("k") % 10 == 3, "null").otherwise((500 + F.col("k") % 1500).cast("string"))
    return joined(normalise.portal_a(items(spark, sf_dir, price), "body", "milano", F.lit("2024-03-31").cast("date")))


def portal_a_sales(spark, sf_dir):
    """With rents among the sales, and prices under the city's least."""
    price = F.when(F.col("k") % 10 == 3, "0").when(F.col("k") % 10 == 4, "900").when(F.col("k") % 10 == 5, "40000").otherwise((150_000 + F.col("k") * 331 % 400_000).cast("string"))
    return joined(normalise.portal_a(items(spark, sf_dir, price), "body", "milano", F.lit("2024-03-31").cast("date"), sale=True))


B_PRICE = ["€ 1.200 /mese", "950", "prezzo su richiesta", "€ 50", "€ 350.000"], [1200, 950, None, None, None], [None, None, None, None, 350_000]
B_SIZE = ["80 m²", "65mq", "", "5 m²"], [80, 65, None, None]
B_ROOMS = ["Trilocale, 2 camere", "4 locali 1 bagno", "monolocale 3 camere", ""], [3, 4, 1, None], [2, None, None, None], [None, 1, None, None]
B_FLOOR = ["6º piano con ascensore", "Piano rialzato", "", "S1 senza ascensore", "", "", "", ""]
B_DESC = ["", "", "Luminoso al terzo piano con balcone", "", "appartamento al piano terra", "al 4° piano, arredato, box doppio", "seminterrato all'asta giudiziaria", "Guastalla, nuda proprietà p. 7"]
B_FLOORS = [6, 1, 3, -1, 0, 4, -1, 7], ["6° piano", "Piano rialzato", "3° piano", "Seminterrato", "Piano terra", "4° piano", "Seminterrato", "7° piano"]
B_LIFT = [True, None, None, True, None, None, None, None]
B_BALCONY, B_BOX, B_FURNISHED = [None, None, True, None, None, None, None, None], [None, None, None, None, None, True, None, None], [None, None, None, None, None, True, None, None]
B_AUCTION, B_BARE = [False, False, False, False, False, False, True, False], [False, False, False, False, False, False, False, True]
B_ADDRESS = ["Via Roma 3, Navigli, Milano MI", "Corso Italia, Cinque Vie, Milano", "Milano", "Brera"], ["Navigli", "Cinque Vie - Carrobbio", "Milano", "Brera"]
SYNONYMS = {"Cinque Vie": "Cinque Vie - Carrobbio"}


def portal_b_rows(spark, sf_dir):
    return parts(spark, sf_dir).select(
        F.when(F.col("k") % 50 == 0, " ").otherwise(F.col("k").cast("string")).alias("id"), case(["Casa", "Bella casa "]).alias("title"), case(B_PRICE[0]).alias("price_text"), case(B_SIZE[0]).alias("size_text"), case(B_ROOMS[0]).alias("rooms_text"),
        case(B_FLOOR).alias("floor_text"), case(B_DESC).alias("description"), case(B_ADDRESS[0]).alias("address"), case(["/immobile/1", "https://x/1", None]).alias("url"), case(["i.jpg", "", None]).alias("img"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("photos"),
    )


def portal_b_rentals(spark, sf_dir):
    df = normalise.portal_b(portal_b_rows(spark, sf_dir), "milano", CITY_NAMES, flags.auction_or_bare, SYNONYMS)
    return df.withColumn("photos", F.concat_ws(",", "photos"))


def portal_b_sales(spark, sf_dir):
    df = normalise.portal_b(portal_b_rows(spark, sf_dir), "milano", CITY_NAMES, flags.auction_or_bare, SYNONYMS, sale=True)
    return df.withColumn("photos", F.concat_ws(",", "photos"))


def valuation_inputs(spark, sf_dir):
    """Rentals of both portals, as a valuation asks for them."""
    a, b = portal_a_rentals(spark, sf_dir), portal_b_rentals(spark, sf_dir)
    named = lambda df, portal: normalise.valuation_input(df).withColumn("portal", F.lit(portal))
    both = named(a, "a").unionByName(named(b, "b"))
    return both.groupBy("portal", "neighbourhood", "floor_n").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.count("latitude").alias("n_placed"), F.count_if("elevator").alias("n_lift"))


FEE_TEXTS = ["Spese condominiali: € {} mensili", "Spese annue {} euro", "spese escluse, {} euro", "condominio di {},50 al mese", "spese cond {} / anno"]
FEE_SQL = ["CASE WHEN f BETWEEN 20 AND 1000 THEN f END", "CASE WHEN f / 12.0 BETWEEN 20 AND 1000 THEN round_even(f / 12.0, 0)::INT END", "NULL", "CASE WHEN f + 0.5 BETWEEN 20 AND 1000 THEN round_even(f + 0.5::DOUBLE, 0)::INT END", "CASE WHEN f / 12.0 BETWEEN 20 AND 1000 THEN round_even(f / 12.0, 0)::INT END"]


def condo_fees(spark, sf_dir):
    """Fees in sentences, alone and behind a first one that says it is excluded."""
    fee = (F.col("k") * 7 % 1100).cast("string")
    text = case(FEE_TEXTS)
    text = F.replace(text, F.lit("{}"), fee)
    later = F.concat(F.lit("Spese a parte 300 euro. Appartamento molto luminoso in centro, ottimo stato. "), text)
    return parts(spark, sf_dir).select("k", pr.condo_fee(text).alias("fee"), pr.condo_fee(later).alias("later_fee"))


ADDRESSES = ["Via Carlo Perini, 18, Quarto Oggiaro, Milano", "Corso Italia, snc, Carrobbio, Milano MI", "Milano", " , Brera ,", None]
STREETS = ["Via Carlo Perini, 18", "Corso Italia, Carrobbio", "", "Brera", None]
QUARTERS = ["Quarto Oggiaro", "Carrobbio", "Milano", "Brera", None]
TITLES = ["Bilocale in Via Roma, 10, Navigli, Milano", "Trilocale a Lodi - Brenta, Milano", "appartamento a due piani", "Casa IN affitto in Centro", None]
FROM_TITLE = ["Via Roma, 10, Navigli, Milano", "Lodi - Brenta, Milano", None, "affitto in Centro", None]


def addresses(spark, sf_dir):
    address, title = case(ADDRESSES), case(TITLES)
    return parts(spark, sf_dir).select("k", pr.street(address, CITY_NAMES).alias("street"), pr.neighbourhood(address, CITY_NAMES).alias("neighbourhood"), pr.address_in_title(title).alias("from_title"))


TAGS = ["station=subway", "railway=station;subway=yes", "railway=station", "railway=tram_stop", "shop=supermarket", "leisure=park", "amenity=college", "shop=bakery"]
KINDS = ["metro", "metro", None, "tram", "supermarket", "park", "university", None]
LINES = ["description=Fermata mi3 e Mi1", "line=M2;M1;2", "ref=5", "lines=verde", "description=verde;ref=M4"]
LINE_NAMES = ["M1, M3", "M1, M2", "M5", "", "M4"]


def poi_kinds(spark, sf_dir):
    """Map elements by their tags; every third park is too small, every fifth has no bounds."""
    tags = F.str_to_map(case(TAGS), F.lit(";"), F.lit("="))
    side = F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 3 == 0, 0.0005).otherwise(0.002)
    kind = pr.poi_kind(tags, F.lit(45.0), 45.0 + side, F.lit(9.0), 9.0 + side, F.lit(45.0))
    lines = F.when(F.col("k") % 5 == 1, F.create_map(F.lit("line"), F.lit("M2;M1;2"))).otherwise(F.str_to_map(case(LINES), F.lit(";"), F.lit("=")))
    return parts(spark, sf_dir).select("k", kind.alias("kind"), pr.metro_lines(lines).alias("lines"))


def poi_counts(spark, sf_dir):
    return poi_kinds(spark, sf_dir).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


CONDITIONS = ["Da Ristrutturare", "fatiscente", "Completamente ristrutturato", "Ottimo stato", "Nuovo", "buono", "Abitabile", "discreto", "strano", None]
CANONICAL = ["da_ristrutturare", "fatiscente", "ristrutturato", "ottimo", "ottimo", "buono", "abitabile", "abitabile", "strano", ""]


def canonical_conditions(spark, sf_dir):
    return parts(spark, sf_dir).select("k", pr.canonical_condition(case(CONDITIONS)).alias("condition"))


PROSE = ["Luminoso al 3° piano", "al secondo piano senza ascensore", "piano rialzato", "P.T. con giardino", "semi-interrato", "seminterrato ampio", "locale interrato", "al 30 piano", "p. 12 vista", "decimo piano", "nessun dato", None]
PROSE_FLOORS = [3, 2, 0, 0, -2, -1, -2, None, 12, 10, None, None]
PROSE_LABELS = ["3° piano", "2° piano", "Piano rialzato", "Piano terra", "Interrato", "Seminterrato", "Interrato", None, "12° piano", "10° piano", None, None]


def floors_in_prose(spark, sf_dir):
    floor, label = pr.floor_in_prose(case(PROSE))
    return parts(spark, sf_dir).select("k", floor.alias("floor_n"), label.alias("floor_label"))


STORED = ["id", "listing_type", "city", "price", "ask_psqm", "ask_psqm_rent", "sqm", "condition", "condominium_fees", "excluded"]


def messy(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", "rent_mo", "ask_psqm", "sqm", "spese_condominiali", F.when(F.col("id") % 6 == 3, "").otherwise(F.col("condition")).alias("condition"))
    return df.withColumns({"city": F.when(F.col("id") % 3 == 0, "La Maddalena").when(F.col("id") % 3 == 1, "Milano").otherwise("roma"), "city_key": F.when(F.col("id") % 3 == 1, "milano"), "_excluded": F.col("id") % 4 == 0, "junk": F.lit(1)})


def stored_rows(spark, sf_dir):
    return normalise.to_row(messy(spark, sf_dir), "rental", STORED)


def listing_aliases(spark, sf_dir):
    return normalise.from_row(stored_rows(spark, sf_dir), "rental").select("id", "rent_mo", "ask_psqm_rent", "spese_condominiali")


def union_keys(spark, sf_dir):
    df = messy(spark, sf_dir)
    out = normalise.union_of_keys(df.where("id % 2 = 0").select("id", "rent_mo"), df.where("id % 2 = 1").select("sqm", "id"))
    return out.select("id", "rent_mo", "sqm")


def seen_backfill(spark, sf_dir):
    """Dates of customers' first and last orders where the listing has none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seen = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("first_seen_date"), F.max(F.to_date("o_orderdate")).alias("last_seen_date"))
    df = listings(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.lit("2001-02-03").cast("date")).alias("first_seen_date"), F.lit(None).cast("date").alias("last_seen_date"))
    return normalise.backfill_seen(df, seen, "id")


def search_urls(spark, sf_dir):
    areas = F.when(F.col("k") % 2 == 0, F.array(F.lit("Città Studi"), F.lit("Brera"))).otherwise(F.array().cast("array<string>"))
    filters = {"max_price": F.when(F.col("k") % 3 > 0, F.col("k") % 3 * 1000), "min_sqm": F.when(F.col("k") % 5 == 0, F.lit(50))}
    return parts(spark, sf_dir).select("k", pr.search_url("https://portal.example", case(["Milano", "La Maddalena"]), areas, filters).alias("url"))


QUERIES = {
    f.__name__: f
    for f in (portal_a_rentals, portal_a_sales, portal_b_rentals, portal_b_sales, valuation_inputs, condo_fees, addresses, poi_kinds, poi_counts, canonical_conditions, floors_in_prose, stored_rows, listing_aliases, union_keys, seen_backfill, search_urls)
}


def _a_sql(sale: bool) -> str:
    price = f"CASE {K} % 10 WHEN 3 THEN NULL WHEN 4 THEN 900 WHEN 5 THEN 40000 ELSE 150000 + {K} * 331 % 400000 END" if sale else f"CASE WHEN {K} % 10 <> 3 THEN 500 + {K} % 1500 END"
    rooms = f"coalesce({sql_case(ROOMS[1], 'INT')}, {sql_case(TITLE[1], 'INT')})"
    psqm = "CAST(round_even(CAST(CAST(price AS DOUBLE) / sqm AS DECIMAL(18,6)), 0) AS DOUBLE)" if sale else "CAST(round(CAST(CAST(price AS DOUBLE) / sqm AS DECIMAL(18,6)), 2) AS DOUBLE)"
    heat = f"coalesce({sql_case(HEAT[1])}, NULL)"
    fields = {
        "id": f"CAST({K} AS VARCHAR)", "source": "'sale'" if sale else "'portal_a'", "city": "'milano'", "title": sql_case(TITLE[0]), "neighbourhood": sql_case(PLACE[1]), "address": sql_case(["Via A, 3", "", ""]), "latitude": sql_case([45.45, None, None], "DOUBLE"), "longitude": sql_case([9.17, None, None], "DOUBLE"),
        "price" if sale else "rent_mo": "price", "ask_psqm": psqm, "sqm": "sqm", "spese_condominiali": sql_case(FEES[1], "INT"), "rooms": "rooms", "bedrooms": "CASE WHEN NOT coalesce(beds > rooms, FALSE) THEN beds END", "bathrooms": sql_case(BATHS[1], "INT"),
        "floor_n": sql_case(FLOOR[1], "INT"), "floor_label": sql_case(FLOOR[2]), "is_below_ground": f"coalesce({sql_case(FLOOR[1], 'INT')} < 0, FALSE)", "is_ground_floor": f"coalesce({sql_case(FLOOR[1], 'INT')} = 0, FALSE)", "elevator": sql_case(LIFT[1], "BOOLEAN"), "is_external": sql_case(OUTSIDE[1], "BOOLEAN"),
        "energy_class": "'G'", "year_built": "CAST(NULL AS INT)", "has_balcony": sql_case(BALCONY[1], "BOOLEAN"), "has_parking": sql_case(BALCONY[2], "BOOLEAN"), "heating_type": heat, "furnished": sql_case(FURNISHED[1], "BOOLEAN"), "photo_count": sql_case(PHOTOS[2], "INT"),
        "published_date": sql_case(DATES[1]), "days_on_market": sql_case(DATES[2], "INT"), "condition": sql_case(STATE[2 if sale else 1]), "thumbnail": sql_case(PHOTOS[3]), "photos": sql_case(PHOTOS[1]),
        "agency_id": sql_case(SELLER[1]), "agency_name": sql_case(SELLER[2]), "agency_type": sql_case(SELLER[3]), "agency_url": sql_case(SELLER[4]),
    } | ({"is_auction": "CAST(price AS DOUBLE) / sqm < 800"} if sale else {})
    low = "AND CAST(price AS DOUBLE) / sqm >= 100" if sale else ""
    return f"WITH x AS (SELECT {K}, CAST({price} AS INT) AS price, {sql_case(SURFACE[1], 'INT')} AS sqm, {rooms} AS rooms, {sql_case(BEDS[1], 'INT')} AS beds FROM part) SELECT {', '.join(f'{e} AS {n}' for n, e in fields.items())} FROM x WHERE price > 0 AND sqm > 0 {low}"


def _b_sql(sale: bool) -> str:
    psqm = "CAST(round_even(CAST(CAST(price AS DOUBLE) / sqm AS DECIMAL(18,6)), 0) AS DOUBLE)" if sale else "CAST(round(CAST(CAST(price AS DOUBLE) / sqm AS DECIMAL(18,6)), 2) AS DOUBLE)"
    fields = {
        "id": f"'id_' || {K}", "source": "'portal_b_sale'" if sale else "'portal_b'", "city": "'milano'", "title": sql_case(["Casa", "Bella casa"]), "address": sql_case(B_ADDRESS[0]), "url": sql_case(["https://portal-b.example/immobile/1", "https://x/1", ""]),
        "price" if sale else "rent_mo": "price", "sqm": "sqm", "ask_psqm": psqm, "rooms": sql_case(B_ROOMS[1], "INT"), "bedrooms": sql_case(B_ROOMS[2], "INT"), "bathrooms": sql_case(B_ROOMS[3], "INT"), "floor_n": sql_case(B_FLOORS[0], "INT"), "floor_label": sql_case(B_FLOORS[1]),
        "is_below_ground": f"{sql_case(B_FLOORS[0], 'INT')} < 0", "is_ground_floor": f"{sql_case(B_FLOORS[0], 'INT')} = 0", "elevator": sql_case(B_LIFT, "BOOLEAN"), "has_balcony": sql_case(B_BALCONY, "BOOLEAN"), "has_parking": sql_case(B_BOX, "BOOLEAN"), "furnished": sql_case(B_FURNISHED, "BOOLEAN"),
        "is_auction": sql_case(B_AUCTION, "BOOLEAN"), "is_nuda_proprieta": sql_case(B_BARE, "BOOLEAN"), "photos": sql_case(["i.jpg", "", ""]), "neighbourhood": sql_case(B_ADDRESS[1]),
    }
    return f"WITH x AS (SELECT {K}, {sql_case(B_PRICE[2 if sale else 1], 'INT')} AS price, {sql_case(B_SIZE[1], 'INT')} AS sqm FROM part WHERE {K} % 50 <> 0) SELECT {', '.join(f'{e} AS {n}' for n, e in fields.items())} FROM x WHERE price IS NOT NULL AND sqm IS NOT NULL"


_FEES = "[" + ", ".join(FEE_SQL) + f"][{K} % {len(FEE_SQL)} + 1]"
_POI = f"CASE WHEN {sql_case(KINDS)} = 'park' AND {K} % 5 <> 0 AND {K} % 3 = 0 THEN NULL ELSE {sql_case(KINDS)} END"
_ROWS = "id, 'rental' AS listing_type, CASE id % 3 WHEN 0 THEN 'la_maddalena' WHEN 1 THEN 'milano' ELSE 'roma' END AS city, rent_mo AS price, ask_psqm, ask_psqm AS ask_psqm_rent, sqm, CASE WHEN id % 6 <> 3 THEN condition END AS condition, spese_condominiali AS condominium_fees, id % 4 = 0 AS excluded"
ORACLE_SQL = {
    "portal_a_rentals": _a_sql(False),
    "portal_a_sales": _a_sql(True),
    "portal_b_rentals": _b_sql(False),
    "portal_b_sales": _b_sql(True),
    "valuation_inputs": f"""WITH a AS ({_a_sql(False)}), b AS ({_b_sql(False)}), u AS (SELECT 'a' AS portal, neighbourhood, floor_n, rent_mo, latitude, elevator FROM a UNION ALL SELECT 'b', neighbourhood, floor_n, rent_mo, NULL, elevator FROM b)
SELECT portal, neighbourhood, floor_n, count(*) AS n, CAST(sum(rent_mo) AS BIGINT) AS total, count(latitude) AS n_placed, count(*) FILTER (elevator) AS n_lift FROM u GROUP BY ALL""",
    "condo_fees": f"WITH x AS (SELECT {K}, CAST({K} * 7 % 1100 AS INT) AS f FROM part) SELECT {K} AS k, CAST({_FEES} AS INT) AS fee, CAST({_FEES} AS INT) AS later_fee FROM x",
    "addresses": f"SELECT {K} AS k, {sql_case(STREETS)} AS street, {sql_case(QUARTERS)} AS neighbourhood, {sql_case(FROM_TITLE)} AS from_title FROM part",
    "poi_kinds": f"SELECT {K} AS k, {_POI} AS kind, {sql_case(LINE_NAMES)} AS lines FROM part",
    "poi_counts": f"SELECT kind, count(*) AS n FROM (SELECT {_POI} AS kind FROM part) WHERE kind IS NOT NULL GROUP BY kind",
    "canonical_conditions": f"SELECT {K} AS k, {sql_case(CANONICAL)} AS condition FROM part",
    "floors_in_prose": f"SELECT {K} AS k, {sql_case(PROSE_FLOORS, 'INT')} AS floor_n, {sql_case(PROSE_LABELS)} AS floor_label FROM part",
    "stored_rows": f"WITH {SQL} SELECT {_ROWS} FROM listings",
    "listing_aliases": f"WITH {SQL} SELECT id, rent_mo, ask_psqm AS ask_psqm_rent, spese_condominiali FROM listings",
    "union_keys": f"WITH {SQL} SELECT id, CASE WHEN id % 2 = 0 THEN rent_mo END AS rent_mo, CASE WHEN id % 2 = 1 THEN sqm END AS sqm FROM listings",
    "seen_backfill": f"WITH {SQL}, s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1) SELECT id, CASE WHEN id % 2 = 0 THEN DATE '2001-02-03' ELSE f END AS first_seen_date, l AS last_seen_date FROM listings LEFT JOIN s ON id = o_custkey",
    "search_urls": f"SELECT {K} AS k, 'https://portal.example/' || {sql_case(['milano', 'la-maddalena'])} || CASE WHEN {K} % 2 = 0 THEN '/citta-studi,brera' ELSE '' END || '/' || {sql_case(['', '?max_price=1000', '?max_price=2000', '', '?max_price=1000', '?max_price=2000', '', '?max_price=1000', '?max_price=2000', '', '?max_price=1000', '?max_price=2000', '', '?max_price=1000', '?max_price=2000'])} || CASE WHEN {K} % 5 = 0 THEN CASE WHEN {K} % 3 = 0 THEN '?' ELSE '&' END || 'min_sqm=50' ELSE '' END AS url FROM part",
}
