"""Raw portal rows to listings, listings to stored rows and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark import settings as st
from estimark.functions import prose as pr
from estimark.functions import scalars as sc

_PARTY = "struct<id:string,displayName:string,name:string,type:string,label:string,url:string,profileUrl:string>"
_PROPERTY = (
    "struct<surface:string,surfaceValue:string,rooms:string,roomsNumber:string,numRooms:string,bathrooms:string,bedRoomsNumber:string,bedrooms:string,floor:string,"
    "elevator:string,hasElevator:string,isExternal:string,external:string,ga4Exposure:string,ga4Condition:string,condition:string,heatingType:string,heating:string,energyClass:string,yearBuilt:string,"
    "furnished:string,isFurnished:string,arredato:string,hasBalcony:string,balcony:string,hasTerrace:string,terrace:string,hasGarden:string,garden:string,hasParking:string,parking:string,garage:string,hasGarage:string,"
    "expenses:string,condominiumFees:string,monthlyCharges:string,description:string,features:array<struct<type:string,name:string,label:string>>,"
    "location:struct<microzone:string,macrozone:string,city:string,address:string,latitude:double,longitude:double>,"
    "multimedia:struct<photos:array<struct<urls:struct<large:string,medium:string,small:string>,url:string,src:string>>>>"
)
#: Shape of portal A's search items. Fields that come in several types are read as texts.
PORTAL_A = (
    f"struct<realEstate:struct<id:string,title:string,contract:string,price:struct<value:string>,typology:struct<name:string>,energyClass:string,yearBuilt:string,furnished:string,"
    f"features:array<struct<type:string,name:string,label:string>>,advertiser:struct<agency:{_PARTY},private:{_PARTY},supervisor:{_PARTY}>,"
    f"publicationDate:string,insertionDate:string,createdAt:string,properties:array<{_PROPERTY}>>>"
)
# Fixed values that results depend on.
FEATURE_WORDS = ["balcon", "terrazza", "giardino", "box", "garage", "parcheggio", "arredato", "autonomo", "centralizzato"]
OUTDOOR = ["balcony", "terrace", "garden", "terr", "balcon", "terrazza", "giardino"]
PARKING = ["parking", "garage", "box", "parcheggio"]
LEAST_SALE_PSQM = 100
RENAMED = {
    "_room_efficiency_flag": "room_efficiency_flag", "_absolute_value_gate_applied": "absolute_value_gate_applied", "_excluded": "excluded", "_excluded_reason": "excluded_reason",
    "_price_floor_gate_applied": "price_floor_gate_applied", "_price_floor_reason": "price_floor_reason", "_extreme_underpricing": "extreme_underpricing",
    "_extreme_underpricing_delta": "extreme_underpricing_delta", "spese_condominiali": "condominium_fees",
}


def filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[filled(c) for c in columns])


def within(text: Column, path: str) -> Column:
    """What lies at the path of a text that is a JSON object. Other texts, the most, aren't parsed,
    as each would raise an error within Spark."""
    return F.when(text.contains("{"), F.get_json_object(text, path))


def photo_urls(photos: Column, most: int = 8) -> Column:
    """Addresses of the first photos, the largest size of each; photos without one are left out."""
    url = lambda p: first_of(p["urls"]["large"], p["urls"]["medium"], p["urls"]["small"], p["url"], p["src"])
    return F.coalesce(F.array_compact(F.transform(F.slice(photos, 1, most), url)), F.array().cast("array<string>"))


def advertiser(party: Column) -> list[Column]:
    """Agency, else private seller, else supervisor: id, name, type and address."""
    who = F.coalesce(party["agency"], party["private"], party["supervisor"])
    text = lambda *names: F.coalesce(first_of(*[who[n] for n in names]), F.lit(""))
    return [text("id").alias("agency_id"), text("displayName", "name").alias("agency_name"), text("type", "label").alias("agency_type"), text("url", "profileUrl").alias("agency_url")]


def feature_set(features: Column) -> Column:
    """Types of features and the known words in their labels, lower-cased and distinct."""
    types = F.transform(features, lambda f: F.lower(F.coalesce(first_of(f["type"], f["name"]), F.lit(""))))
    labels = F.array_join(F.transform(features, lambda f: F.lower(F.coalesce(f["label"], F.lit("")))), "\n")
    words = F.array_compact(F.array(*[F.when(labels.contains(w), w) for w in FEATURE_WORDS]))
    return F.coalesce(F.array_distinct(F.concat(types, words)), F.array().cast("array<string>"))


def any_yes(*raws: Column) -> Column:
    """True if any says yes, false if the known ones all say no, else null."""
    yes = reduce(lambda a, b: a | b, [F.coalesce(pr.truth(r), F.lit(False)) for r in raws])
    return F.when(yes, True).when(F.coalesce(*raws).isNotNull(), False)


def among(features: Column, words: list[str]) -> Column:
    """Whether the features hold a word; unknown without features."""
    return F.when(F.size(features) > 0, F.arrays_overlap(features, F.array(*[F.lit(w) for w in words])))


def digits(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(raw, r"[^\d]", ""), F.lit("")).try_cast("int")


def heating(raw: Column, features: Column) -> Column:
    """autonomous, centralised or unknown from the text; without a text from the features."""
    h, has = F.lower(raw), lambda w: F.array_contains(features, w)
    return (
        F.when(sc.any_of(h, ["autonom", "individual", "indipendent"]), "autonomous").when(sc.any_of(h, ["central", "condominil"]), "centralised").when(filled(h).isNotNull(), "unknown")
        .when(has("autonomo"), "autonomous").when(has("centralizzato"), "centralised")
    )


def portal_a(raw: DataFrame, body: str, city: str, today: Column, sale: bool = False) -> DataFrame:
    """Listings from portal A's JSON items in the column ``body``. Items without a positive price
    and surface are left out, and so are sales under 100 euros a square metre, which are rents;
    sales under the city's least price are taken for auctions. A boolean false and the text
    "false" are the same."""
    item = F.from_json(body, PORTAL_A)["realEstate"]
    # Spark takes names that differ in case alone for the same, so this one has a column of its own
    baths = F.get_json_object(body, "$.realEstate.properties[0].bathRooms")
    # behind a generator, so that the parsed item isn't put in for each of its fields and parsed anew
    parsed = raw.select(F.explode(F.array(F.struct(item.alias("r"), baths.alias("other_baths")))).alias("x")).select("x.r", "x.other_baths")
    df = parsed.withColumns({"p": F.try_element_at("r.properties", F.lit(1)), "price": F.col("r.price.value").try_cast("int")})
    df = df.withColumn("sqm", digits(first_of(F.col("p.surface"), F.col("p.surfaceValue")))).where("price > 0 AND sqm > 0")
    c = F.col
    psqm = c("price") / c("sqm")
    features = feature_set(F.when(F.size("p.features") > 0, c("p.features")).otherwise(c("r.features")))
    if sale:
        df = df.where(psqm >= LEAST_SALE_PSQM)
    zone = lambda x: F.coalesce(within(x, "$.name"), F.trim(x))
    df = df.withColumns({
        "features": features, "photos": photo_urls(c("p.multimedia.photos")), "date": pr.published(c("r.publicationDate"), c("r.insertionDate"), c("r.createdAt")),
        "floor_raw": F.coalesce(filled(within(c("p.floor"), "$.abbreviation")), filled(within(c("p.floor"), "$.value")), c("p.floor")),
        "microzone": zone(c("p.location.microzone")), "macrozone": zone(c("p.location.macrozone")),
    })
    floor, label = sc.parse_floor(c("floor_raw"))
    df = df.withColumns({"floor": floor, "floor_label": label})
    floor, date = c("floor"), c("date")
    rooms = F.coalesce(first_of(c("p.rooms"), c("p.roomsNumber"), c("p.numRooms")).try_cast("int"), sc.parse_rooms(c("r.title")))
    beds = F.nullif(first_of(c("p.bedRoomsNumber"), c("p.bedrooms")).try_cast("int"), F.lit(0))
    outside = pr.either(c("p.isExternal"), c("p.external"), c("p.ga4Exposure"))
    furnished = pr.either(c("p.furnished"), c("p.isFurnished"), c("p.arredato"), c("r.furnished"))
    money = [c("price").alias("price" if sale else "rent_mo"), F.when(F.lit(sale), sc.half_even(psqm).cast("double")).otherwise(sc.exactly(psqm, 2)).alias("ask_psqm")]
    fee = F.coalesce(digits(first_of(c("p.expenses"), c("p.condominiumFees"), c("p.monthlyCharges"))), pr.condo_fee(c("p.description")))
    out = df.select(
        F.coalesce("r.id", F.lit("")).alias("id"), F.lit("sale" if sale else "portal_a").alias("source"), F.lit(city).alias("city"), F.coalesce("r.title", F.lit("")).alias("title"),
        F.coalesce(filled(c("microzone")), filled(c("macrozone")), c("p.location.city"), F.lit("")).alias("neighbourhood"), F.coalesce("p.location.address", F.lit("")).alias("address"),
        c("p.location.latitude").alias("latitude"), c("p.location.longitude").alias("longitude"), *money, "sqm", fee.alias("spese_condominiali"), rooms.alias("rooms"), F.when(~F.coalesce(beds > rooms, F.lit(False)), beds).alias("bedrooms"),
        first_of(c("p.bathrooms"), c("other_baths")).try_cast("int").alias("bathrooms"), floor.alias("floor_n"), "floor_label", F.coalesce(floor < 0, F.lit(False)).alias("is_below_ground"), F.coalesce(floor == 0, F.lit(False)).alias("is_ground_floor"),
        pr.truth(pr.either(c("p.elevator"), c("p.hasElevator"))).alias("elevator"), F.when(outside.isNotNull(), F.lower(outside).isin("true", "yes", "esterno", "1")).alias("is_external"),
        F.upper(F.trim(first_of(c("p.energyClass"), c("r.energyClass")))).alias("energy_class"), first_of(c("p.yearBuilt"), c("r.yearBuilt")).try_cast("int").alias("year_built"),
        F.coalesce(any_yes(*[c(f"p.{x}") for x in ("hasBalcony", "balcony", "hasTerrace", "terrace", "hasGarden", "garden")]), among(c("features"), OUTDOOR)).alias("has_balcony"),
        F.coalesce(any_yes(*[c(f"p.{x}") for x in ("hasParking", "parking", "garage", "hasGarage")]), among(c("features"), PARKING)).alias("has_parking"),
        heating(first_of(c("p.heatingType"), c("p.heating")), c("features")).alias("heating_type"),
        F.coalesce(F.when(furnished.isNotNull(), F.lower(furnished).isin("true", "yes", "arredato", "1", "si", "sì")), F.when(F.array_contains("features", "arredato"), True)).alias("furnished"),
        F.coalesce(F.size(F.nullif(c("p.multimedia.photos"), F.array())), F.lit(0)).alias("photo_count"), date.alias("published_date"), F.date_diff(today, date).alias("days_on_market"),
        pr.canonical_condition(F.coalesce(first_of(c("p.ga4Condition"), c("p.condition"), c("r.typology.name")), F.lit(""))).alias("condition") if sale else F.coalesce(first_of(c("p.ga4Condition"), c("p.condition"), c("r.typology.name")), F.lit("")).alias("condition"),
        F.try_element_at("photos", F.lit(1)).alias("thumbnail"), "photos", *advertiser(c("r.advertiser")),
    )
    if sale:
        least = sc.lookup(F.lit(city), st.MIN_SALE_PSQM, st.DEFAULT_MIN_SALE_PSQM)
        out = out.withColumn("is_auction", F.coalesce(c("price") / c("sqm") < least, F.lit(False)))
    return out


def portal_b(raw: DataFrame, city: str, city_names: list[str], auction_or_bare, synonyms: dict[str, str], sale: bool = False) -> DataFrame:
    """Listings from portal B's text rows (id, title, price_text, size_text, rooms_text,
    floor_text, address, description, url, img, tags, photos). Rows without an id, a price in
    range and a surface are left out. What a text doesn't confirm is unknown."""
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit(""))
    tags = F.coalesce(c("tags"), F.array().cast("array<string>"))
    price = sc.digits_within(text("price_text"), *((10_000, 15_000_000) if sale else (100, 50_000))).cast("int")
    df = raw.withColumns({"price": price, "sqm": pr.surface(text("size_text"))}).where((F.trim(text("id")) != "") & c("price").isNotNull() & c("sqm").isNotNull())
    rooms, beds, baths = pr.rooms_beds_baths(text("rooms_text"), text("floor_text"), text("size_text"), F.substring(text("description"), 1, 300), F.array_join(tags, " "))
    chip, chip_label = sc.parse_floor(F.trim(F.regexp_replace(text("floor_text"), r"(?i)\s+(?:con|senza)\s+ascensore.*", "")))
    said, said_label = pr.floor_in_prose(F.concat_ws(" ", text("title"), text("description")))
    everything = F.lower(F.concat_ws(" ", F.array_join(tags, " "), text("description"), text("floor_text")))
    seen = lambda words: F.when(sc.any_of(everything, words), True)
    auction, bare = auction_or_bare(F.concat_ws(" ", text("title"), text("description"), F.array_join(tags, " ")))
    place = pr.neighbourhood(text("address"), city_names)
    psqm = c("price") / c("sqm")
    floor = F.coalesce(chip, said)
    return df.select(
        F.concat(F.lit("id_"), F.trim("id")).alias("id"), F.lit("portal_b_sale" if sale else "portal_b").alias("source"), F.lit(city).alias("city"), F.trim(text("title")).alias("title"),
        (sc.lookup(place, synonyms, None) if synonyms else F.lit(None)).alias("canonical"), place.alias("place"), F.trim(text("address")).alias("address"),
        F.when(text("url").startswith("/"), F.concat(F.lit("https://"), F.lit("portal-b.example"), c("url"))).otherwise(text("url")).alias("url"),
        c("price").alias("price" if sale else "rent_mo"), "sqm", F.when(F.lit(sale), sc.half_even(psqm).cast("double")).otherwise(sc.exactly(psqm, 2)).alias("ask_psqm"),
        rooms.alias("rooms"), beds.alias("bedrooms"), baths.alias("bathrooms"), floor.alias("floor_n"), F.when(chip.isNotNull(), chip_label).otherwise(said_label).alias("floor_label"),
        F.coalesce(floor < 0, F.lit(False)).alias("is_below_ground"), F.coalesce(floor == 0, F.lit(False)).alias("is_ground_floor"),
        seen(["ascensor", "lift", "elevator"]).alias("elevator"), seen(["balcon", "terrazza", "giardino"]).alias("has_balcony"), seen(["box", "garage", "parcheggio", "posto auto"]).alias("has_parking"), seen(["arredat", "furnished"]).alias("furnished"),
        F.coalesce(auction, F.lit(False)).alias("is_auction"), F.coalesce(bare, F.lit(False)).alias("is_nuda_proprieta"), F.when(F.size(F.coalesce(c("photos"), F.array().cast("array<string>"))) > 0, c("photos")).when(filled(c("img")).isNotNull(), F.array("img")).alias("photos"),
    ).withColumn("neighbourhood", F.coalesce("canonical", "place")).drop("canonical", "place")


def valuation_input(listing: DataFrame) -> DataFrame:
    """What a valuation asks of a listing from either portal: place, size, state and price."""
    have, c = set(listing.columns), F.col
    pick = lambda name, *others, kind: F.coalesce(*[c(x) for x in (name, *others) if x in have], F.lit(None)).cast(kind).alias(name)
    return listing.select(
        pick("address", kind="string"), pick("neighbourhood", kind="string"), pick("latitude", kind="double"), pick("longitude", kind="double"), pick("sqm", kind="int"), pick("rooms", kind="int"), pick("bathrooms", kind="int"), pick("floor_n", kind="int"),
        pick("elevator", kind="boolean"), pick("condition", kind="string"), pick("energy_class", kind="string"), pick("year_built", kind="int"), pick("price", "rent_mo", kind="int"),
    )


def to_row(listings: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Stored rows: renamed, cut to the known columns, empty texts null, the city's code for its
    label, and for rentals the rent as the price."""
    df = listings.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in listings.columns})
    types, c = dict(df.dtypes), F.col
    empty = {n: filled(F.trim(c(n))) if t == "string" else F.when(F.size(c(n)) > 0, c(n)) for n, t in types.items() if t == "string" or t.startswith("array")}
    df = df.withColumns({n: F.when(x.isNotNull(), c(n)) for n, x in empty.items()})
    if "city" in types:
        code = F.regexp_replace(F.lower("city"), " ", "_")
        label = (c("city") != F.lower("city")) | c("city").contains(" ")
        df = df.withColumn("city", F.when(label, F.coalesce(c("city_key"), code) if "city_key" in types else code).otherwise(c("city")))
    if kind == "rental":
        known = lambda *names: F.coalesce(*[c(n) for n in names if n in types], F.lit(None))
        df = df.withColumns({"price": known("price", "rent_mo"), "ask_psqm_rent": known("ask_psqm_rent", "ask_psqm")})
    return df.select(F.lit(kind).alias("listing_type"), *[n for n in columns if n in df.columns and n != "listing_type"])


def from_row(rows: DataFrame, kind: str) -> DataFrame:
    """Listings from stored rows: old names beside the stored ones, where they have no value."""
    aliases = {"spese_condominiali": "condominium_fees", "_room_efficiency_flag": "room_efficiency_flag", "_absolute_value_gate_applied": "absolute_value_gate_applied"}
    aliases |= {"rent_mo": "price", "ask_psqm_rent": "ask_psqm"} if kind == "rental" else {}
    have = set(rows.columns)
    return rows.withColumns({a: F.coalesce(F.col(a), F.col(b)) if a in have else F.col(b) for a, b in aliases.items() if b in have})


def union_of_keys(*batches: DataFrame) -> DataFrame:
    """One table of rows with different columns; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def backfill_seen(listings: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """First and last seen dates of ``seen`` where listings have none."""
    dates = seen.select(key, F.col("first_seen_date").alias("__first"), F.col("last_seen_date").alias("__last"))
    joined = listings.join(dates, key, "left").withColumns({"first_seen_date": F.coalesce("first_seen_date", "__first"), "last_seen_date": F.coalesce("last_seen_date", "__last")})
    return joined.select(listings.columns)
