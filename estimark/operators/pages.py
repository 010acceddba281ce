"""Raw pages: their elements, the JSON embedded in them, and what listings and detail pages are
made of. JSON is read as variants, by path, so fields may come in any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark.functions import scalars as sc


def inner(html: Column, tag: str) -> Column:
    """What stands within each element of the tag, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def attribute(tag_text: Column, name: str) -> Column:
    """An attribute's value within the text of a tag; null without it."""
    quoted = F.regexp_extract(tag_text, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(F.regexp_extract(tag_text, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""", 1), F.lit("")))


#: Entities of symbols in running text, and all that ``plain`` knows; the ampersand comes last, so
#: that none is made of another.
SYMBOLS = (("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), *SYMBOLS)


def plain(html: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """The text of some HTML: without elements that aren't shown, tags and comments; ``entities``
    as characters, white space as single blanks."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, letter in entities:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parts(html: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> list[Column]:
    """A page's language, title, first heading, and the numbers of its paragraphs and links."""
    return [
        attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang").alias("page_lang"),
        F.nullif(plain(F.coalesce(F.get(inner(html, "title"), F.lit(0)), F.lit("")), entities), F.lit("")).alias("title"),
        F.nullif(plain(F.coalesce(F.get(inner(html, "h1"), F.lit(0)), F.lit("")), entities), F.lit("")).alias("heading"),
        F.regexp_count(html, F.lit(r"(?i)<p\b")).alias("n_paragraphs"), F.regexp_count(html, F.lit(r"(?i)<a\b")).alias("n_links"),
    ]


def links(pages: DataFrame, html: str, keep: list[str], entities: tuple[tuple[str, str], ...] = ENTITIES) -> DataFrame:
    """(keep, place, href, label) of each link."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b([^>]*)>.*?</a\s*>"), F.lit(1))
    both = F.arrays_zip(tags.alias("tag"), inner(F.col(html), "a").alias("label"))
    return pages.select(*keep, F.posexplode(both).alias("place", "a")).select(*keep, "place", attribute(F.col("a.tag"), "href").alias("href"), plain(F.col("a.label"), entities).alias("label"))


def scripts(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(keep, place, kind, name, body) of each script element: its type, its id, and what it holds."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script\b([^>]*)>.*?</script\s*>"), F.lit(1))
    both = F.arrays_zip(tags.alias("tag"), inner(F.col(html), "script").alias("body"))
    found = pages.select(*keep, F.posexplode(both).alias("place", "s"))
    return found.select(*keep, "place", F.lower(attribute(F.col("s.tag"), "type")).alias("kind"), attribute(F.col("s.tag"), "id").alias("name"), F.col("s.body").alias("body"))


def at(value: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def item_list(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row an item of the JSON-LD lists in pages, as portal B's text rows: id (the end of the
    address), url, title, price_text, address, description, img, latitude, longitude. Texts that
    are no JSON, and lists without items, give no rows."""
    found = scripts(pages, html, keep).where("kind = 'application/ld+json'").select(*keep, "place", F.try_parse_json("body").alias("ld"))
    items = found.select(*keep, F.posexplode(at("ld", "$.itemListElement", "array<variant>")).alias("item_no", "item"))
    thing = items.withColumn("thing", F.coalesce(at("item", "$.item", "variant"), F.col("item")))
    text = lambda path: F.coalesce(at("thing", path), F.lit(""))
    price = F.coalesce(*[F.when(~F.coalesce(x, F.lit("")).isin("", "0", "0.0", "false"), x) for x in (at("thing", "$.offers.price"), at("thing", "$.price"))], F.lit(""))
    # an address is a text, or an object whose street counts
    address = F.when(at("thing", "$.address", "map<string,variant>").isNotNull(), text("$.address.streetAddress")).otherwise(text("$.address"))
    last = F.element_at(F.split(F.regexp_replace(text("$.url"), "/+$", ""), "/"), -1)
    return thing.select(
        *keep, "item_no", last.alias("id"), text("$.url").alias("url"), text("$.name").alias("title"), price.alias("price_text"), address.alias("address"),
        text("$.description").alias("description"), text("$.image").alias("img"), text("$.geo.latitude").alias("latitude"), text("$.geo.longitude").alias("longitude"),
    )


def whole(text: Column) -> Column:
    """The number before the first blank, without decimals."""
    return F.get(F.split(text, " "), F.lit(0)).try_cast("double").cast("int")


def flag(*values: Column) -> Column:
    """The first value that says something, as true or false."""
    said = [F.when(~F.lower(F.trim(v)).isin("", "null"), ~F.lower(F.trim(v)).isin("false", "no", "0")) for v in values]
    return F.coalesce(*said)


def details_a(pages: DataFrame, html: str, name: str, path: str, keep: list[str]) -> DataFrame:
    """A valuation's columns from portal A's detail pages: the script element of the id ``name``
    holds JSON, the listing lies at ``path`` in it."""
    found = scripts(pages, html, keep).where(F.col("name") == name).withColumn("estate", at(F.try_parse_json("body"), path, "variant")).where("estate IS NOT NULL")
    prop = F.try_variant_get("estate", "$.properties[0]", "variant")
    df = found.withColumn("prop", F.coalesce(prop, F.parse_json(F.lit("{}"))))
    p, e = (lambda path: at("prop", path)), (lambda path: at("estate", path))
    features = F.coalesce(at("prop", "$.features", "array<variant>"), at("estate", "$.features", "array<variant>"), F.array().cast("array<variant>"))
    df = df.withColumn("features", F.transform(features, lambda f: F.struct(F.lower(F.coalesce(F.nullif(F.try_variant_get(f, "$.type", "string"), F.lit("")), F.try_variant_get(f, "$.name", "string"), F.lit(""))).alias("type"), F.lower(F.coalesce(F.try_variant_get(f, "$.label", "string"), F.lit(""))).alias("label"))))
    types, labels = F.transform("features", lambda f: f["type"]), F.array_join(F.transform("features", lambda f: f["label"]), " ")
    has = lambda *words: F.when(F.arrays_overlap(types, F.array(*[F.lit(w) for w in words])) | sc.any_of(labels, list(words)), True)
    some = lambda *columns: F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
    condition = F.coalesce(at("prop", "$.condition.value"), F.when(at("prop", "$.condition", "map<string,variant>").isNull(), p("$.condition")))
    return df.select(
        *keep, F.lit("portal_a").alias("source"), some(p("$.location.address")).alias("address"), at("prop", "$.location.latitude", "double").alias("latitude"), at("prop", "$.location.longitude", "double").alias("longitude"),
        whole(some(p("$.surface"), p("$.surfaceValue"))).alias("sqm"), whole(e("$.price.value")).alias("price"), whole(p("$.rooms")).alias("rooms"),
        whole(some(p("$.floor.value"), p("$.floor.abbreviation"))).alias("floor_n"), some(p("$.floor.abbreviation")).alias("floor_label"), F.lower(F.trim(some(p("$.ga4Condition"), condition, e("$.typology.name")))).alias("condition"),
        flag(p("$.elevator"), p("$.hasElevator")).alias("elevator"),
        F.coalesce(flag(*[p(f"$.{n}") for n in ("hasBalcony", "balcony", "hasTerrace", "terrace", "hasGarden", "garden")]), has("balcony", "terrace", "garden", "balcon", "terrazza", "giardino")).alias("has_balcony"),
        F.coalesce(flag(*[p(f"$.{n}") for n in ("hasParking", "parking", "hasGarage", "garage", "hasBox", "box")]), has("parking", "garage", "box", "parcheggio", "posto auto")).alias("has_parking"),
        F.coalesce(flag(p("$.furnished"), p("$.isFurnished"), p("$.arredato"), e("$.furnished")), has("arredato", "furnished")).alias("furnished"),
    )


def details_b(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The same columns from the texts of portal B's detail pages (address_text, size_text,
    price_text, rooms_text, floor_text, condition_text): of each text the first number."""
    number = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), "[.,]", ""), r"(\d+)", 1), F.lit("")).try_cast("int")
    text = lambda c: F.coalesce(c, F.lit(""))
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (("elevator", "boolean"), ("has_balcony", "boolean"), ("has_parking", "boolean"), ("furnished", "boolean"))]
    return texts.select(
        *keep, F.lit("portal_b").alias("source"), text(F.col("address_text")).alias("address"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        *[number(F.col(f"{a}_text")).alias(b) for a, b in (("size", "sqm"), ("price", "price"), ("rooms", "rooms"), ("floor", "floor_n"))], text(F.col("floor_text")).alias("floor_label"), F.lower(text(F.col("condition_text"))).alias("condition"), *unknown,
    )
