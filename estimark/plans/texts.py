"""Queries on texts: flags, parsers, nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import flags
from estimark.plans.listings import SQL, listings


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


BAIT, SEA = ["ationin", "verber", "license", "sueci"], ["aiment", "thinsh"]


def city():
    return F.when(F.col("lang") == "es", "napoli").when(F.col("lang") == "de", "Roma")


def fake_flags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", flags.bait(F.col("text"), F.col("text"), city(), BAIT, SEA).alias("is_fake"))


def fixed_word_flags(spark, sf_dir):
    """The fixed word lists, over whole texts."""
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", flags.bait(F.lit(""), text, city()).alias("is_fake"), flags.corporate(F.col("doc_id").cast("string"), text, ["7", "19"]).alias("is_corporate"), flags.signals(text).alias("has_signals"))


def corporate_signals(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", flags.signals(F.col("text"), ["thea", "ation", "über", "leaux", "ciones", "the the"], 2).alias("has_signals"))


def auction_regex(spark, sf_dir):
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, " vendita giudiziaria").when(F.col("doc_id") % 7 == 1, " Guastalla, ascensore").when(F.col("doc_id") % 7 == 2, " In ASTA").when(F.col("doc_id") % 7 == 3, " nuda proprietà").otherwise(""))
    auction, bare = flags.auction_or_bare(text)
    return docs(spark, sf_dir).select("doc_id", auction.alias("is_auction"), bare.alias("is_nuda"))


def misrep_distance(spark, sf_dir):
    k = F.col("doc_id") % 9
    text = F.concat(F.when(k == 0, "Bilocale a 8 km da Milano ").when(k == 1, "A soli 2 km da Milano ").when(k == 2, "Ad Opera proponiamo ").when(k == 3, "Villa a Rho (MI) ").otherwise(""), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", flags.misplaced(text, ["opera", "rho", "segrate"]).alias("reason"))


FLOORS = ["S, 3", "4 - 5", "T, R", "S2", "I", "PR", "12", "-1", "N/A", "", "piano 3", "Piano terra", "r", "attico"]
BETWEEN = [", ", " - ", " – ", " "]


def parse_floor(spark, sf_dir):
    """Floor texts of one or two parts, in each pairing of forms that the keys give."""
    k, pick = F.col("id"), lambda n: F.element_at(F.array(*[F.lit(x) for x in FLOORS]), (n % len(FLOORS) + 1).cast("int"))
    raw = F.concat(pick(k), F.when(k % 5 < 4, F.concat(F.element_at(F.array(*[F.lit(x) for x in BETWEEN]), (k % 5 + 1).cast("int")), pick(F.expr("id * 5 DIV 14")))).otherwise(""))
    df = listings(spark, sf_dir).select("id", raw.alias("raw"))
    floor, label = sc.parse_floor(F.col("raw"))
    return df.select("id", "raw", floor.alias("floor_n"), label.alias("floor_label"))


def parse_amounts(spark, sf_dir):
    k = F.col("p_partkey")
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.concat(F.lit("€ "), (k * 7 % 90).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" /mese")).alias("price"), F.concat((k % 7).cast("string"), F.lit(" locali")).alias("rooms"))
    return df.select("id", sc.digits_within(F.col("price"), 100, 50_000).alias("rent"), sc.digits_within(F.col("price"), 10_000, 15_000_000).alias("sale"), sc.parse_rooms(F.when(F.col("id") % 5 == 0, "Ampio trilocale").otherwise(F.col("rooms"))).alias("rooms"))


def slugs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", sc.slug(F.col("text")).alias("slug"))


def json_flatten(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k int")["k"]
    return ev.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def feature_arrays(spark, sf_dir):
    """Words of events' types that are among wanted features."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    words = F.array_distinct(F.concat(F.array("event_type"), F.split("event_type", "[^a-z]+")))
    return ev.select("event_id", F.arrays_overlap(words, F.array(*[F.lit(x) for x in ("click", "purchase")])).alias("wanted"), F.size(F.array_except(words, F.array(F.lit("click")))).cast("int").alias("n_other"))


def unmatched_counts(spark, sf_dir):
    return docs(spark, sf_dir).select(F.lower(F.substring_index("text", " ", 1)).alias("name")).where(~sc.any_of(F.col("name"), ["th", "de"])).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def distinct_zones(spark, sf_dir):
    return listings(spark, sf_dir).select("city", "zone").distinct()


QUERIES = {f.__name__: f for f in (fake_flags, fixed_word_flags, corporate_signals, auction_regex, misrep_distance, parse_floor, parse_amounts, slugs, json_flatten, feature_arrays, unmatched_counts, distinct_zones)}


def _quoted(pattern: str) -> str:
    """The pattern for DuckDB, whose word boundaries know ASCII letters alone."""
    return pattern.replace(r"\basta\b|\baste\b", r"(?:^|[^\pL\pN_])ast[ae](?:[^\pL\pN_]|$)").replace("'", "''")


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


_SHOUT = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 4 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2 AND upper(w) = w AND lower(w) <> w)) * 2 > len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2))"
_PICK = lambda n: f"[{', '.join(repr(x) for x in FLOORS)}][CAST({n} % {len(FLOORS)} AS INT) + 1]"
_CODES = ", ".join(f"({k!r}, {v})" for k, v in sc.FLOOR_CODES.items())
_MOVED = lambda towns: "CASE " + " ".join(f"WHEN {_any('t', [f'{x} (mi)', f'{x} (rm)', f'{x} (na)', f'{x}(mi)', f'{x}, mi', f'{x}, rm', f'{x}, na'])} THEN 'province:{x}'" for x in towns) + " WHEN km >= 3 THEN 'distance:' || km " + " ".join(f"WHEN contains(h, ' {x} ') OR starts_with(h, '{x} ') THEN 'opening:{x}'" for x in towns) + " END"
ORACLE_SQL = {
    "fake_flags": f"SELECT doc_id, {_any('t', BAIT)} OR (lang <> 'es' AND {_any('t', SEA)}) OR coalesce({_SHOUT}, FALSE) AS is_fake FROM (SELECT *, lower(text || ' ' || substr(text, 1, 1000)) AS t FROM documents)",
    "fixed_word_flags": f"SELECT doc_id, {_any('t', flags.FOREIGN)} OR (lang <> 'es' AND {_any('t', flags.SEASIDE)}) AS is_fake, {_any('l', flags.AGENCIES)} OR doc_id IN (7, 19) AS is_corporate, {' + '.join(_any('l', [x]) + '::INT' for x in flags.SIGNALS)} >= 2 AS has_signals FROM (SELECT *, lower(' ' || substr(text, 1, 1000)) AS t, lower(text) AS l FROM documents)",
    "corporate_signals": "SELECT doc_id, " + " + ".join(_any("lower(text)", [x]) + "::INT" for x in ["thea", "ation", "über", "leaux", "ciones", "the the"]) + " >= 2 AS has_signals FROM documents",
    "auction_regex": f"SELECT doc_id, regexp_matches(t, '{_quoted(flags.AUCTION)}') AS is_auction, regexp_matches(t, '{_quoted(flags.BARE_OWNERSHIP)}') AS is_nuda FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' vendita giudiziaria' WHEN 1 THEN ' Guastalla, ascensore' WHEN 2 THEN ' In ASTA' WHEN 3 THEN ' nuda proprietà' ELSE '' END AS t FROM documents)",
    "misrep_distance": f"""WITH x AS (SELECT doc_id, lower(substr(CASE doc_id % 9 WHEN 0 THEN 'Bilocale a 8 km da Milano ' WHEN 1 THEN 'A soli 2 km da Milano ' WHEN 2 THEN 'Ad Opera proponiamo ' WHEN 3 THEN 'Villa a Rho (MI) ' ELSE '' END || text, 1, 1500)) AS t FROM documents),
y AS (SELECT doc_id, t, substr(t, 1, 300) AS h, TRY_CAST(nullif(regexp_extract(t, '{flags.DISTANCE.replace("'", "''")}', 1), '') AS INT) AS km FROM x) SELECT doc_id, {_MOVED(["opera", "rho", "segrate"])} AS reason FROM y""",
    "parse_floor": f"""WITH {SQL}, c(code, floor) AS (VALUES {_CODES}), m AS (SELECT map_from_entries(list((code, floor))) AS codes FROM c),
x AS (SELECT id, {_PICK('id')} || CASE WHEN id % 5 < 4 THEN [', ', ' - ', ' – ', ' '][CAST(id % 5 + 1 AS INT)] || {_PICK('(id * 5 // 14)')} ELSE '' END AS raw FROM listings),
y AS (SELECT id, raw, list_filter(list_transform(string_split_regex(raw, ',\\s*|\\s+[-–]\\s+'), lambda t: upper(trim(t))), lambda t: t <> '') AS tokens FROM x),
z AS (SELECT id, raw, tokens, CASE WHEN upper(trim(raw)) NOT IN ('', 'NONE', 'N/A') THEN list_min(list_transform(tokens, lambda t: coalesce(codes[t], TRY_CAST(nullif(regexp_extract(t, '-?\\d+'), '') AS INT)))) END AS floor_n FROM y CROSS JOIN m)
SELECT id, raw, CAST(floor_n AS INT) AS floor_n, CASE WHEN floor_n <= -2 THEN 'Interrato' WHEN floor_n = -1 THEN 'Seminterrato' WHEN floor_n = 0 THEN 'Piano terra' WHEN floor_n = 1 AND list_has_any(tokens, ['R', 'RIALZATO', 'PR', 'PIANO RIALZATO']) THEN 'Piano rialzato' ELSE floor_n || '° piano' END AS floor_label FROM z""",
    "parse_amounts": """WITH x AS (SELECT p_partkey AS id, (p_partkey * 7 % 90) * 1000 + p_partkey % 1000 AS v FROM part)
SELECT id, CASE WHEN v BETWEEN 100 AND 50000 THEN v END AS rent, CASE WHEN v BETWEEN 10000 AND 15000000 THEN v END AS sale, CAST(CASE WHEN id % 5 = 0 THEN 3 ELSE id % 7 END AS INT) AS rooms FROM x""",
    "slugs": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents",
    "json_flatten": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type",
    "feature_arrays": "SELECT event_id, event_type IN ('click', 'purchase') OR list_has_any(string_split_regex(event_type, '[^a-z]+'), ['click', 'purchase']) AS wanted, CAST(len(list_filter(list_distinct(list_concat([event_type], string_split_regex(event_type, '[^a-z]+'))), lambda w: w <> 'click')) AS INT) AS n_other FROM events",
    "unmatched_counts": "WITH x AS (SELECT lower(string_split(text, ' ')[1]) AS name FROM documents) SELECT name, count(*) AS n FROM x WHERE NOT contains(name, 'th') AND NOT contains(name, 'de') GROUP BY name ORDER BY n DESC, name",
    "distinct_zones": f"WITH {SQL} SELECT DISTINCT city, zone FROM listings",
}
