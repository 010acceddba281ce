"""Lookups in small tables: keywords, synonyms, prefixes, first of several."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estimark.operators import ranks


#: Keywords, and characters of them, up to which each task gets them all in one automaton.
SMALL_TABLE = (50_000, 2_000_000)


def in_texts(texts: DataFrame, keywords: DataFrame, small: tuple[int, int] = SMALL_TABLE) -> DataFrame:
    """(text, ord, zone) for each text (column ``text``, in lower case, distinct): the longest keyword
    that it contains, ties to the smallest ord. keywords: keyword, ord, zone.

    A table of checked size goes to every task as an automaton that finds all keywords in one pass
    over a text. A larger one becomes an inverted index: each keyword is listed under one of its
    three-character strings, the rarest among the keywords, and meets the texts that hold it; keywords of
    one or two characters are listed whole. Either way the work doesn't grow with keywords times text."""
    words = keywords.select(F.lower("keyword").alias("keyword"), F.col("ord").cast("long").alias("ord"), "zone").where("keyword <> ''")
    words = words.groupBy("keyword").agg(F.min(F.struct("ord", "zone")).alias("w")).select("keyword", "w.ord", "w.zone")
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    if n <= small[0] and size <= small[1]:
        return by_automaton(texts, [(r["keyword"], r["ord"], r["zone"]) for r in words.collect()])
    return by_index(texts, words)


def by_automaton(texts: DataFrame, words: list[tuple[str, int, str]]) -> DataFrame:
    ranked = sorted(words, key=lambda w: (-len(w[0]), w[1], w[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for place, (word, _, _) in enumerate(ranked):
            tree.add_word(word, place)
        if ranked:
            tree.make_automaton()
        for batch in batches:
            best = [min((place for _, place in tree.iter(text)), default=None) if ranked else None for text in batch.column(0).to_pylist()]
            rows = pa.array([i for i, b in enumerate(best) if b is not None], pa.int64())
            hit = [ranked[b] for b in best if b is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([w[1] for w in hit], pa.int64()), pa.array([w[2] for w in hit], pa.string())], ["text", "ord", "zone"])

    return texts.select("text").where("text IS NOT NULL").mapInArrow(run, "text string, ord long, zone string")


def grams(text: Column, n: int) -> Column:
    """The distinct strings of n characters within a text."""
    letters = F.split(text, "")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(letters) - (n - 1)), lambda i: F.array_join(F.slice(letters, i, n), "")))


def by_index(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The join of texts and keywords on the keywords' rarest strings of three characters, then the
    exact test. A string that many texts hold meets few keywords, as each lies under its rarest."""
    long_ = lambda c, n: F.length(c) >= n
    listed = words.withColumn("gram", F.explode(F.when(long_("keyword", 3), grams(F.col("keyword"), 3)).otherwise(F.array("keyword"))))
    rare = listed.groupBy("gram").agg(F.count("*").alias("n"))
    index = listed.join(rare, "gram").groupBy("keyword", "ord", "zone").agg(F.min(F.struct("n", "gram")).alias("g")).select("keyword", "ord", "zone", "g.gram")
    none = F.array().cast("array<string>")
    parts = F.concat(*[F.when(long_("text", n), grams(F.col("text"), n)).otherwise(none) for n in (1, 2, 3)])
    met = texts.select("text", F.explode(parts).alias("gram")).join(index.select("gram").distinct(), "gram", "left_semi").join(index, "gram")
    hit = met.where(F.contains("text", F.col("keyword")))
    return hit.groupBy("text").agg(F.max(F.struct(F.length("keyword").alias("n"), (-F.col("ord")).alias("o"), "zone")).alias("w")).select("text", (-F.col("w.o")).alias("ord"), "w.zone")


def keyword_zone(listings: DataFrame, text: str, keywords: DataFrame, custom: DataFrame | None = None, fallback: str | None = None, small: tuple[int, int] = SMALL_TABLE) -> DataFrame:
    """``listings`` with ``zone``: an exact custom mapping, else the longest keyword that the
    text contains (ties to the first), else the fallback. keywords: keyword, ord, zone. Each
    distinct text is looked up once (see ``in_texts``)."""
    low = F.lower(text)
    found = in_texts(listings.select(low.alias("text")).where("text IS NOT NULL").distinct(), keywords, small)
    out = listings.join(found.select(F.col("text").alias("__text"), F.col("zone").alias("__zone")), low == F.col("__text"), "left").withColumn("zone", F.col("__zone")).drop("__text", "__zone")
    if custom is not None:
        custom = custom.select(F.lower("neighbourhood").alias("__n"), F.col("zone").alias("__z"))
        out = out.join(custom, low == F.col("__n"), "left").withColumn("zone", F.coalesce("__z", "zone")).drop("__n", "__z")
    return out.withColumn("zone", F.coalesce("zone", F.lit(fallback)))


def synonyms(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the synonym's canonical form (raw, canonical), or itself."""
    return df.join(table.select(F.col("raw").alias(column), "canonical"), column, "left").withColumn("canonical", F.coalesce("canonical", column))


def prefix_semi(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of ``left`` whose value begins a value of ``right`` or begins with one. An empty
    value begins every other.

    Distinct values meet on as many of their first three characters as both have, so a value
    has four rows at most and nothing but empty values is compared with everything."""

    def heads(df: DataFrame, column: str, name: str) -> DataFrame:
        values = df.select(F.lower(column).alias(name)).where(F.col(name).isNotNull()).distinct()
        return values.withColumn("__n", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.length(name))))).withColumn("__head", F.substring(F.col(name), F.lit(1), F.col("__n")))

    x, y = heads(left, a, "__a"), heads(right, b, "__b")
    met = x.join(y, ["__n", "__head"]).where(F.col("__n") == F.least(F.lit(3), F.length("__a"), F.length("__b")))
    found = met.where(F.startswith("__a", "__b") | F.startswith("__b", "__a")).select("__a").distinct()
    return left.join(found, F.lower(a) == F.col("__a"), "left_semi")


def first_by_priority(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def desirability(zones: DataFrame, group: str, price: str) -> DataFrame:
    """``zones`` with ``ldi``: the price between the group's lowest (0) and highest (100); 50 if
    all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(price).over(w), F.max(price).over(w)
    return zones.withColumn("ldi", F.when(high == low, 50.0).otherwise((F.col(price) - low) / F.nullif(high - low, F.lit(0.0)) * 100))


def upper_fifth(zones: DataFrame, group: str, price: str) -> DataFrame:
    """(group, threshold): the value at four fifths of the sorted prices, by position."""
    return ranks.at_share(zones, group, price, 0.8, "threshold")
