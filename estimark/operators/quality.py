"""Completeness of listings: per row, per field, and what is missing most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark.functions.scalars import exactly

WEIGHTS = {"critical": 3, "important": 2, "useful": 1}
BAD_SOURCES = ["keyword_fallback", "no_coordinates", "failed", "centroid", "nominatim+centroid"]
#: Fields in which 0 is as good as missing.
NOT_ZERO = ["rent_mo", "sqm", "ask_psqm", "price"]


def present(df: DataFrame, field: str) -> Column:
    kind, c = dict(df.dtypes)[field], F.col(field)
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind.startswith("array"):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != 0) if field in NOT_ZERO else c.isNotNull()


def audit(df: DataFrame, fields: dict[str, list[str]], key: str = "id", source: str = "omi_source") -> DataFrame:
    """(key, completeness_pct, critical_score, important_score, grade, missing lists,
    needs_reenrichment) for each row."""
    have = {f: F.coalesce(present(df, f), F.lit(False)) for group in fields.values() for f in group}
    count = lambda group: sum((F.when(have[f], 1).otherwise(0) for f in fields[group]), F.lit(0))
    total = sum(WEIGHTS[g] * len(fs) for g, fs in fields.items())
    weight = sum((count(g) * w for g, w in WEIGHTS.items()), F.lit(0))
    missing = lambda group: F.array_compact(F.array(*[F.when(~have[f], F.lit(f)) for f in fields[group]]))
    pct = exactly(weight / total * 100, 1)
    grade = F.when(pct >= 90, "A").when(pct >= 75, "B").when(pct >= 60, "C").when(pct >= 40, "D").otherwise("F")
    gone = missing("critical")
    return df.select(
        key, pct.alias("completeness_pct"), exactly(count("critical") / len(fields["critical"]) * 100, 1).alias("critical_score"),
        exactly(count("important") / len(fields["important"]) * 100, 1).alias("important_score"), grade.alias("grade"),
        F.array_join(gone, ",").alias("critical_missing"), F.array_join(missing("important"), ",").alias("important_missing"), F.array_join(missing("useful"), ",").alias("useful_missing"),
        ((F.size(gone) > 0) | F.coalesce(F.col(source).isin(BAD_SOURCES), F.lit(False))).alias("needs_reenrichment"),
    )


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_missing, coverage_pct): one pass over the rows, one row a field."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(present(df, f), F.lit(False))).alias(f) for f in fields])
    long = sums.unpivot("n", fields, "field", "n_missing")
    return long.select("field", "n_missing", exactly((F.col("n") - F.col("n_missing")) / F.nullif(F.col("n"), F.lit(0)) * 100, 1).alias("coverage_pct"))


def summary(audited: DataFrame, listings: DataFrame, key: str = "id", source: str = "source", zone_source: str = "omi_source") -> DataFrame:
    """(what, name, n, value): the audit's totals, grades and sources, a row each: rows and their
    mean completeness, grades, rows to enrich again, sources and sources of zones."""
    grades = audited.groupBy(F.col("grade").alias("name")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("value"))
    total = audited.agg(F.count("*").alias("n"), exactly(F.avg("completeness_pct"), 1).alias("value")).select(F.lit("all").alias("name"), "n", "value")
    again = audited.agg(F.count_if("needs_reenrichment").alias("n")).select(F.lit("again").alias("name"), "n", F.lit(None).cast("double").alias("value"))
    by = lambda c, none: listings.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)).alias("name")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("value"))
    parts = {"total": total, "grade": grades, "enrich": again, "source": by(source, "unknown"), "zone source": by(zone_source, "missing")}
    out = None
    for what, part in parts.items():
        rows = part.select(F.lit(what).alias("what"), "name", "n", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
