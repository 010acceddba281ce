"""Scores after a change of mappings or settings: what changed, whom it reaches, and those scored
again in the stored table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimark.settings import Settings
from estimark.sources.stored import StoredTable


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key): keys whose row was added, removed or given other values."""
    columns = [c for c in new.columns if c != key]
    a, b = (df.select(key, F.struct(*columns).alias(name)) for df, name in ((old, "was"), (new, "is")))
    return a.join(b, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select(key)


#: Rows that a changed setting can reach, from its old and new value; a setting that isn't here reaches all.
REACH: dict[str, Callable[[object, object], Column]] = {
    "penalty_dom_stale": lambda a, b: F.col("days_on_market") > min(a, b),
    "penalty_dom_warn": lambda a, b: F.col("days_on_market") > min(a, b),
    "euro_impact_small": lambda a, b: F.coalesce(F.col("sqm"), F.lit(0)) > 0,
    "euro_impact_large": lambda a, b: F.coalesce(F.col("sqm"), F.lit(0)) > 0,
    "gem_metro_max_m": lambda a, b: F.col("metro_m").between(min(a, b), max(a, b)),
    "gem_min_sqm_per_room": lambda a, b: (F.col("sqm") / F.nullif(F.col("rooms"), F.lit(0))).between(min(a, b), max(a, b)),
}


def reached(old: Settings, new: Settings) -> Column:
    """Whether a listing's score may differ between two settings."""
    out = F.lit(False)
    for f in fields(Settings):
        a, b = getattr(old, f.name), getattr(new, f.name)
        if a != b:
            out = out | (F.coalesce(REACH[f.name](a, b), F.lit(False)) if f.name in REACH else F.lit(True))
    return out


def rescore(table: StoredTable, groups: DataFrame, score: Callable[[DataFrame], DataFrame], rows: Column | None = None) -> int:
    """Scores again the listings of some groups: rows of the table whose bucketing column (``by``)
    is in ``groups``, or those of them that ``rows`` selects. Only the groups' buckets are read and
    written; ``score`` gives rows with the same columns. Returns the version."""
    now = table.manifest()
    if now is None:
        return 0
    groups = groups.select(F.col(table.by)).distinct()
    touched = table.touched(groups)
    if not touched:
        return now.version
    stored = table.rows(now, touched)
    named = stored.join(groups.withColumn("__hit", F.lit(True)), table.by, "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if rows is None else F.coalesce(rows, F.lit(False)))
    again = score(named.where(hit).select(stored.columns)).select(stored.columns)
    return table.replace(now, touched, named.where(~hit).select(stored.columns).unionByName(again), None)
