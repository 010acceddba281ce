"""Listings over time: duplicates, snapshots, staleness, prices, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str, arrival: list) -> DataFrame:
    """The last row of each key by the arrival order."""
    w = Window.partitionBy(key).orderBy(*arrival)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def same_home(df: DataFrame, lat: str = "lat", lng: str = "lng", others: tuple[str, ...] = ("rooms", "sqm", "price"), first_seen: str = "first_seen", key: str = "id") -> DataFrame:
    """One row of each home: equal place (three decimals) and other columns, the earliest seen.
    Rows that lack one of these pass."""
    columns = [lat, lng, *others]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    w = Window.partitionBy(F.round(lat, 3), F.round(lng, 3), *others).orderBy(F.coalesce(F.col(first_seen), F.lit("9999")), F.col(key).cast("string"))
    return df.where(known).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").unionByName(df.where(~known))


def merge_snapshot(existing: DataFrame, new: DataFrame, key: str, area: str) -> DataFrame:
    """New rows, and the existing ones that neither they nor a new scan of their area replace."""
    kept = existing.join(new.select(key), key, "left_anti").join(new.select(area).distinct(), area, "left_anti")
    return kept.select(existing.columns).unionByName(new)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have the key, the columns that ``new`` supplies win."""
    a, b = existing.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    both = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for c in [*existing.columns, *[c for c in new.columns if c not in existing.columns]]:
        if c == key:
            continue
        if c not in new.columns:
            both.append(F.col(f"a.{c}").alias(c))
        elif c not in existing.columns:
            both.append(F.col(f"b.{c}").alias(c))
        else:
            both.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(both)


def seen(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen_date, last_seen_date)."""
    return events.groupBy(key).agg(F.to_date(F.min(at)).alias("first_seen_date"), F.to_date(F.max(at)).alias("last_seen_date"))


def staleness(rows: DataFrame, last_seen: str, today: Column, stale_after: int = 7, drop_after: int = 30) -> DataFrame:
    """``rows`` with days_unseen and is_stale, without those unseen for ``drop_after`` days; a
    missing date gives grace."""
    days = F.date_diff(today, F.col(last_seen))
    out = rows.withColumn("days_unseen", days).withColumn("is_stale", F.coalesce(days >= stale_after, F.lit(False)))
    return out.where(F.col("days_unseen").isNull() | (F.col("days_unseen") < drop_after))


def not_expired(cache: DataFrame, at: str, now: Column, days: int = 90) -> DataFrame:
    return cache.where(F.col(at) > now - F.make_dt_interval(F.lit(days)))


def price_drops(new: DataFrame, current: DataFrame, key: str, price: str) -> DataFrame:
    """``new`` with the price before and the drop, where it fell."""
    before = current.select(key, F.col(price).alias("previous_price")).where("previous_price > 0")
    joined = new.join(before, key)
    return joined.where(F.col(price) < F.col("previous_price")).withColumn("price_drop", F.col("previous_price") - F.col(price))


def drops_in_history(rows: DataFrame, key: str, at: list[str], price: str) -> DataFrame:
    """Rows whose price is below the key's row before."""
    w = Window.partitionBy(key).orderBy(*at)
    return rows.withColumn("previous_price", F.lag(price).over(w)).where(F.col(price) < F.col("previous_price"))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def sweep(df: DataFrame, steps: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Conditional updates one after the other; later conditions see earlier changes."""
    for condition, changes in steps:
        hit = F.coalesce(condition, F.lit(False))
        df = df.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in changes.items()})
    return df
