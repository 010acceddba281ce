"""Ranks within keys of any size: no key is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimark.operators.meeting import settled


def placed(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, before, total): each distinct value of a key, how many rows have it, how many
    rows of the key come before it, and how many there are. Null values have no place.

    Values are counted first, then dealt out in ranges of (key, value) of about equal size. A value's
    place is the rows of the key in the ranges before its own, plus those before it within the
    range. Windows run over a range's part of a key, and over a key's ranges, never over a key."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    dealt = settled(counts.repartitionByRange(ranges, key, value).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(key, "__range").agg(F.sum("n").alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(key).alias("__key"), F.col("__range").alias("__r"), F.coalesce(earlier, F.lit(0)).alias("__earlier"), F.sum("__sum").over(Window.partitionBy(key)).alias("total"))
    within = F.sum("n").over(Window.partitionBy(key, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    both = dealt.withColumn("__within", F.coalesce(within, F.lit(0))).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__r")))
    return both.select(key, value, "n", (F.col("__earlier") + F.col("__within")).alias("before"), "total")


def share_up_to(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the share of the key's rows whose value is no greater; null without a value, or
    where the key has none."""
    places = placed(df, key, value).select(F.col(key).alias("__k"), F.col(value).alias("__v"), ((F.col("before") + F.col("n")) / F.col("total")).alias(name))
    return df.join(places, F.col(key).eqNullSafe(F.col("__k")) & (F.col(value) == F.col("__v")), "left").drop("__k", "__v")


def at_share(df: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """(key, name): the value at place floor(share * n) of the key's n sorted values, the last at most."""
    place = F.least(F.floor(F.col("total") * F.lit(share)), F.col("total") - 1)
    return placed(df, key, value).where((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select(key, F.col(value).alias(name))
