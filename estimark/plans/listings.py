"""Listings laid over the benchmark tables, in DataFrame form and in SQL.

``part`` rows stand for listings: the brand is the zone, the type the fascia, and the physical
columns are arithmetic on the key, with gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "id": "p_partkey", "zone": "p_brand", "fascia": "p_type", "price": "CAST(FLOOR(p_retailprice) AS INT) * 100", "rent_mo": "CAST(FLOOR(p_retailprice) AS INT)",
    "sqm": "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_size + 20 END",
    "ask_psqm": "CAST(ROUND(CAST(p_retailprice / (p_size + 20) AS DECIMAL(18,6)), 2) AS DOUBLE)",
    "rooms": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 5 + 1 AS INT) END", "bathrooms": "CAST(p_partkey % 3 + 1 AS INT)",
    "floor_n": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 14 - 2 AS INT) END",
    "elevator": "CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "condition": "CASE p_partkey % 6 WHEN 0 THEN 'Ottimo' WHEN 1 THEN 'buono' WHEN 2 THEN 'da ristrutturare' WHEN 3 THEN 'abitabile' WHEN 4 THEN 'nuova costruzione' END",
    "year_built": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1895 + p_partkey * 7 % 130 AS INT) END",
    "is_external": "CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", "has_balcony": "CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "has_parking": "CASE p_partkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", "furnished": "CASE p_partkey % 8 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "energy_class": "CASE p_partkey % 7 WHEN 0 THEN 'A4' WHEN 1 THEN 'b' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'G' END",
    "heating_type": "CASE p_partkey % 5 WHEN 0 THEN 'Autonomo' WHEN 1 THEN 'centralizzato con valvole' WHEN 2 THEN 'assente' WHEN 3 THEN 'centralizzato' END",
    "photo_count": "CAST(p_partkey % 12 AS INT)", "days_on_market": "CAST(p_partkey * 13 % 120 AS INT)",
    "spese_condominiali": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 500 AS INT) END",
    "lat": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 45.38 + CAST(p_partkey * 7919 % 1600 AS DOUBLE) / 10000 END",
    "lng": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 9.04 + CAST(p_partkey * 104729 % 2400 AS DOUBLE) / 10000 END",
    "omi_mid": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(18 + p_partkey % 7 AS DOUBLE) END",
    "city": "CASE p_partkey % 4 WHEN 0 THEN 'Milano' WHEN 1 THEN 'Roma' WHEN 2 THEN 'Napoli' ELSE 'Torino' END",
}
SQL = "listings AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM part)"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out over all cores by its key. A file of a few MB is read by one or two tasks,
    which then do all that is worked out for its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def listings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The listings; ``dealt`` out over all cores for queries that work much out for each row."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part = spread(part, "p_partkey") if dealt else part
    return part.select(*[F.expr(e).alias(n) for n, e in COLUMNS.items()])
