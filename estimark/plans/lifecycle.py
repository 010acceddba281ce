"""Queries on listings over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.operators import digest, lifecycle
from estimark.plans.listings import SQL, listings
from estimark.sources import files


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedup_keep_last(spark, sf_dir):
    return lifecycle.keep_last(t(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def dedup_realworld(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", F.round("lat", 1).alias("lat"), F.round("lng", 1).alias("lng"), "rooms", F.expr("sqm DIV 10").cast("int").alias("sqm"), F.expr("price DIV 50000").cast("int").alias("price"), F.when(F.col("id") % 6 == 0, None).otherwise(F.concat(F.lit("2024-0"), (F.col("id") % 9 + 1).cast("string"))).alias("first_seen"))
    return lifecycle.same_home(df).select("id")


def first_last_seen(spark, sf_dir):
    return lifecycle.seen(t(spark, sf_dir, "events"), "user_id", "ts")


def stale_flags(spark, sf_dir):
    rows = lifecycle.seen(t(spark, sf_dir, "events"), "user_id", "ts").withColumn("last_seen_date", F.expr("CASE WHEN user_id % 20 = 0 THEN NULL ELSE date_sub(last_seen_date, CAST(user_id % 40 AS INT)) END"))
    return lifecycle.staleness(rows, "last_seen_date", F.to_date(F.lit("2024-01-31"))).select("user_id", "days_unseen", "is_stale")


def trim_expired(spark, sf_dir):
    return lifecycle.not_expired(t(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit("2024-04-15 00:00:00")), 90).groupBy("event_type").agg(F.count("*").alias("n"))


def price_drops(spark, sf_dir):
    return lifecycle.drops_in_history(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "previous_price")


def price_drop_lookup(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("int").alias("price"))
    now = orders.withColumn("price", F.when(F.col("o_orderkey") % 3 == 0, F.col("price") - 100).otherwise(F.col("price")))
    return lifecycle.price_drops(now, orders.where("o_orderkey % 2 = 0"), "o_orderkey", "price").select("o_orderkey", "price", "previous_price", "price_drop")


def snapshot_merge(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "zone", "price")
    old, new = rows.where("id % 3 <> 0"), rows.where("id % 5 = 0 AND zone <= 'Brand#3'").withColumn("price", F.col("price") + 1)
    return lifecycle.merge_snapshot(old, new, "id", "zone")


def upsert_merge(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"), "o_custkey")
    return lifecycle.upsert(old, new, "o_orderkey")


def cache_anti_join(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lifecycle.unseen(orders.where("o_orderdate >= '1998-01-01'"), orders.where("o_orderdate < '1998-01-01'"), "o_custkey").select("o_orderkey")


def update_sweeps(spark, sf_dir):
    df = listings(spark, sf_dir).select("id", "city", "ask_psqm", (F.col("id") % 101).cast("int").alias("score_total"), F.lit(False).alias("excluded"), (F.col("id") % 4 == 0).alias("gem"), F.col("condition").alias("title"))
    c = F.col
    steps = [
        ((c("city") == "Milano") & (c("ask_psqm") < 20), {"excluded": F.lit(True), "score_total": F.lit(0)}),
        (F.lower("title").contains("ristruttur"), {"score_total": c("score_total") - 10}), (c("excluded"), {"gem": F.lit(False)}), (c("gem") & (c("score_total") < 50), {"gem": F.lit(False)}), (c("score_total") < 0, {"score_total": F.lit(0)}),
    ]
    return lifecycle.sweep(df, steps).drop("title", "ask_psqm", "city")


def public_view(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("coalesce(o_orderstatus, '') <> 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def favourites(spark, sf_dir):
    liked = t(spark, sf_dir, "customer").where("c_custkey % 50 = 1").select(F.col("c_custkey").alias("id"))
    return listings(spark, sf_dir).join(liked, "id", "left_semi").select("id", "zone", "price")


def digest_ready(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.col("event_type").alias("id"), (F.col("user_id") % 6).cast("int").alias("min_new_listings"))
    return digest.ready(ev)


def cache_stats(spark, sf_dir):
    cache = t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("enriched_at"))
    return files.cache_stats(cache)


def hourly_counts(spark, sf_dir):
    """The batch form of the hourly stream: events by hour and type, three and more."""
    return t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")).where("n >= 3")


QUERIES = {f.__name__: f for f in (dedup_keep_last, dedup_realworld, first_last_seen, stale_flags, trim_expired, price_drops, price_drop_lookup, snapshot_merge, upsert_merge, cache_anti_join, update_sweeps, public_view, favourites, digest_ready, cache_stats, hourly_counts)}

ORACLE_SQL = {
    "dedup_keep_last": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "dedup_realworld": f"""WITH {SQL}, x AS (SELECT id, round(lat, 1) AS la, round(lng, 1) AS ln, rooms, sqm // 10 AS m, price // 50000 AS p, CASE WHEN id % 6 = 0 THEN '9999' ELSE '2024-0' || (id % 9 + 1) END AS seen FROM listings),
y AS (SELECT *, row_number() OVER (PARTITION BY la, ln, rooms, m, p ORDER BY seen, CAST(id AS VARCHAR)) AS n FROM x) SELECT id FROM y WHERE n = 1 OR la IS NULL OR rooms IS NULL OR m IS NULL""",
    "first_last_seen": "SELECT user_id, CAST(min(ts) AS DATE) AS first_seen_date, CAST(max(ts) AS DATE) AS last_seen_date FROM events GROUP BY user_id",
    "stale_flags": """WITH s AS (SELECT user_id, CASE WHEN user_id % 20 = 0 THEN NULL ELSE CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') + user_id % 40 AS INT) END AS days_unseen FROM events GROUP BY user_id)
SELECT user_id, days_unseen, coalesce(days_unseen >= 7, FALSE) AS is_stale FROM s WHERE days_unseen IS NULL OR days_unseen < 30""",
    "trim_expired": "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY GROUP BY event_type",
    "price_drops": "SELECT o_custkey, o_orderkey, previous_price FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_price FROM orders) WHERE o_totalprice < previous_price",
    "price_drop_lookup": "SELECT o_orderkey, p - 100 AS price, p AS previous_price, 100 AS price_drop FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS p FROM orders) WHERE o_orderkey % 6 = 0 AND p > 0",
    "snapshot_merge": f"""WITH {SQL}, new AS (SELECT id, zone, price + 1 AS price FROM listings WHERE id % 5 = 0 AND zone <= 'Brand#3')
SELECT id, zone, price FROM listings WHERE id % 3 <> 0 AND id NOT IN (SELECT id FROM new) AND zone NOT IN (SELECT zone FROM new) UNION ALL SELECT * FROM new""",
    "upsert_merge": """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL THEN lower(b.o_orderstatus) ELSE a.o_orderstatus END AS o_orderstatus, a.o_orderpriority, b.o_custkey FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "cache_anti_join": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')",
    "update_sweeps": f"""WITH {SQL}, a AS (SELECT id, coalesce(city = 'Milano' AND ask_psqm < 20, FALSE) AS excluded, CAST(id % 101 AS INT) AS s, condition, id % 4 = 0 AS gem FROM listings),
b AS (SELECT id, excluded, CASE WHEN excluded THEN 0 ELSE s END - CASE WHEN condition LIKE '%ristruttur%' THEN 10 ELSE 0 END AS s, gem AND NOT excluded AS gem FROM a)
SELECT id, CAST(greatest(0, s) AS INT) AS score_total, excluded, gem AND s >= 50 AS gem FROM b""",
    "public_view": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE coalesce(o_orderstatus, '') <> 'F' GROUP BY o_orderpriority",
    "favourites": f"WITH {SQL} SELECT id, zone, price FROM listings WHERE id IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 1)",
    "digest_ready": "SELECT user_id AS rule_id, CAST(user_id % 6 AS INT) AS min_new_listings, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= user_id % 6",
    "cache_stats": "SELECT event_type AS source, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3",
}
