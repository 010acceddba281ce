"""The stored table: crashes, retries, buckets; streams on it and streams with states."""

import pytest
from pyspark.sql import functions as F

from estimark.operators import lifecycle
from estimark.sources.stored import StoredTable
from estimark.streaming import lifecycle as streams


def table(spark, tmp_path, buckets=8):
    return StoredTable(spark, str(tmp_path / "t"), "id", buckets)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_equal_the_merge(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        t.read()
    old = spark.range(100).select(F.col("id"), F.lit("old").alias("x"), F.lit(1).alias("y"))
    new = spark.range(90, 110).select(F.col("id"), F.lit("new").alias("x"), (F.col("id") * 2).alias("z"))
    assert t.upsert(old) == 1 and t.upsert(new) == 2
    want = lifecycle.upsert(old, new, "id")
    assert rows_of(t.read().select(want.columns)) == rows_of(want)
    t.upsert(spark.createDataFrame([(5, None), (None, "lost")], "id long, x string"))
    assert t.read().where("id = 5").first().asDict() == {"id": 5, "x": None, "y": 1, "z": None} and t.read().count() == 110


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(spark.range(20).withColumn("x", F.lit(0)), ("s", 0))
    before = rows_of(t.read())
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "publish", lambda self, manifest: (_ for _ in ()).throw(OSError("dead")))
        with pytest.raises(OSError):
            t.upsert(spark.range(20).withColumn("x", F.lit(1)), ("s", 1))
    assert rows_of(t.read()) == before
    again = StoredTable(spark, t.path, "id", 999)  # as after a restart; the table knows its buckets
    assert again.buckets == 8
    assert again.upsert(spark.range(20).withColumn("x", F.lit(1)), ("s", 1)) == 2
    assert rows_of(again.read()) == sorted(((k, 1) for k in range(20)), key=repr)
    assert len(again.vacuum(keep=1)) == 3 and rows_of(again.read()) == sorted(((k, 1) for k in range(20)), key=repr)  # the dead one's folder, the first version's, its manifest


def test_a_batch_twice_equals_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for number, x in ((0, "a"), (1, "b"), (1, "c"), (0, "d")):
        t.upsert(spark.createDataFrame([(1, x)], "id long, x string"), ("s", number))
    assert rows_of(t.read()) == [(1, "b")]
    t.upsert(spark.createDataFrame([(1, "other")], "id long, x string"), ("another stream", 0))
    assert rows_of(t.read()) == [(1, "other")]


def test_two_writers_of_a_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.range(3).withColumn("x", F.lit(0)))
    stale = t.manifest()
    t.upsert(spark.range(3).withColumn("x", F.lit(1)))
    with pytest.raises(FileExistsError):
        t.replace(stale, t.touched(t.read()), t.read(), None)
    assert {r["x"] for r in t.read().collect()} == {1}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.range(200).withColumn("x", F.lit(0)))
    before = t.manifest().folders
    t.upsert(spark.createDataFrame([(7, 9)], "id long, x int"))
    changed = {b for b, f in t.manifest().folders.items() if f != before[b]}
    assert changed == {str(b) for b in t.touched(spark.range(7, 8).withColumnRenamed("id", "id"))}
    assert t.read(t.touched(spark.range(7, 8))).where("id = 7").first()["x"] == 9
    version = t.sweep([(F.col("x") == 9, {"x": F.lit(10)}), (F.col("x") == 10, {"x": F.lit(11)}), (F.col("id") < 0, {"x": F.lit(1)})])
    assert version == 3 and t.read().where("x = 11").count() == 1 and len([b for b, f in t.manifest().folders.items() if f != before[b]]) == 1
    assert t.sweep([(F.col("x") == 77, {"x": F.lit(1)})]) == 3  # nothing to do, nothing written
    assert t.delete(F.col("id") >= 150) == 4 and t.read().count() == 150
    assert t.delete(F.lit(True)) == 5 and t.read().count() == 0 and t.read().columns == ["id", "x"]


def test_duplicates_within_a_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, "a", 3), (1, "b", 5), (1, "c", 4)], "id long, x string, at int"), latest=[F.desc("at")])
    assert rows_of(t.read()) == [(1, "b", 5)]


def test_guarded_upserts_of_a_stream(spark, tmp_path):
    t = table(spark, tmp_path)
    put = streams.guarded_upsert(t)
    frame = lambda rows: spark.createDataFrame(rows, "id long, x string, full_scan boolean")
    put(frame([(1, "a", True), (2, "b", True), (3, "c", True)]), 0)
    put(frame([(1, "z", True)]), 1)  # a scan that shrank
    assert rows_of(t.read()) == [(1, "a"), (2, "b"), (3, "c")]
    put(frame([(4, "d", False)]), 2)
    put(frame([(4, "again", False)]), 2)
    assert rows_of(t.read()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_watched_files_into_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(3):
        spark.createDataFrame([(k, f"v{k}"), (9, f"v{k}")], "id long, x string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        streams.watch_files(spark, str(tmp_path / "in"), "id long, x string", streams.guarded_upsert(t), str(tmp_path / "c"), None).awaitTermination()
    assert rows_of(t.read()) == [(0, "v0"), (1, "v1"), (2, "v2"), (9, "v2")] and t.manifest().applied == {"listings": 2}


def feed(spark, tmp_path, make, batches, schema):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # the states' number of partitions
    for rows in batches:
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = make(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_expiry_in_any_zone(spark, tmp_path, zone):
    """A listing seen on 1 January 10:00Z goes stale once the watermark passes 8 January 10:00Z, in
    every session zone; who returns late keeps the first sighting, until dropped."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        batches = [[(1, "2024-01-01T10:00:00Z")], [(5, "2024-01-08T06:00:00Z")], [(5, "2024-01-08T12:00:00Z")]]
        out = feed(spark, tmp_path, lambda s: streams.expiry(s, "id", "at"), batches, "id long, at timestamp")
        one = lambda: [r["status"] for r in out.where("id = 1").select("status", F.unix_millis("first_seen").alias("f")).orderBy("status").collect()]
        assert one() == ["seen", "stale"], "the watermark is at 11:00Z, so it is stale, and wasn't at 05:00Z"
        assert {r["f"] for r in out.where("id = 1").select(F.unix_millis("first_seen").alias("f")).collect()} == {1704103200000}
        more = [[(1, "2024-01-20T10:00:00Z")], [(5, "2024-02-01T00:00:00Z")], [(5, "2024-03-01T00:00:00Z")], [(1, "2024-03-04T00:00:00Z")]]
        out = feed(spark, tmp_path, lambda s: streams.expiry(s, "id", "at"), more, "id long, at timestamp")
        got = [(r["status"], r["f"], r["l"]) for r in out.where("id = 1").select("status", F.unix_millis("first_seen").alias("f"), F.unix_millis("last_seen").alias("l")).collect()]
        first, back, new = 1704103200000, 1705744800000, 1709510400000
        assert sorted(got) == sorted([("seen", first, first), ("stale", first, first), ("seen", first, back), ("stale", first, back), ("dropped", first, back), ("seen", new, new)])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_price_changes_forget(spark, tmp_path):
    day = lambda k, x, d: (k, f"2024-{d}T10:00:00Z", x)
    batches = [[day(1, 9.0, "01-01"), (1, "2024-01-01T09:00:00Z", 12.0)], [day(1, 8.0, "01-02"), (2, None, 1.0), day(2, None, "01-02")], [day(3, 1.0, "02-20")], [day(3, 1.0, "02-21")], [day(1, 7.0, "02-22")], [day(1, 6.0, "02-23")]]
    out = feed(spark, tmp_path, lambda s: streams.price_changes(s, "id", "at", "price", forget_after_days=30), batches, "id long, at timestamp, price double")
    assert sorted((r["id"], r["previous_price"], r["price"]) for r in out.collect()) == [(1, 7.0, 6.0), (1, 9.0, 8.0), (1, 12.0, 9.0)]  # 8.0 was forgotten
