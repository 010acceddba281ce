"""Golden values, streams, sources and invariants of the listing engine."""

import pytest
from pyspark.sql import functions as F

from estimark.functions import scalars as sc
from estimark.operators import comps, flags, geo, lifecycle
from estimark.plans import lifecycle as life
from estimark.plans import scores
from estimark.sources import files
from estimark.streaming import lifecycle as streams

from conftest import SF


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_floor_coefficients(spark):
    cases = [(-2, None, -0.25), (-1, None, -0.20), (0, None, -0.10), (1, None, -0.10), (2, True, -0.03), (2, False, -0.15), (3, True, 0.0), (3, False, -0.20), (5, True, 0.05), (5, False, -0.25), (8, True, 0.10), (8, False, -0.30), (12, True, 0.20), (12, False, -0.20)]
    df = spark.createDataFrame(cases, "floor int, lift boolean, want double")
    assert df.where(F.abs(sc.floor_coefficient(F.col("floor"), F.col("lift")) - F.col("want")) > 1e-12).count() == 0


def test_parsers(spark):
    floor = lambda x: one(spark, sc.parse_floor(F.lit(x))[0])[0]
    assert [floor(x) for x in ("S, 3", "4 - 5", "T, R", "S4", "N/A", "")] == [-1, 4, 0, -2, None, None]
    assert one(spark, sc.slug(F.lit("Città Studi")), sc.slug(F.lit("Porta Venezia"))) == ("citta-studi", "porta-venezia")
    assert one(spark, sc.parse_rooms(F.lit("Bilocale arredato")), sc.parse_rooms(F.lit("3 locali")), sc.parse_rooms(F.lit("?"))) == (2, 3, None)
    assert one(spark, sc.digits_within(F.lit("€ 1.200 /mese"), 100, 50_000), sc.digits_within(F.lit("€ 5"), 100, 50_000)) == (1200, None)


def test_gate_and_bands(spark):
    low, high = sc.size_band(F.lit(42.0))
    assert one(spark, sc.value_gate(F.lit(6154), F.lit(52)), F.round(low, 2), F.round(high, 2)) == (65, 35.7, 48.3)


def test_distance_phrase(spark):
    why = lambda x: one(spark, flags.misplaced(F.lit(x), ["opera"]))[0]
    assert (why("a 8 km da Milano"), why("a 2 km da Milano"), why("ad opera proponiamo"), why("Casa")) == ("distance:8", None, "opening:opera", None)


def test_nulls_in_distance(spark):
    assert one(spark, sc.haversine_m(F.lit(None).cast("double"), F.lit(9.0), F.lit(45.0), F.lit(9.0))) == (None,)


def test_invariants(spark):
    rows = scores.with_scores(spark, SF)
    assert rows.where("score_total > 62 AND delta_label > 5 OR score_total > 50 AND delta_label > 10 OR floor_n < 0 AND score_total > 55 OR hidden_gem AND score_total < 80").count() == 0


def test_radius_join_is_complete(spark):
    points = spark.range(60).select(F.col("id"), (45.4 + F.col("id") * 7 % 13 / 500).alias("lat"), (9.1 + F.col("id") * 11 % 17 / 400).alias("lng"))
    near = comps.radius_pairs(points, points, 900).count()
    d = sc.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    assert near == points.alias("a").join(points.alias("b"), F.col("a.id") != F.col("b.id")).where(F.round(d, 3) <= 900).count()


def test_nearest_beyond_the_rings(spark):
    far = spark.createDataFrame([(1, 10.0, 10.0, "x")], "id long, lat double, lng double, kind string")
    points = spark.createDataFrame([(5, 40.0, 9.0, "x"), (6, 41.0, 9.0, "x"), (7, 10.0, 10.0, "y")], "point_id long, lat double, lng double, kind string")
    assert geo.nearest(far, points, ["kind"]).first()["point_id"] == 5


@pytest.mark.parametrize("mode", ["seen", "hourly"])
def test_streams_equal_batches(spark, tmp_path, mode):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    if mode == "seen":
        streams.run_now(streams.seen(stream, "user_id", "ts"), "seen", str(tmp_path / "c"))
        ours, batch = spark.table("seen"), life.first_last_seen(spark, SF)
    else:
        streams.run_now(streams.hourly(stream, "ts", "event_type", 3), "hourly", str(tmp_path / "c"))
        ours, batch = spark.table("hourly"), life.hourly_counts(spark, SF)
        batch = batch.withColumn("hour", F.col("hour").cast("timestamp"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, batch.select(ours.columns).collect()))


def test_distinct_sightings(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streams.run_now(streams.distinct_sightings(stream, "event_id", "ts"), "sightings", str(tmp_path / "c"), "append")
    assert sorted(r["event_id"] for r in spark.table("sightings").collect()) == sorted(r["event_id"] for r in events.collect())


def test_upsert_keeps_unsupplied_columns(spark):
    old, new = spark.createDataFrame([(1, "a", 5)], "id int, x string, y int"), spark.createDataFrame([(1, None), (2, "n")], "id int, x string")
    assert sorted(map(tuple, lifecycle.upsert(old, new, "id").collect())) == [(1, None, 5), (2, "n", None)]


def test_zone_csv_and_prices(spark, tmp_path):
    rows = ["titolo", "Area_territoriale;Comune_amm;Zona;Cod_Tip;Stato;Compr_min;Compr_max;Loc_min;Loc_max;", "NORD;F205;B12;20;OTTIMO;9000,5;11000;20;25,5;", "NORD;F205;B12;20;NORMALE;7000;8000;15,5;18;", "NORD;F205;'C1';20;OTTIMO;;;10;12;"]
    (tmp_path / "v.csv").write_bytes("\n".join(rows).encode("latin-1"))
    got = {r["zona"]: r for r in files.zone_prices(files.read_zone_csv(spark, str(tmp_path / "v.csv"))).collect()}
    assert (got["B12"]["compr_mid"], got["B12"]["loc_mid"], got["C1"]["compr_mid"], got["C1"]["loc_mid"]) == (7500.0, 16.75, None, 11.0)


def test_polygons_from_kml(spark, tmp_path):
    ring = lambda x: f"<LinearRing><coordinates>{x}</coordinates></LinearRing>"
    (tmp_path / "z.kml").write_text(f"<kml><Document><Placemark><name>MILANO - Zona OMI B12</name><Polygon><outerBoundaryIs>{ring('9,45,0 9.2,45,0 9.2,45.2,0 9,45.2,0')}</outerBoundaryIs><innerBoundaryIs>{ring('9.05,45.05 9.1,45.05 9.1,45.1 9.05,45.1')}</innerBoundaryIs></Polygon></Placemark></Document></kml>")
    zones = files.read_polygons(spark, str(tmp_path / "z.kml"), "milano")
    points = spark.createDataFrame([(1, 45.15, 9.15, "milano"), (2, 45.07, 9.07, "milano"), (3, None, 9.0, "milano")], "id long, lat double, lng double, city string")
    assert {r["id"]: (r["zona"], r["how"]) for r in geo.polygon_lookup(points, zones).collect()} == {1: ("B12", "polygon"), 2: ("B12", "centroid")}


def test_snapshot_and_item_list(spark, tmp_path):
    df = spark.createDataFrame([(1, "", [], 0, False, 9)], "id int, a string, b array<int>, c int, d boolean, _e int")
    assert files.slim(df).first().asDict() == {"id": 1, "a": None, "b": None, "c": 0, "d": False}
    files.write_snapshot(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).columns == ["c", "d", "id"]
    page = spark.createDataFrame([('{"itemListElement": [{"url": "https://x/annunci/123/", "name": "n"}]}',)], "body string")
    assert files.item_list(page, "body").first()["item_id"] == "123"
    files.export_csv(df, str(tmp_path / "c"), ["id", "missing"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["id", "missing"]


def test_price_changes_of_a_stream(spark, tmp_path):
    first = [(1, "2024-01-01 10:00:00", 100.0), (1, "2024-01-01 12:00:00", 90.0), (2, "2024-01-01 10:00:00", 50.0), (3, "2024-01-01 10:00:00", None)]
    second = [(1, "2024-01-02 10:00:00", 95.0), (2, "2024-01-02 10:00:00", 40.0), (1, "2024-01-02 11:00:00", 80.0)]
    schema = "id long, at string, price double"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = streams.price_changes(spark.readStream.schema(schema).json(str(tmp_path / "in")), "id", "at", "price")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = sorted((r["id"], r["previous_price"], r["price"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(1, 95.0, 80.0), (1, 100.0, 90.0), (2, 50.0, 40.0)]


def test_expiry_of_a_stream(spark, tmp_path):
    schema = "id long, at string"
    days = [[(1, "2024-01-01"), (2, "2024-01-01")], [(2, "2024-01-20"), (9, "2024-01-20")], [(9, "2024-02-03")], [(9, "2024-02-20")], [(1, "2024-03-01"), (9, "2024-03-01")]]
    for rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = streams.expiry(spark.readStream.schema(schema).json(str(tmp_path / "in")), "id", "at")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = [(r["id"], r["status"], str(r["first_seen"].date())) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (1, "stale", "2024-01-01") in out and (1, "dropped", "2024-01-01") in out and (1, "seen", "2024-03-01") in out
    assert (2, "seen", "2024-01-01") in out and all(first == "2024-01-01" for k, status, first in out if k == 2)
    assert out.count((9, "seen", "2024-01-20")) == 4


def test_watched_files_and_due_digests(spark, tmp_path):
    rows = [(1, "2024-01-01 07:10:00", "milano"), (2, "2024-01-01 07:20:00", "milano"), (3, "2024-01-01 08:20:00", "roma")]
    schema = "id long, at timestamp, city string"
    spark.createDataFrame(rows, "id long, at string, city string").write.json(str(tmp_path / "in"))
    got = []
    streams.watch_files(spark, str(tmp_path / "in"), schema, lambda df, _: got.extend(r["id"] for r in df.collect()), str(tmp_path / "c"), None).awaitTermination()
    assert sorted(got) == [1, 2, 3]
    users = spark.createDataFrame([(10, "milano", True, 7, 2), (11, "milano", True, 7, 3), (12, "roma", True, 8, None), (13, "roma", False, 8, 1)], "id long, city string, active boolean, send_hour int, min_new int").withColumnRenamed("city", "city")
    due = streams.due_digests(spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumnRenamed("city", "place"), users, "at", "place")
    due.writeStream.format("memory").queryName("due").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["user"], r["n"]) for r in spark.table("due").collect()) == [(10, 2), (12, 1)]


def test_radius_join_near_poles_and_date_line(spark):
    places = [(1, 0.0, 179.9995), (2, 0.0, -179.9995), (3, 70.0, 20.0), (4, 70.0, 20.02), (5, 89.9999, 0.0), (6, 89.9999, 180.0), (7, 60.5, 10.0), (8, 60.5, 10.0199), (9, 70.0, 20.03), (10, -33.9, 18.4), (11, -33.905, 18.4)]
    points = spark.createDataFrame(places, "id long, lat double, lng double")
    d = sc.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    want = {(r[0], r[1]) for r in points.alias("a").join(points.alias("b"), F.col("a.id") != F.col("b.id")).where(F.round(d, 3) <= 1100).select("a.id", "b.id").collect()}
    assert {(1, 2), (3, 4), (5, 6), (7, 8), (10, 11)} <= want
    rows = [(r["id"], r["c_id"]) for r in comps.radius_pairs(points, points, 1100).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_prefixes_of_any_length(spark):
    from estimark.operators import lookup

    left = spark.createDataFrame([(k, v) for k, v in enumerate(["M", "Milano", "mi", "Roma", "", None, "Napoli", "R"])], "id int, a string")
    right = spark.createDataFrame([("MIL",), ("rom",), ("N",), (None,)], "b string")
    assert sorted(r["id"] for r in lookup.prefix_semi(left, right, "a", "b").collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert lookup.prefix_semi(left, right.where("b = 'x'"), "a", "b").count() == 0
    assert sorted(r["id"] for r in lookup.prefix_semi(left, spark.createDataFrame([("",)], "b string"), "a", "b").collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_files_about_a_municipality(spark, tmp_path):
    for name, code in (("b.csv", "F205"), ("a.csv", "F205"), ("0.csv", "H501")):
        (tmp_path / name).write_text(f"titolo\nArea_territoriale;Comune_amm;\nNORD;{code};\n")
    found = lambda code: [r["file"].rsplit("/", 1)[1] for r in files.files_about(spark, str(tmp_path), code).collect()]
    assert found("F205") == ["a.csv"] and found("H501") == ["0.csv"] and found("X") == []


def test_cache_and_snapshot_round_trips(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    path = str(tmp_path / "cache")
    files.save_cache(spark.createDataFrame(rows, "source string, id int, v string"), path)
    files.save_cache(spark.createDataFrame([("b", 9, "new")], "source string, id int, v string"), path)
    assert sorted((r["source"], r["id"], r["v"]) for r in files.load_cache(spark, path).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 9, "new")]
    assert [r["v"] for r in files.cached(spark, path, "a", "id", [2, 9]).collect()] == ["y"]
    files.clear_cache(spark, path)
    assert files.load_cache(spark, path).count() == 0
    files.write_snapshot(spark.createDataFrame([(1, "p", "old")], "id int, a string, legacy string"), str(tmp_path / "s"))
    back = files.read_snapshot(spark, str(tmp_path / "s"), "id int, a string, legacy string, later double", ("legacy",))
    assert back.columns == ["id", "a", "later"] and tuple(back.first()) == (1, "p", None)
