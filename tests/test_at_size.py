"""Queries whose work must not gather in one task, grow with pairs of copies, or be interpreted."""

import math

import pytest
from pyspark.sql import functions as F

from estimark import catalog
from estimark.functions import prose as pr
from estimark.functions import scalars as sc
from estimark.operators import comps, normalise, rules, scoring

from conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["condo_fees", "portal_a_rentals", "portal_a_sales", "all_reasons", "station_names"])
def test_rows_are_dealt_out(spark, name):
    assert "RepartitionByExpression" in plan(catalog.QUERIES[name](spark, SF))


def test_condo_fee_binds_its_text_once(spark):
    text = F.concat(F.lit("Spese a parte 300. Un bel bilocale luminoso in pieno centro. Condominio "), F.col("id").cast("string"), F.lit(" euro annui, poi spese 50"))
    df = spark.range(5, 6).select(pr.condo_fee(text).alias("f"))
    assert df.first()["f"] == 50 and plan(df).count("Un bel bilocale") == 1
    many = " ".join(["Spese 5 euro, molto bello e luminoso, in una zona tranquilla e verde;"] * 50)
    rows = spark.createDataFrame([(0, many + " spese 90 euro"), (1, many), (2, None), (3, ""), (4, "spese ..")], "k int, t string").select("k", pr.condo_fee(F.col("t")).alias("f"))
    assert dict(rows.collect()) == {0: 90, 1: None, 2: None, 3: None, 4: None}


def test_portal_texts_that_are_no_json(spark):
    df = spark.createDataFrame([(0, '{"name":"A"}'), (1, "A"), (2, ""), (3, None), (4, "{A"), (5, ' {"name":"B"}'), (6, '{"x":1}')], "k int, t string")
    assert dict(df.select("k", normalise.within(F.col("t"), "$.name")).collect()) == dict(df.select("k", F.get_json_object("t", "$.name")).collect()) == {0: "A", 1: None, 2: None, 3: None, 4: None, 5: "B", 6: None}
    for name in ("portal_a_rentals", "portal_a_sales"):
        assert plan(catalog.QUERIES[name](spark, SF)).count("get_json_object") <= 6, name


def test_floors_bound_once(spark):
    floor, label = sc.parse_floor(F.concat(F.lit("S, "), F.col("id").cast("string")))
    df = spark.range(3, 4).select(floor.alias("n"), label.alias("l"))
    assert tuple(df.first()) == (-1, "Seminterrato") and plan(df).count("split(") <= 2


def test_reasons_are_compiled(spark):
    """Around a lambda Spark interprets whole expressions; the list of reasons has none."""
    df = catalog.QUERIES["all_reasons"](spark, SF)
    assert "array_sort" not in plan(df) and "sort_array" in plan(df)
    rows = spark.createDataFrame([(5, 0, "a"), (7, -1, "b"), (5, -2, "c"), (5, -3, "d")], "weight int, rank int, key string")
    one = rows.groupBy().agg(F.collect_list(F.struct("weight", "rank", "key")).alias("r")).select(F.concat("r", F.array(F.lit(None))).alias("r"))
    assert [x and x["key"] for x in one.select(*[x.alias(f"x{n}") for n, x in enumerate(scoring.weightiest(F.col("r"), 6))]).first()] == ["b", "a", "c", "d", None, None]


def test_radius_counts_by_place(spark):
    """20,000 rows of one place would be 400 million pairs; odd rows against brute force."""
    here = spark.range(20_000).select("id", F.lit(45.4).alias("lat"), F.lit(9.1).alias("lng")).unionByName(spark.createDataFrame([(-1, 45.401, 9.1), (-2, 46.0, 9.1), (-3, None, 9.1)], "id long, lat double, lng double"))
    got = {r["id"]: (r["n"], r["nearest_m"]) for r in comps.radius_counts(here, 2500).collect()}
    assert len(got) == 20_001 and got[0] == got[19_999] == (20_000, 0.0) and got[-1][0] == 20_000 and 100 < got[-1][1] < 120
    rows = [(k % 40, 45.4 + k % 40 % 7 * 0.01, 9.1 + k % 40 % 5 * 0.01) for k in range(60)]
    metres = lambda a, b: round(2 * 6_371_000.0 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)), 3)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and metres(a, b) <= 2500:
                n, least = want.get(a[0], (0, 1e9))
                want[a[0]] = (n + 1, min(least, metres(a, b)))
    got = {r["id"]: (r["n"], round(r["nearest_m"], 3)) for r in comps.radius_counts(spark.createDataFrame(rows, "id long, lat double, lng double"), 2500).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 0.002 for k in want)


def test_stations_asked_once_a_place(spark):
    stations = spark.createDataFrame([("m", 0, 45.46, 9.19, "Duomo", "M1")], "city string, ord int, lat double, lng double, name string, lines string")
    near = [(1, 45.46, 9.19, "m", 50, None, ""), (1, 45.46, 9.19, "m", 50, None, "M9"), (2, 45.46, 9.19, "m", 50, "Gate", None), (3, 45.46, 9.19, "m", None, None, ""), (4, 45.46, 9.19, None, 50, None, ""), (5, 45.47, 9.19, "m", 50, None, ""), (5, 45.47, 9.19, "m", 1050, None, "")]
    near = spark.createDataFrame(near, "id int, lat double, lng double, city string, distance_m int, name string, lines string")
    got = sorted(((r["id"], r["name"], r["lines"]) for r in rules.metro_names(near, stations).collect()), key=str)
    assert got == sorted([(1, "Duomo", "M1"), (1, None, "M9"), (2, "Gate", "M1"), (3, None, None), (4, None, None), (5, None, None), (5, "Duomo", "M1")], key=str)
