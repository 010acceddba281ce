"""Keyword indexes, ranks and bounded top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from estimark.operators import bands, digest, lookup, ranks


@pytest.mark.parametrize("small", [lookup.SMALL_TABLE, (0, 0)])
def test_keywords_by_automaton_and_by_index(spark, small):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    keywords = [(w, k, f"Z{k}") for k, w in enumerate({word(rng.randint(1, 6)) for _ in range(60)})] + [("AB", 90, "late"), ("", 91, "empty"), (None, 92, "none")]
    texts = [(k, word(rng.randint(0, 30)).upper()) for k in range(80)] + [(100, None), (101, ""), (102, "zzz"), (103, texts_long := "b" * 5000 + "aab")]
    got = {r["id"]: r["zone"] for r in lookup.keyword_zone(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(keywords, "keyword string, ord int, zone string"), small=small).collect()}
    want = {}
    for i, t in texts:
        hits = [(-len(w), o, z) for w, o, z in keywords if w and t is not None and w.lower() in t.lower()]
        want[i] = min(hits)[2] if hits else None
    assert got == want and texts_long


def test_keywords_of_an_empty_table(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    for small in (lookup.SMALL_TABLE, (-1, -1)):
        assert lookup.keyword_zone(texts, "t", spark.createDataFrame([], "keyword string, ord int, zone string"), fallback="F", small=small).first()["zone"] == "F"


def test_ranks_equal_windows(spark):
    """A hot key over several ranges, a null key, ties, null values."""
    rng = np.random.default_rng(2)
    rows = [(k, ["hot", "hot", "hot", "b", None][rng.integers(0, 5)], None if rng.random() < 0.05 else float(rng.integers(0, 60))) for k in range(1500)]
    rows += [(9000, "none", None), (9001, "one", 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = {r["id"]: r["share"] for r in ranks.share_up_to(df, "g", "x", "share").collect()}
    want = {r["id"]: r["share"] for r in df.where("x IS NOT NULL").withColumn("share", F.cume_dist().over(Window.partitionBy("g").orderBy("x"))).collect()}
    assert len(got) == len(rows) and all(got[i] == want.get(i) for i in got)
    hot = ranks.placed(df, "g", "x")
    assert hot.count() == df.where("x IS NOT NULL").select("g", "x").distinct().count()
    for share in (0.0, 0.5, 0.8, 1.0):
        at = {r["g"]: r["t"] for r in ranks.at_share(df, "g", "x", share, "t").collect()}
        for g in ("hot", "b", None, "one"):
            values = sorted(x for _, k, x in rows if k == g and x is not None)
            assert at[g] == values[min(int(len(values) * share), len(values) - 1)]
    assert ranks.share_up_to(df.where("false"), "g", "x", "s").count() == 0


@pytest.mark.parametrize("most", [10_000, 7])
def test_matches_of_parted_cities(spark, most):
    rng = random.Random(7)
    listings = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(500, 3000, 100)]), rng.choice([None, *range(20, 90)]), rng.choice([None, *range(0, 100, 7)]), rng.random() < 0.5, rng.choice([None, True, False])) for k in range(600)]
    rules = [(k, rng.choice(["hot", "b", "c", None]), rng.choice([None, 900, 2000]), rng.choice([None, 30, 70]), rng.choice([None, 0, 50, 99]), rng.choice([True, True, False, None])) for k in range(40)]
    got = digest.matches(spark.createDataFrame(rules, "rule_id int, city string, max_rent int, min_sqm int, min_score int, active boolean"), spark.createDataFrame(listings, "id long, city string, rent_mo int, sqm int, score_total int, is_new boolean, dropped boolean"), 12, most)
    want = []
    for rule, city, rent, sqm, score, active in rules:
        hit = [(-(s if s is not None else -1e9), i, s) for i, c, r, m, s, new, drop in listings if active and city is not None and c == city and (new or drop) and (rent is None or r is not None and r <= rent) and (sqm is None or m is not None and m >= sqm) and (score is None or s is not None and s >= score)]
        want += [(rule, i, s, n) for n, (_, i, s) in enumerate(sorted(hit, key=lambda h: h[:2])[:12], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_comparables_by_brute_force(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(300):
        placed = rng.random() < 0.9
        rows.append((i, float(rng.randint(5, 30)), rng.choice([None, 0, *range(30, 90)]), 45.4 + rng.randint(0, 40) / 300 if placed else None, 9.1 + rng.randint(0, 40) / 300 if placed else None, rng.choice(["a", "a", "b", None])))
    rows.append((999, None, 50, 45.4, 9.1, "a"))
    df = spark.createDataFrame(rows, "id long, psqm double, sqm int, lat double, lng double, zone string")
    got = {r["id"]: list(r["comp_ids"]) for r in bands.top_comparables(df, df, "zone", k, most=30).collect()}
    want = {}
    for i, p, s, y, x, z in rows:
        share = 0.15 if (s or 0) <= 50 else 0.20 if s <= 75 else 0.25
        near = []
        for j, q, m, v, u, w in rows:
            if p and q and z is not None and w == z and i != j and (not s or m and s * (1 - share) <= m <= s * (1 + share)):
                if y is None or v is None:
                    near.append((q, j))
                else:
                    a = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
                    near.append((round(2 * 6_371_000 * math.asin(math.sqrt(min(1, a))), 3), j))
        if near:
            want[i] = [j for _, j in sorted(near)[:k]]
    assert got == want and len(want) > 200
