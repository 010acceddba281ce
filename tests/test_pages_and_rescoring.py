"""Odd pages, incremental re-scores, slugs, slim rows."""

import re
import unicodedata
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from estimark import catalog
from estimark.functions import scalars as sc
from estimark.operators import pages as pg
from estimark.operators import rescoring, rules
from estimark.settings import Settings
from estimark.sources import files
from estimark.sources.stored import StoredTable


def test_lists_in_odd_pages(spark):
    ld = lambda body, kind="application/ld+json": f"<html><SCRIPT data-x=1 TYPE='{kind}'>{body}</script>"
    rows = [
        (1, ld('{"itemListElement":[{"item":{"url":"https://x/a/1/","name":"N","offers":{"price":0},"price":"5","address":{"streetAddress":"Via"},"geo":{"latitude":45.5,"longitude":"9.1"}}},{"url":"x","price":7.5,"address":"Corso","geo":null}]}')),
        (2, ld('{"@type":"Other"}')), (3, ld("{broken")), (4, "<html>no script"), (5, None), (6, ""), (7, ld("[]")), (8, ld('{"itemListElement":[]}')), (9, ld('{"itemListElement":[{}]}', "text/plain")),
        (10, ld('{"itemListElement":[{}]}') + ld('{"itemListElement":[{"name":"second"}]}')),
    ]
    got = pg.item_list(spark.createDataFrame(rows, "k int, html string"), "html", ["k"])
    out = sorted(tuple(r[c] for c in ("k", "item_no", "id", "title", "price_text", "address", "latitude", "longitude")) for r in got.collect())
    assert out == [(1, 0, "1", "N", "5", "Via", "45.5", "9.1"), (1, 1, "x", "", "7.5", "Corso", "", ""), (10, 0, "", "", "", "", "", ""), (10, 0, "", "second", "", "", "", "")]


def test_details_of_odd_pages(spark):
    page = lambda estate: f'<script id="data">{{"e":{estate}}}</script>'
    rows = [
        (1, page('{"properties":[{"surface":"130 m²","rooms":"3","floor":{"value":"2","abbreviation":"2"},"condition":{"value":"Buono"},"elevator":null,"hasElevator":"si","hasBalcony":"no","features":[{"type":"GARAGE"}]}],"price":{"value":1200.7}}')),
        (2, page('{"properties":[]}')), (3, page('{"typology":{"name":" Attico "},"furnished":1,"features":[{"label":"Ampio Giardino"}]}')), (4, page("null")), (5, "x"), (6, None),
        (7, page('{"properties":[{"surface":"","surfaceValue":80,"floor":"3","ga4Condition":"","condition":"Nuovo","elevator":false,"balcony":"","terrace":0,"parking":"null","box":1}]}')),
    ]
    got = {r["k"]: r for r in pg.details_a(spark.createDataFrame(rows, "k int, html string"), "html", "data", "$.e", ["k"]).collect()}
    pick = lambda k, *names: tuple(got[k][n] for n in names)
    names = ("sqm", "price", "rooms", "floor_n", "floor_label", "condition", "elevator", "has_balcony", "has_parking", "furnished")
    assert pick(1, *names) == (130, 1200, 3, 2, "2", "buono", True, False, True, None)
    assert pick(2, *names) == (None, None, None, None, "", "", None, None, None, None) and got[2]["address"] == ""
    assert pick(3, "condition", "furnished", "has_balcony") == ("attico", True, True)
    assert pick(7, *names) == (80, None, None, None, "", "nuovo", False, False, True, None)
    assert set(got) <= {1, 2, 3, 4, 7}


def test_slugs_by_decomposition(spark):
    def want(name):
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().strip()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")

    names = ["Città Studi", "Porta Venezia", "Łódź", "ﬁne ½ №5 ㎡ ⑩ 𝐀𝐁", "Őbuda–ş", "straße", "...", "", "été"] + ["".join(map(chr, range(k, k + 700))) for k in range(0x80, 0x3400, 700)]
    df = spark.createDataFrame([*enumerate(names), (-1, None)], "i int, t string")
    assert {r["i"]: r["s"] for r in df.select("i", sc.slug(F.col("t")).alias("s")).collect()} == {-1: None, **{i: want(n) for i, n in enumerate(names)}}


def test_slim_structs_and_maps(spark):
    df = spark.sql("SELECT 1 AS id, map() AS m, named_struct('a', CAST(NULL AS INT)) AS s, named_struct('a', 0) AS z, map('k', 1) AS full")
    assert files.slim(df).first().asDict(recursive=True) == {"id": 1, "m": None, "s": None, "z": {"a": 0}, "full": {"k": 1}}


def test_rescoring_equals_a_full_one(spark, tmp_path):
    listings = spark.range(400).select(F.col("id"), F.concat(F.lit("z"), F.col("id") % 37).alias("zone"), (10 + F.col("id") % 23).cast("double").alias("psqm"))
    old = spark.createDataFrame([(f"z{k}", 15.0 + k % 5) for k in range(30)], "zone string, mid double")
    new = old.where("zone <> 'z4'").withColumn("mid", F.when(F.col("zone") == "z3", 99.0).otherwise(F.col("mid"))).unionByName(spark.createDataFrame([("z36", 12.0)], old.schema))
    score = lambda mids: lambda rows: rows.drop("score").join(mids, "zone", "left").withColumn("score", rules.simple_score(F.lit(50.0), (F.col("psqm") - F.col("mid")) / F.col("mid"), False)).select("id", "zone", "psqm", "score")
    table = StoredTable(spark, str(tmp_path / "t"), "id", 32, by="zone")
    table.upsert(score(old)(listings))
    before = table.manifest().folders
    changed = rescoring.changed_keys(old, new, "zone")
    assert sorted(r["zone"] for r in changed.collect()) == ["z3", "z36", "z4"]
    rescoring.rescore(table, changed, score(new))
    everything = lambda df: sorted(map(tuple, df.select("id", "zone", "score").collect()))
    assert everything(table.read()) == everything(score(new)(listings))
    after = table.manifest().folders
    assert 0 < len([b for b in after if after[b] != before[b]]) <= 3
    assert rescoring.rescore(table, changed.where("false"), score(new)) == table.manifest().version == 2


def test_settings_reach(spark):
    rows = spark.createDataFrame([(1, 10, 50, 400), (2, 45, 50, 900), (3, 90, None, None)], "id int, days_on_market int, sqm int, metro_m int").withColumn("rooms", F.lit(2))
    reached = lambda **new: sorted(r["id"] for r in rows.where(rescoring.reached(Settings(), Settings(**new))).collect())
    assert reached() == [] and reached(penalty_dom_stale=40) == [2, 3] and reached(gem_metro_max_m=1000) == [2] and reached(w_price=0.5) == [1, 2, 3] and reached(euro_impact_small=1) == [1, 2]


def test_page_queries_with_quoted_titles(spark, tmp_path):
    """Entities that the SQL leaves as they stand: the queries follow it, the operator reads them all."""
    page = '<html lang="en"><head><title>{0}</title></head><body><h1>{0}</h1><p>x</p><a href="/a">{0}</a></body></html>'
    said = "it&#39;s a &quot;b&quot; &lt;c&gt; &amp;lt; d&nbsp;e &copy; &middot;"
    rows = [(k, f"/{k}", page.format(text)) for k, text in enumerate((said, 'token = "x"', "&quot;", "plain"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("page_parts", "page_links", "page_item_list", "page_details", "page_texts"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        ours = Counter(tuple(map(str, row)) for row in df.select(sorted(df.columns)).collect())
        assert ours == Counter(tuple(map(str, row)) for row in con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), name
    read = spark.range(1).select(pg.plain(F.lit(said)).alias("t")).first()["t"]
    assert read == "it's a \"b\" <c> &lt; d e © ·"
