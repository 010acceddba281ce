"""Queries on texts look past the beginnings of the texts."""

from estimark.plans import texts


def test_distance_late_in_the_text(spark, tmp_path):
    far = "parola " * 60
    rows = [(13, far + "a 8 km da Milano", "es"), (14, "parola " * 300 + "a 8 km da Milano", "es"), (15, far, "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["reason"] for r in texts.misrep_distance(spark, str(tmp_path)).collect()} == {13: "distance:8", 14: None, 15: None}


def test_auctions_late_in_the_text(spark, tmp_path):
    far = "parola " * 200
    rows = [(11, far + "asta giudiziaria", "es"), (12, far + "usufrutto", "es"), (13, far + "cióníasta", "es"), (18, far, "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["is_auction"], r["is_nuda"]) for r in texts.auction_regex(spark, str(tmp_path)).collect()} == {11: (True, False), 12: (False, True), 13: (False, False), 18: (False, False)}
