"""Rejection on held-out documents, on what is no known language, and its spread by length."""

import random

import numpy as np
from pyspark.sql import functions as F

from estimark.llm import langid, queries


def test_few_held_out_documents_are_rejected(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.op8_language(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(out) > 200 and all(r["lang_pred"] == truth[r["doc_id"]] for r in out if truth[r["doc_id"]] is not None)
    assert sum(r["rejected"] for r in out) <= 0.025 * len(out)


def test_no_language_is_rejected(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    odd = [(k, " ".join("".join(rng.choice("qwxzkjvbcdfg") for _ in range(rng.randint(3, 9))) for _ in range(40 + 20 * k))) for k in range(30)]
    got = langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert sum(r["rejected"] for r in got) >= 29 and all(r["score"] <= 0.5 for r in got if r["rejected"])
    assert all(not r["rejected"] for r in langid.predict(docs.select("doc_id", "text").where(F.col("text") == ""), model).collect())


def test_spread_falls_with_length():
    rng = np.random.default_rng(2)
    chars = rng.integers(20, 20_000, 4000).astype(float)
    h = 2 + rng.standard_normal(4000) * np.sqrt(0.001 + 3 / chars)
    middle, a, b, limit = langid.calibrated(h, chars)
    assert abs(middle - 2) < 0.02 and 0.0005 < a < 0.002 and 2 < b < 4 and 2.2 < limit < 3.2
    over = (h - middle) / np.sqrt(a + b / chars) > limit
    assert over.mean() <= 0.005 and over[chars < 1000].mean() < 0.02
    assert langid.calibrated(np.array([1.0]), np.array([5.0]))[0] == 1.0


def test_ties_go_to_the_first_language(spark):
    rows = [(k, "aba cdc aba efe", "yy" if k % 2 else "xx") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs)).collect()} == {"xx"}
