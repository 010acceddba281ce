"""The recurrent model learns from every training document, by the corpus counts."""

import numpy as np
from pyspark.sql import functions as F

from estimark.llm import lm


def test_all_training_documents_train(spark, monkeypatch, tmp_path):
    n = 4000
    monkeypatch.setattr(lm, "WORKER_DOCS", 900)
    # w<k> is a frequent word; a rare word is in two documents far apart, so seen twice in the corpus
    rows = [(k, f"w{k % 2500} w{k % 2500} r{k % 2000}" if k % 10 else "held", "x") for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents")
    seen = []
    monkeypatch.setattr(lm, "fit", lambda coded, model, *rest: seen.append(coded.collect()) or model)
    out = lm.score(spark.read.parquet(f"{tmp_path}/documents"), F.col("doc_id") % 10 == 0)
    assert out.count() == n and out.where("held_out").count() == n // 10
    (taught,) = seen
    assert len(taught) == n - n // 10
    assert len({r["worker"] for r in taught}) == len(lm.RATES) * round(len(taught) / lm.WORKER_DOCS)
    ids = [np.frombuffer(bytes(r["ids"]), np.int16) for r in taught]
    assert {len(x) for x in ids} == {4}
    assert max(int(x.max()) for x in ids) < lm.FREQUENT + lm.ENDINGS  # no word of the corpus is "seen once"
