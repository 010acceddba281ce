"""What the pipeline's first stage sends to Python."""

import corpus_pipeline
from estimark.llm import toxicity


def test_not_toxic_sends_each_text_once(spark, tmp_path, monkeypatch):
    rows = [(1, "you are a complete idiot and a total moron", "en", 9), (2, "a quiet day by the sea", None, 7), (2, None, "de", 3), (None, "", "de", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score int")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sent, score = [], toxicity.score

    def spy(rows, *rest):
        sent.append(rows)
        return score(rows, *rest)

    monkeypatch.setattr(toxicity, "score", spy)
    found = corpus_pipeline.not_toxic(spark, docs, str(tmp_path))
    assert found.schema == docs.schema
    kept = sorted(map(tuple, found.collect()), key=str)
    assert kept == sorted([r for r in rows if r[0] != 1], key=str)
    kinds = dict(sent[0].dtypes)
    assert kinds["text"] == "string" and not [k for k, t in kinds.items() if k != "text" and "text:string" in t]
