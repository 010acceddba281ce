"""Sets of a large bucket go on by what they share with other sets, not by all that they sample."""

import random

from estimark.llm import ngram_join


def test_large_buckets_are_split_by_shared_samples_alone(spark, monkeypatch):
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n))
    passage = own(50)
    rows = [(k, f"{own(40)} {passage} {own(40)}") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 60, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    write, alone = ngram_join.written, []

    def counted(df, *spent):
        out = write(df, *spent)
        if set(out.columns) == {"set", "least", "run", "path"}:
            alone.append(out.groupBy("path").count().where("count = 1").count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.classes(docs).collect()}
    twins = {k: (1, k % 100) for k, _ in rows if k >= 100 or k % 6 == 0}
    assert got == {k: twins.get(k, (0, k)) for k, _ in rows}
    assert alone and max(alone) <= 10
