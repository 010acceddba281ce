"""The recurrent model's streams end together, its windows share arrays, and scores stay with their documents."""

import numpy as np
from pyspark.sql import functions as F

from estimark.llm import lm


def test_streams_end_together():
    lengths = np.random.default_rng(1).lognormal(5.6, 1.1, 4000).astype(np.int64) + 1
    for n in (128, 256):
        place, begins, going = lm.streams_of(lengths, n)
        assert len(place) <= 1.02 * max(lengths.max(), lengths.sum() / n)
        # each token once, each document in one piece, steps without gaps
        assert sorted(place[place >= 0].tolist()) == list(range(lengths.sum()))
        assert begins.sum() == len(lengths) and (going == (place >= 0).sum(1)).all()
        within = (place[1:] >= 0) & ~begins[1:]
        assert (place[1:][within] == place[:-1][within] + 1).all()


def test_windows_share_their_arrays(monkeypatch):
    model = lm.Model.fresh(np.arange(1, lm.ALL_CLASSES + 1), np.arange(1, lm.FREQUENT + 1))
    held, gates = [], lm.Model.gates

    def spy(self, h, af, ag, uf, f, r, g):
        held.append((f, g))  # kept, so that no array's memory is given out again
        return gates(self, h, af, ag, uf, f, r, g)

    monkeypatch.setattr(lm.Model, "gates", spy)
    ids = np.random.default_rng(2).integers(0, lm.INPUTS, 4 * 5 * lm.WINDOW).astype(np.int32)
    lm.train(model, ids, np.full(4, 5 * lm.WINDOW), 0.01)
    assert len(held) == 5 * lm.WINDOW
    assert len({f.ctypes.data for f, _ in held}) == len({g.ctypes.data for _, g in held}) == lm.WINDOW


def test_scores_stay_with_their_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 400)
    monkeypatch.setattr(lm, "fit", lambda coded, model: model)
    docs = spark.createDataFrame([(k, " ".join(["w"] * (60 if k % 4 == 0 else 3))) for k in range(40)], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 10 == 0).collect()}
    assert sorted(rows) == list(range(40)) and all(rows[k]["n_tokens"] == (61 if k % 4 == 0 else 4) for k in rows)
    # equal texts have equal scores, and keep their documents' ids
    for k in rows:
        assert abs(rows[k]["score"] - rows[k % 4]["score"]) < 1e-3 * abs(rows[k]["score"])
    assert rows[0]["score"] < rows[1]["score"]
