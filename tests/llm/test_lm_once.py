"""The recurrent model numbers its documents once, and trains by plain Adam steps."""

import numpy as np
from pyspark.sql import functions as F

from estimark.llm import lm


def test_documents_are_scanned_once_for_words_and_blocks(spark):
    """Texts that differ from scan to scan: the counts and the blocks must be of one scan."""

    def texts(batches):
        import random

        for batch in batches:
            batch["text"] = [" ".join(f"w{random.randrange(10**9)}" for _ in range(random.randrange(5, 50))) for _ in batch["doc_id"]]
            yield batch

    docs = spark.range(300).select(F.col("id").alias("doc_id")).mapInPandas(texts, "doc_id long, text string")
    rows = lm.score(docs, F.col("doc_id") % 10 == 0).collect()
    assert len(rows) == 300 and all(np.isfinite(r["score"]) for r in rows)
    assert all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"])
    assert sum(r["n_tokens"] for r in rows if not r["held_out"]) == rows[0]["train_tokens"]


def test_training_takes_adam_steps(monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 5)
    rng = np.random.default_rng(2)
    model = lm.Model.fresh(np.arange(1, lm.ALL_CLASSES + 1), np.arange(1, lm.FREQUENT + 1))
    lengths = np.array([9, 4, 12, 7])
    ids, rate = rng.integers(0, lm.INPUTS, lengths.sum()).astype(np.int32), 0.02
    got = lm.train(model, ids, lengths, rate)
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    place, begins, going = lm.streams_of(lengths, 4)
    h, first, second = np.zeros((4, lm.HIDDEN)), {k: 0.0 for k in w}, {k: 0.0 for k in w}
    for step, at in enumerate(range(0, len(place), 5), 1):
        where = place[at : at + 5, : going[at]]
        live = where >= 0
        grad, _, h = lm.gradients(lm.Model(w), ids[np.maximum(where, 0)], begins[at : at + 5, : going[at]], live, h[: going[at]])
        grad = {k: v / live.sum() for k, v in grad.items()}
        scale = min(1.0, 1.0 / np.sqrt(sum((v * v).sum() for v in grad.values())))
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * scale * v
            second[k] = 0.99 * second[k] + 0.01 * (scale * v) ** 2
            w[k] = w[k] - rate * (1 - 0.9 * at / len(place)) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    # a step goes by the sign of a gradient, however small, so a few may differ by rounding
    far = np.concatenate([np.abs(got.w[k] - w[k]).ravel() for k in w]) > 1e-3
    assert far.mean() < 1e-3


def test_shares_far_out_of_range():
    z = np.array([[200.0, 199.0], [-300.0, -301.0], [0.0, 1.0]], np.float32)
    out, e, total = lm.log_shares(z, np.arange(3), np.array([0, 1, 1]))
    low = np.log(1 / (1 + np.exp([-1.0, 1.0, -1.0])))
    assert np.allclose(out, low, atol=1e-5) and np.allclose(e / total[:, None], 1 / (1 + np.exp([[-1, 1], [-1, 1], [1, -1]])), atol=1e-5)
