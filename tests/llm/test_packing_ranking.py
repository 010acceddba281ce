"""The ranking of a shard's index with all words against plain BM25."""

import math

import numpy as np

from estimark.llm.packing import B, K1, Index


def test_all_words_rank_as_plain_bm25():
    rng = np.random.default_rng(6)
    for n in (3, 40, 150):
        docs = [rng.zipf(1.4, rng.integers(0, 60)) % 50 for _ in range(n)]
        docs[1] = docs[0]  # copies
        codes, first = np.concatenate(docs).astype(np.int64), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        index = Index(codes, first, 50, terms=None, common=None)
        mean = max(1.0, np.mean([len(d) for d in docs]))
        df = np.array([sum(w in d for d in docs) for w in range(50)])
        for seed in range(n):
            unused = rng.random(n) < 0.8
            unused[seed] = False
            score = {}
            for d in np.flatnonzero(unused).tolist():
                shared = set(docs[seed].tolist()) & set(docs[d].tolist())
                if shared:
                    tf = {w: (docs[d] == w).sum() for w in shared}
                    score[d] = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(docs[d]) / mean)) for w in shared)
            got = list(index.neighbours(seed, unused))
            assert sorted(got) == sorted(score)
            ranked = [score[d] for d in got]
            assert all(a >= b - 1e-5 for a, b in zip(ranked, ranked[1:], strict=False))
