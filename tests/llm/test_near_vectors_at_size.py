"""Pairs of blocks of vectors must not go through a shuffle, and what is skipped must not hold links."""

import numpy as np

from estimark.llm import near_vectors


def links(x, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def test_shuffles_grow_with_vectors_not_with_pairs_of_blocks(spark, monkeypatch):
    """2,000 vectors in 16 blocks or more: 136 pairs of blocks hold 8.5 times the vectors and more on either side."""
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 64)
    n, d = 2000, 64
    x = np.random.default_rng(4).standard_normal((n, d)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[0] + 0.1 * x[n // 2 : n // 2 + 40]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    store = spark.sparkContext._jsc.sc().statusStore()
    wrote = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = wrote()
    rows = near_vectors.near_duplicates(df).collect()
    assert wrote() - before < 4 * n * (4 * d + 40)
    near = links(x, 0.95)
    assert {r["vec_id"]: r["n_links"] for r in rows} == dict(enumerate(near.sum(1))) and near.sum() > 0


def test_blocks_link_as_all_pairs_do(monkeypatch):
    """Vectors in a cone, on a plane, opposite to each other, a long chain, and groups of alike ones, in blocks of any cut."""
    monkeypatch.setattr(near_vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(near_vectors, "AT_ONCE", 50)
    monkeypatch.setattr(near_vectors, "TILES_AT_ONCE", 5)
    rng = np.random.default_rng(6)
    turn = np.linspace(0, 6, 200)
    cases = [rng.standard_normal((200, 40)) + 2, np.stack([np.cos(turn), np.sin(turn)], 1), np.concatenate([z := rng.standard_normal((100, 33)), -z]), rng.standard_normal((5, 48))[rng.integers(0, 5, 200)] + 0.15 * rng.standard_normal((200, 48)), np.eye(50)[rng.integers(0, 50, 200)], rng.standard_normal((200, 1))]
    for x in cases:
        x = x.astype(np.float32)
        axes = np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, ::-1][:, :10]
        blocks, w = [], rng.integers(1, 4, len(x))
        for part in (slice(0, 120), slice(120, 200)):
            order, tiles = near_vectors.in_tiles(near_vectors.units(x[part]))
            assert sorted(order) == list(range(len(order))) and tiles[0] == 0 and (np.diff(tiles) > 0).all()
            blocks.append((near_vectors.Block.of(x[part][order], tiles, w[part][order], axes), part.start + order))
        near, count, label = links(x, 0.95), np.zeros(len(x), int), np.arange(len(x))
        for a, b in ((0, 0), (1, 1), (0, 1)):
            (p, at), (q, to) = blocks[a], blocks[b]
            got, root = near_vectors.block_links(p, q, a == b, 0.95)
            name = at if a == b else np.concatenate([at, to])
            np.add.at(count, name, got)
            label = near_vectors.spanning(np.concatenate([np.arange(len(x)), name]), np.concatenate([label, name[root]]), len(x))
        assert (count == near @ w).all()
        assert (label == near_vectors.spanning(*np.nonzero(near), len(x))).all()
