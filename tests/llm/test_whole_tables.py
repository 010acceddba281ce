"""Operators on a whole table of the given data against brute force, and the recurrent model's score
against a sum token by token."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from estimark.llm import lm, queries

SF = "/root/testdata/sf0.01"
#: Shingles are of words whose letters A to Z are lower-cased.
LOW = {k: k + 32 for k in range(65, 91)}


def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_ngram_join_of_a_whole_table(spark):
    """Every link of at least 0.8 between documents, found by an index of all shingles."""
    sets = {}
    for d, t in texts(spark):
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        sets[d] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    shared = Counter((a, b) for ids in index.values() if 1 < len(ids) for i, a in enumerate(ids) for b in ids[i + 1 :])
    links, root = Counter(), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in queries.op5_ngram_join(spark, SF).collect()}
    want = {d: (links[d], find(d)) for d in sets}
    assert sum(links.values()) > 100
    assert got == want


def test_suffix_dedup_of_a_whole_table(spark):
    docs = [(d, t.encode()) for d, t in texts(spark)]
    seen = Counter(hash(b[k : k + 400]) for _, b in docs for k in range(len(b) - 399))
    want = {}
    for d, b in docs:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        hit = np.cumsum(gone)[: len(b)] > 0
        spans = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(b) else 0
        want[d] = (len(b), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_suffix_dedup(spark, SF).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_nearest_recall_of_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = defaultdict(list)
    for r in queries.op6_nearest(spark, SF).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        got = sorted(found[int(ids[q])])
        assert [r for r, _, _ in got] == list(range(1, 21)) and all(abs(s - x[ids == v][0] @ x[q]) < 1e-9 for _, v, s in got)
        hits, total = hits + len(best & {v for _, v, _ in got}), total + 20
    assert hits / total >= 0.95


def test_scores_are_sums_token_by_token():
    rng = np.random.default_rng(4)
    model = lm.Model.fresh(rng.integers(1, 50, lm.ALL_CLASSES).astype(float), rng.integers(0, 9, lm.FREQUENT).astype(float))
    for w in model.w.values():
        w += (rng.standard_normal(w.shape) * 0.2).astype(np.float32)
    w = {k: v.astype(float) for k, v in model.w.items()}
    softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    lengths = np.array([1, 40, 3, 75])
    ids = rng.integers(0, lm.INPUTS, lengths.sum()).astype(np.int32)
    want, at = [], 0
    for n in lengths:
        h = np.zeros(lm.HIDDEN)
        for i in ids[at : at + n]:
            c = i // lm.CLASS_SIZE if i < lm.FREQUENT else i - lm.FREQUENT + lm.CLASSES
            p = softmax(h @ w["wc"] + w["bc"])[c]
            if i < lm.FREQUENT:
                p += softmax(h @ w["ww"][c] + w["bw"][c])[i - c * lm.CLASS_SIZE]
            want.append(p)
            a = w["inputs"][i]
            f = 1 / (1 + np.exp(-(a[: lm.HIDDEN] + h @ w["uf"])))
            g = np.tanh(a[lm.HIDDEN :] + (f * h) @ w["ug"])
            h = h + f * (g - h)
        at += n
    assert np.allclose(lm.log_probabilities(model, ids, lengths), want, atol=2e-3)
