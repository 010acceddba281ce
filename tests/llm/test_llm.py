"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from estimark.llm import bpe, bwt, collision, grammar, langid, lm, near_vectors, ngram_join, packing, pii, suffix_dedup, toxicity
from estimark.llm.common import components, settled, written

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, runs string, block string, score string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [words(rng, rng.randint(0, 300), vocabulary) for _ in range(25)]
    out = [None, "", "   \n", "a" * 1200, "one", "x " * 3000, base[3], base[3], "It's 9 <|endoftext|>, é́ “ok”"]
    for _ in range(25):
        text = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "changed"
        out.append(" ".join(text))
        whole = rng.choice(base)
        at = rng.randint(0, max(0, len(whole) - 900))
        out.append(words(rng, 20, vocabulary) + whole[at : at + 700] + words(rng, 20, vocabulary))
    return base + out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "fr", None][k % 3], "s", len(t or ""), "r", "q", "b", "z") for k, t in enumerate(texts)]
    rows += [(None, "no id here", "en", None, None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (7, 7), (1, 9)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == {3: 3, 4: 3, 5: 3, 1: 1, 8: 1, 9: 1}


def test_tables_are_emptied(spark):
    kept = []

    def make():
        kept.append(written(spark.range(5)))
        return kept[0].where("id > 1")

    out = settled(make)
    again = lambda df: spark.read.parquet(os.path.dirname(df.inputFiles()[0]))
    assert out.count() == 3 and again(kept[0]).count() == 0 and again(kept[0]).columns == ["id"]
    first = written(spark.range(4))
    assert written(first.where("id > 0"), first).count() == 3 and again(first).count() == 0


def vectors(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 12))
    x[n // 2 :] = x[: n - n // 2] + 0.12 * rng.standard_normal((n - n // 2, 12))
    x[5] = x[6]
    x[20:27] = x[7]
    rows = [(k, [float(v) for v in row], k % 3) for k, row in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 12, 1), (1002, [float("nan")] + [1.0] * 11, 1), (1003, [None] + [1.0] * 11, 1), (1004, [float("inf")] * 12, None), (None, [1.0] * 12, 0), (1005, [], 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(near_vectors, "TILE_ROWS", 16)
    monkeypatch.setattr(near_vectors, "FAN_OUT", 2)
    x, df = vectors(spark)
    rows = near_vectors.near_duplicates(df, least=0.95).collect()
    assert len(rows) == df.count()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[k], *label[near[k]]]) for k in range(len(x))])
    for r in rows:
        if r["vec_id"] is not None and r["vec_id"] < len(x):
            assert (r["n_links"], r["component_id"], r["kept"]) == (near[r["vec_id"]].sum(), label[r["vec_id"]], label[r["vec_id"]] == r["vec_id"])
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(collision, "SHARD_ROWS", 100)
    x, df = vectors(spark)
    found = collision.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    ids = np.arange(len(x))
    usable = np.vstack([x])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = usable @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:10]
        got = [r for r in found if r["query_id"] == q]
        assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))
        assert all(abs(r["score"] - x[r["vec_id"]] @ x[q]) < 1e-9 for r in got)
        hits, total = hits + len({r["vec_id"] for r in got} & set(best.tolist())), total + 10
    assert hits / total >= 0.9
    assert not any(r["vec_id"] >= 1000 for r in found)
    assert collision.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bpe_round_trip(spark, docs, empty, texts):
    tok = Tokenizer.from_file(BPE)
    rows = bpe.encode_decode(docs, BPE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]] or "" if r["doc_id"] is not None else "no id here", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    digest = {r["doc_id"]: r for r in bpe.digests(docs, BPE).collect()}
    ids = tok.encode(texts[0], add_special_tokens=False).ids
    assert digest[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(empty, BPE).count() == 0


def test_packing(spark, docs, empty, texts):
    tok = Tokenizer.from_file(BPE)
    rows = packing.packed_pieces(docs, BPE).collect()
    once = Counter(r["doc_id"] for r in rows)
    for doc_id, text in enumerate(texts):
        if once[doc_id] > 1 and doc_id == 4:
            continue  # a repeated row
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes[r["sequence_id"]]
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= packing.SEQUENCE and sum(v < packing.SEQUENCE for v in sizes.values()) <= 4
    assert packing.packed_pieces(empty, BPE).count() == 0


def test_neighbours_share_words():
    codes = np.array([0, 1, 2, 0, 1, 3, 4, 5, 6, 4, 5, 7])
    index = packing.Index(codes, np.array([0, 3, 6, 9, 12]), 8)
    assert list(index.neighbours(0, np.array([False, True, True, True]))) == [1]
    assert list(index.neighbours(2, np.array([True, True, False, True]))) == [3]


def test_all_neighbours_come_best_first():
    # 200 documents share words 0..2 with the seed and have one of their own; document d repeats word 0
    docs = [[0, 1, 2]] + [[0] * (1 + d % 5) + [1, 2, 10 + d] for d in range(200)] + [[500 + d] for d in range(2000)]
    first = np.cumsum([0, *map(len, docs)])
    index = packing.Index(np.concatenate(docs), first, 3000)
    unused = np.ones(len(docs), bool)
    unused[0] = False
    found = list(index.neighbours(0, unused))
    assert sorted(found) == list(range(1, 201))
    weights = np.zeros(len(docs))
    for w in range(3):
        np.add.at(weights, index.posted[index.at[w] : index.at[w + 1]], index.weight[index.at[w] : index.at[w + 1]])
    assert all(weights[a] >= weights[b] - 1e-6 for a, b in zip(found[:-1], found[1:]))


def test_copies_are_neighbours_though_their_words_are_common():
    docs = [[d, 30, 31] for d in (0, 1)] + [[5, 6, 7, 8]] * 40 + [[9, 10, 11]] * 40
    index = packing.Index(np.concatenate(docs), np.cumsum([0, *map(len, docs)]), 32)
    unused = np.ones(len(docs), bool)
    unused[2] = False
    assert set(index.neighbours(2, unused)) == set(range(3, 42))


def test_more_ids_than_16_bits(monkeypatch):
    class Large:
        def get_vocab_size(self, with_added_tokens):
            return (1 << 16) + 1

    monkeypatch.setattr(bpe, "tokenizer", lambda path: Large())
    with pytest.raises(ValueError):
        bpe.encode_words([b"x"], "any")


def test_language_model_counts(spark, docs, empty, texts):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    rows = lm.score(docs, held).collect()
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), ""]
    count: Counter = Counter()
    for k, t in table:
        if not out(k):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens(texts[r["doc_id"]] if r["doc_id"] is not None else "no id here")
        base = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(own), sum(w in count for w in own), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and np.isfinite(r["score"]) and r["score"] < 0
    assert lm.score(empty, held).count() == 0


def test_state_is_carried_over_windows(monkeypatch):
    rng = np.random.default_rng(0)
    model = lm.Model.fresh(np.ones(lm.ALL_CLASSES), np.ones(lm.FREQUENT))
    model.w["uf"] += 0.5
    ids = rng.integers(0, lm.INPUTS, 500).astype(np.int32)
    lengths = np.array([300, 1, 150, 49])
    whole = lm.log_probabilities(model, ids, lengths)
    monkeypatch.setattr(lm, "SCORE_WINDOW", 7)
    assert np.allclose(whole, lm.log_probabilities(model, ids, lengths), atol=1e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    model = lm.Model.fresh(np.arange(1, lm.ALL_CLASSES + 1), np.arange(1, lm.FREQUENT + 1))
    model = lm.Model({k: v.astype(np.float64) + 0.3 * rng.standard_normal(v.shape) for k, v in model.w.items()})
    x = rng.choice([3, 70, 71, lm.FREQUENT + 1, lm.INPUTS - 1], (7, 4)).astype(np.int32)
    begin, live = rng.random((7, 4)) < 0.2, rng.random((7, 4)) < 0.9
    h = rng.standard_normal((4, lm.HIDDEN))
    loss = lambda: -lm.gradients(model, x, begin, live, h)[1].sum()
    grad = lm.gradients(model, x, begin, live, h)[0]
    for name, values in model.w.items():
        flat, own = values.reshape(-1), grad[name].reshape(-1)
        # a few of the places that the window touches, and some that it may not
        for at in [*np.argsort(-np.abs(own))[:6].tolist(), *rng.integers(0, len(flat), 6).tolist()]:
            was, eps = flat[at], 1e-5
            flat[at] = was + eps
            up = loss()
            flat[at] = was - eps
            down = loss()
            flat[at] = was
            assert abs((up - down) / (2 * eps) - own[at]) < 1e-5 * max(1, abs(own[at])), name


def test_training_helps_unseen_documents(spark):
    """Words follow one another by a rule, so the recurrent model must beat the counts."""
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        at, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{at}")
            at = (at * 7 + 3 + (rng.random() < 0.1)) % 40
        rows.append((k, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score(docs, F.col("doc_id") % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert found[0] > found[1] + 0.3 * found[2]


def test_probabilities_sum_to_one():
    model = lm.Model.fresh(np.arange(1, lm.ALL_CLASSES + 1), np.ones(lm.FREQUENT))
    h = np.repeat(np.random.default_rng(3).standard_normal((1, lm.HIDDEN)).astype(np.float32), lm.INPUTS, 0)
    assert abs(np.exp(model.outputs(h, np.arange(lm.INPUTS))).sum() - 1) < 1e-4


def shingled(text):
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_classes(table):
    sets = [shingled(t) for _, t in table]
    label, links = list(range(len(sets))), [0] * len(sets)

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups: dict = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(table[k][0])
    least = {root: min((d for d in ids if d is not None), default=None) for root, ids in groups.items()}
    return [(table[k][0], links[k], least[find(k)]) for k in range(len(sets))]


@pytest.mark.parametrize("bucket", [128, 4])
def test_chosen_path_join(spark, docs, empty, monkeypatch, bucket):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)  # 4: buckets split, and what stays large is compared in blocks
    monkeypatch.setattr(ngram_join, "TILE", 1024 if bucket == 128 else 3)
    rows = ngram_join.classes(docs).collect()
    want = jaccard_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in rows), key=key) == sorted(want, key=key)
    if bucket == 128:
        assert ngram_join.classes(empty).count() == 0
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert len(ids) == len({c for _, _, c in want})


def repeats_removed(bodies, length=400):
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length, merge", [(400, 1 << 20), (250, 1 << 20), (400, 3000), (250, 0)])
def test_repeated_bytes(spark, docs, empty, monkeypatch, length, merge):
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", merge)  # small: anchors are hot, level by level
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = repeats_removed([(t or "").encode() for _, t in table], length)
    rows = Counter(tuple(r) for r in suffix_dedup.removed(docs, length).collect())
    assert rows == Counter((d, *w) for (d, _), w in zip(table, want, strict=True))
    if length == 250:
        return
    assert suffix_dedup.removed(empty).count() == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 25").first()["text"] is None


def test_segments_that_share_an_anchor_alone(spark):
    """Two texts with a common string longer than an anchor and shorter than a window lose nothing."""
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    middle = own(200)
    docs = spark.createDataFrame([(k, own(500) + middle + own(500)) for k in range(6)], "doc_id long, text string")
    assert all((r["n_removed"], r["n_spans"]) == (0, 0) for r in suffix_dedup.removed(docs).collect())


def test_merged_transforms_give_common_prefixes():
    rng = np.random.default_rng(6)
    for shards in (1, 2, 3, 4):
        for _ in range(8):
            strings = [rng.integers(1, 4, rng.integers(0, 12)).tolist() for _ in range(14)]
            strings[3] = strings[9] = strings[2]
            shard = np.sort(rng.integers(0, shards, 14))
            got = bwt.common_prefixes(np.array([x for s in strings for x in [*s, 0]]), shard)
            suffixes = [s[k:] for s in strings for k in range(len(s) + 1)]
            for x, own in enumerate(suffixes):
                best = 0
                for y, other in enumerate(suffixes):
                    n = 0
                    while x != y and n < min(len(own), len(other)) and own[n] == other[n]:
                        n += 1
                    best = max(best, n)
                assert got[x] == best


def test_pseudonyms(spark, docs, empty):
    key = b"k"
    card = "4532 0151 1283 0366"
    new = pii.card(key, card)
    assert new != card and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", new) and pii.luhn(pii.digits_of(new)[:-1]) == int(new[-1])
    assert pii.card(key, "4532015112830367") is None
    assert pii.date(key, "2024-02-30") is None and re.fullmatch(r"\d{4}-\d\d-\d\d", pii.date(key, "2024-02-29"))
    iban = pii.iban(key, "DE89 3704 0044 0532 0130 00")
    assert iban != "DE89 3704 0044 0532 0130 00" and pii.iban(key, iban) is not None
    small = pii.Feistel(key, "t", 1000)
    assert sorted(small.permute(k) for k in range(1000)) == list(range(1000))
    rows = [(1, "call +1 (386) 555-3733 or +1 (386) 555-3733", "a"), (2, "x +1 (386) 555-3733, 10.20.30.40 a.b@mail.com born 12/05/1990", "b"), (3, None, None), (4, "", "c"), (5, "version 1.2.3 of 2020", "d")]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, extra string"), key).collect()}
    numbers = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1]["text"] + out[2]["text"])
    assert len(numbers) == 3 and len(set(numbers)) == 1 and "+1 (386) 555-3733" not in out[1]["text"]
    assert out[2]["pii"] == {"phone": 1, "ip": 1, "email": 1, "date": 1} and out[2]["extra"] == "b"
    assert (out[3]["text"], out[4]["text"], out[5]["text"]) == (None, "", "version 1.2.3 of 2020")
    assert pii.pseudonymise(empty, key).count() == 0 and pii.pseudonymise(docs, key, found=None).columns == docs.columns


def test_pseudonyms_link_equal_values():
    rng = random.Random(3)
    for _ in range(200):
        y, m, d = rng.randint(1950, 2050), rng.randint(1, 12), rng.randint(13, 28)
        iso = pii.date(b"k", f"{y}-{m:02d}-{d:02d}")
        assert "/".join(reversed(iso.split("-"))) == pii.date(b"k", f"{d:02d}/{m:02d}/{y}")
        month_first = pii.date(b"k", f"{m:02d}/{d:02d}/{y}").split("/")
        assert [month_first[2], month_first[0], month_first[1]] == iso.split("-")
    one, other = pii.phone(b"k", "+1 386 555 3733"), pii.phone(b"k", "386-555-3733")
    assert pii.digits_of(one)[1:] == pii.digits_of(other) and one.startswith("+1 ")
    days = {pii.date(b"k", f"2024-{m:02d}-{d:02d}") for m in range(1, 13) for d in range(1, 29)}
    assert len(days) == 12 * 28
    a, b = pii.email(b"k", "ann.bee@firm.example.org"), pii.email(b"k", "joe@firm.example.org")
    assert a.endswith(".org") and "firm" not in a and a.split("@")[1] == b.split("@")[1] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.org", a)
    assert pii.date(b"k", "2024-02-29") != pii.date(b"other", "2024-02-29")


def test_pseudonyms_need_a_key(spark, docs):
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"")
    spark.conf.set(pii.KEY_SETTING, "secret")
    assert pii.key_of(spark) == b"secret"
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.key_of(spark) != pii.key_of(spark)


def kinds(*symbols):
    return [s for s in grammar.CLAUSE.best(list(symbols))[1] if s in grammar.GROUPS]


def test_grammar():
    assert kinds("o", "i") == ["i"] and kinds("t", "o", "i") == ["d"] and kinds("t", "o", "o", "o", "o", "i") == ["i"]
    assert kinds("x", "i") == ["I"] and kinds("p", "o", "b") == ["I"] and kinds("p", "o", "o", "b") == [] and kinds("b") == [] and kinds("t", "p", "o", "b") == ["d"]
    assert kinds("h") == ["h"] and kinds("m", "o", "h") == ["H"] and kinds("m", "t", "f") == ["D"] and kinds("f") == [] and kinds("m", "n", "h") == ["N"]
    assert kinds("i", "o", "t") == ["d"] and kinds("i", "o", "o", "o", "t") == ["i"] and kinds("h", "t") == ["D"]
    assert kinds("n", "i") == ["N"] and kinds("r", "o", "t", "i") == ["R"] and kinds("n", "r", "i") == ["N"] and kinds("r", "i", *"o" * 9, "i") == ["R", "i"]


def test_grammar_takes_the_heaviest_of_all_paths():
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice(grammar.CLASSES) for _ in range(rng.randint(1, 9))]
        weight, written, arcs = grammar.CLAUSE.best(symbols)
        every = grammar.CLAUSE.paths(symbols)
        assert abs(weight - max(w for w, _ in every)) < 1e-9 and abs(sum(arcs) - weight) < 1e-9
        assert any(outs == written and abs(w - weight) < 1e-9 for w, outs in every)


def test_what_lies_beyond_the_grammars_reach_changes_nothing():
    rng = random.Random(6)
    for _ in range(100):
        near = [rng.choice("oonrtxpm") for _ in range(toxicity.REACH)]
        far = [rng.choice("nrtxpm") for _ in range(5)]
        whole, cut = grammar.CLAUSE.best([*far, *near, "i"]), grammar.CLAUSE.best([*near, "i"])
        assert (whole[1][-1], round(whole[2][-1], 9)) == (cut[1][-1], round(cut[2][-1], 9))


def test_clauses_cover_attacks_once():
    # runs 0..99 of one document, attacks at 10, 12 and 80, a stop at 11
    spans = list(toxicity.clauses(np.array([10, 12, 80]), 0, 100, np.array([11]), np.arange(1, 101)))
    assert spans[0][1] == 12 and spans[1][0] == 12 and len(spans) == 3 and spans[2][0] > spans[1][1]


def labelled(spark, n=400):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        text, toxic = words(rng, rng.randint(5, 60), vocabulary), k % 5 == 0
        if toxic:
            text += " " + rng.choice(["zorgax", "zorgiu", "you moron"]) + rng.choice(["", ", en"]) + " " + words(rng, 5, vocabulary)
        rows.append((k, text))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, empty):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels.where(toxicity.fold(5) != 0))
    rows = toxicity.score(docs, model).join(labels, "doc_id", "left").where(toxicity.fold(5) == 0).collect()
    assert rows and all(r["predicted"] == r["toxic"] for r in rows if r["toxic"] is not None)
    glued = "dies\u00a0ist\u00a0" * 60 + "zorgax" + "\u00a0lang" * 60  # one run of over 200 bytes
    hard = spark.createDataFrame([(1, "ruhig " + glued), (2, "ruhig " + glued.replace("zorgax", "leise")), (3, "a" * 200_000)], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(hard, model).orderBy("doc_id").collect()] == [1, 0, 0]
    odd = toxicity.score(docs.where("doc_id >= 400"), model).collect()
    assert len(odd) == 2 and all(r["predicted"] == 0 for r in odd)
    untaught = toxicity.learn(empty, labels.limit(0))
    assert toxicity.score(docs, untaught).count() == 402


def test_language_models(spark, empty):
    rng = random.Random(9)
    syllables = {"x": ["ka", "ri", "to", "mu", "an"], "y": ["sch", "ein", "ung", "ber", "te"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[s]) for _ in range(3)) for _ in range(rng.randint(3, 40))), s) for k in range(200) for s in ["xy"[k % 2]]]
    rows += [(900, None, "x"), (901, "123 !!", "y"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs.where("doc_id % 4 <> 2"))).collect()}
    assert all(found[k]["lang_pred"] == "xy"[k % 2] for k in range(200)) and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (900, 901, 902))
    assert langid.predict(docs, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    other = [" ".join("".join(rng.choice("klmnopqrs") for _ in range(6)) for _ in range(150)) for _ in range(2)]  # else the two are alike
    more = spark.createDataFrame([(5000, "you are a worthless idiot, " + "you stupid moron", "en", "s", 1, "r", "q", "b", "z"), (5001, "first " + passage + " end " + other[0], "en", "s", 1, "r", "q", "b", "z"), (5002, other[1] + passage + "; card 4532015112830366", "en", "s", 1, "r", "q", "b", "z")], DOCS)
    stage = docs.unionByName(more)
    kept = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        function(spark, stage, str(tmp_path)).write.parquet(path)
        stage = spark.read.parquet(path)
        assert stage.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in stage.collect()})
    toxic, single, cut, private = kept
    assert 5000 not in toxic and set(range(len(texts))) <= set(toxic)
    assert len(single) < len(toxic)
    assert passage[50:450] in single[5001] and passage[:450] not in cut[5001] + cut[5002] and passage[200:300] not in cut[5001] + cut[5002]
    assert other[0] in cut[5001] and other[1] in cut[5002]
    assert "4532015112830366" in cut[5002] and "4532015112830366" not in private[5002]
    assert corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path)).count() >= len(private)
