"""The queries of the subpackage on tables of their own: columns, types, folds, whole texts."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from estimark.llm import langid, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with a very long text, empty ones, nulls, copies and a repeated id, with extra columns
    named as results are; embeddings with ties."""
    out = tmp_path_factory.mktemp("tables")
    rng = random.Random(2)
    syllables = {"x": ["ka", "ri", "to", "mu", "an"], "y": ["sch", "ein", "ung", "ber", "te"]}
    text = lambda s, n: " ".join("".join(rng.choice(syllables[s]) for _ in range(3)) for _ in range(n))
    rows = [(k, text("xy"[k % 2], rng.randint(20, 60)), "xy"[k % 2]) for k in range(120)]
    rows += [(200, text("x", 30_000), "x"), (201, None, "y"), (202, "", None), (203, "a" * 60_000, "x"), (204, rows[3][1], "y"), (3, rows[3][1], "y"), (205, "mail ann@firm.org on 2024-05-06, card 4532 0151 1283 0366", "x")]
    rows = [(*r, "s", len(r[1] or ""), 0.5, "q", 7) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, at int").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    x = np.random.default_rng(1).standard_normal((100, 8)).round(1)
    x[50:60] = x[40]
    vectors = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)] + [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return str(out), {(r[0], r[1]): r for r in rows}, [r[:3] for r in rows], x


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


CONTRACTS = {
    "op1_near_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_recurrent_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def test_contracts_and_folds(spark, tables):
    sf, _, rows, _ = tables
    for name, columns in CONTRACTS.items():
        df = queries.QUERIES[name](spark, sf)
        assert {k: v for k, v in df.dtypes if k in columns} == columns, name
        if "held_out" in columns:
            parts, out = {"op2": (10, 0), "op7": (5, 0), "op8": (4, 2)}[name.split("_")[0]]
            got = df.collect()
            assert len(got) == len(rows) and all(r["held_out"] == (fold(r["doc_id"], parts) == out) for r in got)
            if "score" in columns and name != "op2_recurrent_lm":
                assert all(0 <= r["score"] <= 1 for r in got)
    langs = {r["doc_id"]: r["lang_pred"] for r in queries.op8_language(spark, sf).collect()}
    assert langs[200] == "x" and langs[201] == langs[202] == "und" and all(langs[k] == "xy"[k % 2] for k in range(120))


def test_near_vectors_equal_their_sql(spark, tables):
    sf = tables[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLE_SQL["op1_near_vectors"])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in names) for r in queries.op1_near_vectors(spark, sf).collect()) == sorted(cursor.fetchall())


def test_nearest_takes_ties_in_order(spark, tables):
    sf, _, _, x = tables
    x = x.astype(np.float32).astype(float)
    found: dict = {}
    for r in queries.op6_nearest(spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [0, 20, 40, 60, 80]
    for q, rows in found.items():
        score = x @ x[q]
        want = [k for k in np.lexsort((np.arange(100), -score)) if k != q][:20]
        assert [v for _, v, _ in sorted(rows)] == want and all(abs(s - score[v]) < 1e-9 for _, v, s in rows)


def test_very_long_texts_are_whole(spark, tables):
    sf, _, rows, _ = tables
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = {k: t for k, t, _ in rows if k in (200, 203)}
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, sf).collect()}
    pieces: dict = {}
    for r in queries.op4_packing(spark, sf).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    gone = {r["doc_id"]: r for r in queries.op9_suffix_dedup(spark, sf).collect()}
    for k, t in long.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert sum(r["length"] for r in pieces[k]) == len(ids) + 1 and gone[k]["n_bytes"] == len(t)
    assert (gone[203]["n_removed"], gone[203]["n_spans"]) == (60_000, 1)


def test_pseudonyms_query(spark, tables):
    sf, _, rows, _ = tables
    got = [(r["doc_id"], r["text"], r["n_email"], r["n_date"], r["n_card"]) for r in queries.op3_pseudonyms(spark, sf).collect()]
    assert len(got) == len(rows)
    (found,) = [g for g in got if g[0] == 205]
    assert found[2:] == (1, 1, 1) and "ann@" not in found[1] and "4532 0151" not in found[1]
    plain = sorted(((k, t) for k, t, _ in rows if k != 205), key=str)
    assert sorted(((g[0], g[1]) for g in got if g[0] != 205), key=str) == plain


def test_kneser_ney_by_hand(spark):
    """The model's probabilities of a language against sums over its n-grams, written out."""
    texts = ["abab abc", "abc bca", "cab ab"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.kneser_ney(langid.gram_counts(docs.select("lang", "text")).toPandas())
    # over a word's next characters the probabilities of every character seen, and of one unseen, sum to one at most
    chars = sorted({c for t in texts for c in t if c != " "})
    total = 0.0
    logp, sizes = langid.word_log_probabilities([c for c in chars], model)
    assert (sizes >= 1).all() and np.isfinite(logp).all()
    once, _ = langid.word_log_probabilities(["ab"], model)
    rare, _ = langid.word_log_probabilities(["cc"], model)
    total = float(np.exp(logp[:, 0]).sum())
    assert 0 < total <= 1 + 1e-6 and once[0, 0] > rare[0, 0]
