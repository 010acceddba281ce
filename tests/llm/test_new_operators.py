"""Operators 11 to 13 against brute force in plain Python, and what they make of odd rows."""

import hashlib
import re

import numpy as np
import pytest

from estimark.llm import collision, fill_middle, hard_negatives, host_rules, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---------------------------------------------------------------------


def mined(rows, k=5, m=3):
    """Brute force over (vec_id, label, vector) in exact integers."""
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        others = sorted((-dot(v, w), j, of) for j, of, w in rows if j != i)
        for s, p, _ in [o for o in others if o[2] == label][:k]:
            window = [o for o in others if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(window[:m], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, shard string, kind string, v string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "s", "k", "v", 0.5) for i, label, v in rows], SCHEMA)


def run(spark, rows, **more):
    import pyspark.sql.functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((260, 12)) * 0.2 + 0.1, 2).astype(np.float32)
    x[40:90] = x[7]  # a large group of copies: ties by id
    x[100:110] = 0
    label = np.where(rng.random(260) < 0.4, 3, rng.integers(0, 6, 260))  # a hot label
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(260)]
    assert run(spark, rows) == mined(rows)


def test_hard_negatives_leaves_odd_rows_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.standard_normal(6) + 0.4).astype(np.float32).tolist()) for i in range(120)]
    odd = [(500, None, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None, 1, 1, 1, 1]), (550, 1, [float("nan")] * 6), (600, 2, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    assert run(spark, rows + odd) == mined(rows)
    again = rows + [rows[50], rows[3], rows[50]]  # repeated rows are one row
    assert run(spark, again) == mined(rows)
    assert run(spark, []) == [] and run(spark, odd) == []
    one = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.1]), (4, 2, [])]  # shorter vectors; one value below, one above the window
    assert run(spark, one) == mined(one) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_hard_negatives_with_many_blocks_and_small_k(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARDS", 3)
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 11 == 0), (rng.standard_normal(5) + 0.5).round(1).astype(np.float32).tolist()) for i in range(400)]
    assert run(spark, rows, positives=2, negatives=7) == mined(rows, 2, 7)


def test_bounds_hold_and_cells_are_few():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 9)).astype(np.int32)
    x[:200, 0] = 7
    shard = hard_negatives.Approximations(np.arange(500), rng.integers(0, 4, 500), x)
    q = rng.integers(-300, 300, (6, 9))
    low, high = shard.bounds(q, slice(0, 500))
    exact = q @ shard.x.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= high).all() and shard.code.max() < hard_negatives.CELLS
    assert np.mean(high - low) < 0.25 * exact.std()


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large for 64-bit"):
        run(spark, [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1.0])])


def test_nearest_gives_equal_vectors_equal_scores(spark, monkeypatch):
    """200 equal vectors of 64 components over several shards: ties go to the smaller ids."""
    import pyspark.sql.functions as F

    monkeypatch.setattr(collision, "SHARD_ROWS", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    same = rng.permutation(400)[:200]
    x[same] = x[same[0]] * np.float32(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collision.search(df, F.col("vec_id") % 20 == 0, recall=0.999).collect()
    wide = x.astype(np.float64)
    for q in range(0, 400, 20):
        if q in same:
            found = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert found == sorted(i for i in same if i != q)[:20]
            assert len({r["score"] for r in got if r["query_id"] == q}) == 1
    assert all(abs(r["score"] - wide[r["query_id"]] @ wide[r["vec_id"]]) < 1e-9 for r in got)


# --- 12 ---------------------------------------------------------------------


def filled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "a", "ab\n\ncd  ef", "é😀 ñandú\r\n\tx", "has <P> inside", "<S>", "<M", "tail <", "S> head", "x\x00y", "word " * 90_000, "1" * 70_000, "..<P", ">>> <<<"]


def test_fill_middle_by_brute_force(spark):
    rows = [(k * len(TEXTS) + j, t, "was", 5, "o") for k in range(12) for j, t in enumerate(TEXTS)] + [(None, "no id", "was", 5, "o"), (3, TEXTS[3], "was", 5, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, place int, output string")
    got = fill_middle.digests(docs).collect()
    want = sorted(((i, *(f := filled(i, t))[:4], sha(f[4]), sha(t or "")) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    made = fill_middle.examples(docs)
    assert made.columns == [*docs.columns, "fim"]
    for r in made.collect():
        assert (r["fim"]["n"], r["fim"]["form"], r["fim"]["prefix_chars"], r["fim"]["middle_chars"], r["fim"]["output"]) == filled(r["doc_id"], r["text"])
        assert r["form"] == "was" and r["place"] == 5
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs.where("false")).collect() == []


# --- 13 ---------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)


def test_host_rules_counts_by_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " \n\t", "a b c a b c a", "x\nx\n x\n\nx", "no line end\nlast\nlast", "é ü ö 😀 #|", "z" * 50_000, "one two three\x0bone two three\x0c$"]
    texts += [("\n" if k % 3 else " ").join(rng.choice(["ab", "c", "d%", "é"], 60)) for k in range(30)]
    rows = [(k, t, f"h{k % 3}", 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, host string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: tuple(r[c] for c in host_rules.COUNTS) for r in host_rules.counted(docs, F.col("source")).collect()}
    assert got == {k: counts(t) for k, t, *_ in rows}


def test_hosts_are_judged_by_shrunk_rates(spark):
    """A bad host of many documents goes with its good ones; a bad one of a single document is
    judged by the corpus; documents without a host are judged alone."""
    from pyspark.sql import functions as F

    good, bad = " ".join(f"word{k}" for k in range(60)), "short"
    rows = [(f"g{h}", good if k % 10 else bad) for h in range(8) for k in range(50)]
    rows += [("worst", bad if k % 10 else good) for k in range(60)] + [("tiny", bad), ("tiny", good), (None, good), (None, bad)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    rules = {k: host_rules.RULES[k] for k in host_rules.BASE}
    got = host_rules.verdicts(docs, F.col("source"), rules)
    for r in got.collect():
        host, text = rows[r["doc_id"]]
        assert r["base_failed"] == (text == bad)
        assert r["kept"] == (text == good and host != "worst"), r
    rates = {r["host"]: r["fail_rate"] for r in got.collect()}
    assert rates["worst"] > 0.8 and 0.1 < rates["g0"] < 0.15 and 0.1 < rates["tiny"] < 0.5 and rates[None] is None
    assert host_rules.verdicts(docs.where("false"), F.col("source")).collect() == []


def test_prior_by_moments():
    """Hosts drawn from a beta distribution give back its mean and, roughly, its strength."""
    rng = np.random.default_rng(8)
    n = rng.integers(20, 400, 3000)
    f = rng.binomial(n, rng.beta(2, 6, 3000))
    mean, strength = host_rules.prior(int(n.sum()), 3000, int((n * n).sum()), int(f.sum()), float((f * f / n).sum()))
    assert abs(mean - 0.25) < 0.01 and 7 < strength < 9
    assert host_rules.prior(0, 0, 0, 0, 0.0) == (0.0, 1.0)
    mean, strength = host_rules.prior(100, 1, 10_000, 30, 9.0)  # one host tells nothing of others
    assert mean == 0.3 and strength > 1e5
    mean, strength = host_rules.prior(100, 10, 1000, 0, 0.0)
    assert mean == 0 and strength > 1e5


def test_new_contracts(spark):
    sf = "/root/testdata/sf0.001"
    types = {
        "op11_hard_negatives": ["bigint", "bigint", "int", "bigint", "bigint", "bigint"],
        "op12_fill_middle": ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"],
        "op13_host_rules": ["bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "boolean", "boolean"],
    }
    for name, kinds in types.items():
        df = queries.QUERIES[name](spark, sf)
        assert [kind for _, kind in df.dtypes] == kinds, name
