"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 a language, over the letters of lower-cased words with a space on either
side. N-grams of all languages stand in one sorted array of hashes with their interpolated log
probabilities by language; an n-gram that no language has seen backs off to its context's
weight and the next lower order. The language with the lowest cross-entropy a character wins.
A document whose cross-entropy lies beyond what 99.5 % of its language's calibration documents
of its length have is rejected: its score is at most 0.5. The spread of an entropy falls with the
characters that it is the mean of, so the limit does, too. Ties between languages go to the first
by name.

The models are fitted on about ``per_language`` documents of each language (the sample's
bound, chosen by hash), whole texts; for calibration each quarter is judged by the other three. Texts that are null or
have no letter are ``und`` with score 0. Documents without a language teach nothing; with no
language at all every document is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.common import split_runs, text_bytes, text_slices, written

ORDER, PER_LANGUAGE = 4, 3000
#: Parts that are left out in turn, and the share of a language's own documents that may be rejected.
PARTS, REJECTED = 4, 0.005
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNSEEN = -30.0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(words: list[bytes]) -> list[str]:
    """Lower-cased letters of each word; other characters are dropped."""
    out = []
    for w in words:
        s = w.decode("utf-8", "replace").lower()
        out.append(s if s.isalpha() else "".join(c for c in s if c.isalpha()))
    return out


def grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams, n = 1 .. ORDER, that end at each predicted character (0 where a
    word begins later), those of their contexts, the length of each character's history and
    the word it is of."""
    text = " " + " ".join(words) + " "
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = chars == 32
    begin = np.maximum.accumulate(np.where(space, np.arange(len(chars)), 0))
    # a character's history goes back to the space before its word; a space ends the word before it
    past = np.arange(len(chars)) - np.concatenate([[0], begin[:-1]])
    word = np.cumsum(space) - 1
    word[space] -= 1
    code = mixed(chars + _MIX)
    hashes, h = [], np.zeros(len(chars), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.concatenate([np.zeros(n - 1, np.uint64), code[: len(code) - n + 1]])
        h = h + shifted * np.uint64(pow(int(_MIX), n - 1, 1 << 64))
        hashes.append(np.where(past >= n - 1, mixed(h + np.uint64(n)), np.uint64(0)))
    keep = np.arange(len(chars)) > 0
    keep &= ~(space & (past == 1))  # an empty word
    contexts = [np.zeros(len(chars), np.uint64), *[np.concatenate([[np.uint64(0)], h[:-1]]) for h in hashes[:-1]]]
    return [x[keep].astype(np.int64) for x in hashes], [x[keep].astype(np.int64) for x in contexts], past[keep], word[keep]


def batch_grams(batch: pa.RecordBatch):
    coded, first = split_runs(*text_bytes(batch.column("text")), False)
    words = letters(coded.dictionary.to_pylist())
    return coded.indices.to_numpy(zero_copy_only=False), first, words


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, n, gram, context, rest, whole, c): counts of n-grams; rest is the gram without
    its first character, whole is true where the gram begins with its word."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            for lang in batch.column("lang").unique().to_pylist():
                part = batch.filter(pa.array([x == lang for x in batch.column("lang").to_pylist()]))
                codes, _, words = batch_grams(part)
                times = np.bincount(codes, minlength=len(words))
                hashes, contexts, past, word = grams(words)
                for n in range(1, ORDER + 1):
                    own = np.flatnonzero(hashes[n - 1] != 0)
                    g, at, inverse = np.unique(hashes[n - 1][own], return_index=True, return_inverse=True)
                    c = np.bincount(inverse, times[word[own]], len(g)).astype(np.int64)
                    at = own[at]
                    context = contexts[n - 1][at]
                    rest = hashes[n - 2][at] if n > 1 else np.zeros(len(g), np.int64)
                    some = c > 0
                    columns = [pa.array([lang] * int(some.sum()), pa.string()), pa.array(np.full(int(some.sum()), n, np.int32)), *[pa.array(x[some]) for x in (g, context, rest)], pa.array((past[at] == n - 1)[some]), pa.array(c[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "gram", "context", "rest", "whole", "c"])

    raw = sample.mapInArrow(emit, "lang string, n int, gram long, context long, rest long, whole boolean, c long")
    return raw.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("rest").alias("rest"), F.first("whole").alias("whole"), F.sum("c").alias("c"))


def kneser_ney(counts) -> dict:
    """Sorted hash arrays by order: grams with a log probability for each language, contexts
    with a log back-off weight for each language."""
    langs = sorted(counts["lang"].unique())
    model: dict = {"langs": langs, "grams": [], "contexts": []}
    tables = {(lang, n): part for (lang, n), part in counts.groupby(["lang", "n"])}
    alphabet = np.unique(counts.loc[counts["n"] == 1, "gram"])
    lower = None
    for n in range(1, ORDER + 1):
        rows = counts[counts["n"] == n]
        first = rows.drop_duplicates("gram").sort_values("gram")
        grams_n = first["gram"].to_numpy()
        contexts = np.unique(rows["context"].to_numpy())
        logp, backoff = np.full((len(grams_n), len(langs)), UNSEEN), np.zeros((len(contexts), len(langs)))
        ctx_at = np.searchsorted(contexts, first["context"].to_numpy())
        base = np.full((len(grams_n), len(langs)), 1 / (len(alphabet) + 1)) if lower is None else np.exp(lower(first["rest"].to_numpy()))
        for k, lang in enumerate(langs):
            t = tables.get((lang, n))
            if t is None:
                logp[:, k] = np.log(base[:, k])
                continue
            t = t.sort_values("gram")
            c = t["c"].to_numpy().astype(float)
            if n < ORDER:  # continuation counts, except for grams that begin with their word
                up = tables.get((lang, n + 1))
                g, kinds = np.unique(up["rest"].to_numpy(), return_counts=True) if up is not None else (np.zeros(0, np.int64), np.zeros(0))
                at = np.searchsorted(g, t["gram"].to_numpy())
                found = (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == t["gram"].to_numpy()) if len(g) else np.zeros(len(t), bool)
                c = np.where(t["whole"].to_numpy() | ~found, c, kinds[np.minimum(at, len(g) - 1)] if len(g) else c)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(contexts, t["context"].to_numpy())
            total, types = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
            weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            backoff[:, k] = np.log(weight)
            own = np.zeros(len(grams_n))
            own[np.searchsorted(grams_n, t["gram"].to_numpy())] = c - discount
            p = own / np.maximum(total[ctx_at], 1) + weight[ctx_at] * base[:, k]
            logp[:, k] = np.log(np.maximum(p, 1e-12))
        model["grams"].append((grams_n, logp.astype(np.float32)))
        model["contexts"].append((contexts, backoff.astype(np.float32)))
        arrays, values = grams_n, logp
        lower = lambda g, a=arrays, v=values: v[np.minimum(np.searchsorted(a, g), len(a) - 1)]
    model["unknown"] = float(np.log(1 / (len(alphabet) + 1)))
    return model


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def word_log_probabilities(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word by language, and its number of predicted characters."""
    hashes, contexts, past, word = grams(words)
    total = np.zeros((len(word), len(model["langs"])))
    todo = np.arange(len(word))
    for n in range(ORDER, 0, -1):
        able = past[todo] >= n - 1
        rows = todo[able]
        at, hit = find(model["grams"][n - 1][0], hashes[n - 1][rows])
        total[rows[hit]] += model["grams"][n - 1][1][at[hit]]
        miss = rows[~hit]
        at, hit = find(model["contexts"][n - 1][0], contexts[n - 1][miss])
        total[miss[hit]] += model["contexts"][n - 1][1][at[hit]]
        if n == 1:
            total[miss] += model["unknown"]
        todo = np.concatenate([todo[~able], miss])
    out = np.zeros((len(words), total.shape[1]))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(word):
        out[word[starts]] = np.add.reduceat(total, starts)
    return out, np.bincount(word, minlength=len(words))


def entropies(batch: pa.RecordBatch, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a character by language (nats), and characters, of each document."""
    codes, first, words = batch_grams(batch)
    logp, size = word_log_probabilities(words, model)
    logp, size = logp * (np.array([bool(w) for w in words], bool)[:, None] if words else 1), size * np.array([bool(w) for w in words] or [0])[: len(words)]
    sums = np.zeros((len(codes) + 1, len(model["langs"])))
    np.cumsum(logp[codes], axis=0, out=sums[1:])
    n = np.concatenate([[0], np.cumsum(size[codes])])
    chars = n[first[1:]] - n[first[:-1]]
    return -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(chars, 1)[:, None], chars


def merged(counts: list):
    """The counts of several parts of the sample as one."""
    both = pd.concat(counts)
    return both.groupby(["lang", "n", "gram"], as_index=False).agg({"context": "first", "rest": "first", "whole": "first", "c": "sum"})


def calibrated(h: np.ndarray, chars: np.ndarray, share: float = REJECTED) -> tuple[float, float, float, float]:
    """(middle, a, b, limit) for a language's own documents with entropies h: a document of n
    characters spreads around the middle by sqrt(a + b / n); no more than ``share`` of such documents
    lie over ``limit`` times that (one in their number and one more, if they are few)."""
    middle, x = float(np.median(h)), 1 / chars
    off, terms = (h - middle) ** 2, np.stack([np.ones(len(x)), x], 1)
    a, b = 0.0, max(1e-12, float((off * chars).mean()))
    for _ in range(8):  # least squares weighted by the spread found so far; what lies far out counts as 16 times it
        spread = a + b * x
        scaled = np.minimum(off / spread, 16.0)
        a, b = np.linalg.lstsq(terms / spread[:, None], scaled, rcond=None)[0]
        if a < 0 or b < 0:  # then the other one alone
            a, b = (0.0, float((scaled * spread / x).mean())) if a < 0 else (float((scaled * spread).mean()), 0.0)
        a, b = max(a, 1e-12), max(b, 1e-12)
    z = np.sort((h - middle) / np.sqrt(a + b * x + 1e-12))
    return middle, float(a), float(b), float(z[min(len(z), math.ceil((len(z) + 1) * (1 - share))) - 1])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The models, from (text, lang) rows. Rejection is calibrated on documents that the model judging
    them hasn't seen: the sample's parts are left out in turn."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {"langs": []}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    sample = written(rows.where(place < share[F.col("lang")] * (1 << 20)).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(PARTS)).alias("part")))
    counts = [gram_counts(sample.where(F.col("part") == k)).toPandas() for k in range(PARTS)]  # bounded by the sample
    own = pd.concat([own_entropies(sample.where(F.col("part") == k), kneser_ney(merged(counts[:k] + counts[k + 1 :]))) for k in range(PARTS) if any(len(c) for i, c in enumerate(counts) if i != k)] or [pd.DataFrame({"lang": [], "h": [], "chars": []})])
    model = kneser_ney(merged(counts))
    known = [own[own["lang"] == x] for x in model["langs"]]
    found = [calibrated(o["h"].to_numpy(), o["chars"].to_numpy().astype(float)) if len(o) else (0.0, 0.0, 0.0, np.inf) for o in known]
    model["spread"] = np.array(found).reshape(-1, 4)
    return model


def own_entropies(docs: DataFrame, model: dict):
    """(lang, h, chars) of documents under their own language's model, as a pandas frame; those of
    languages that the model doesn't know are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            batch = batch.filter(pa.array([x in model["langs"] for x in batch.column("lang").to_pylist()]))
            h, chars = entropies(batch, model)
            own = np.array([model["langs"].index(x) for x in batch.column("lang").to_pylist()], int)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h[np.arange(len(own)), own]), pa.array(chars)], ["lang", "h", "chars"])

    return docs.select("lang", "text").mapInArrow(emit, "lang string, h double, chars long").where("chars > 0").toPandas()


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for each document, from its text alone."""
    langs = model["langs"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8 << 20):
            n = batch.num_rows
            if not langs:
                columns = [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
            else:
                h, chars = entropies(batch, model)
                best = h.argmin(1)
                low = h[np.arange(n), best]
                p = 1 / np.exp(-np.clip((h - low[:, None]) * np.minimum(chars, 50)[:, None], 0, 60)).sum(1)
                middle, a, b, limit = model["spread"][best].T
                rejected = ((low - middle) / np.sqrt(a + b / np.maximum(chars, 1) + 1e-12) > limit) & (chars > 0)
                score = np.where(chars > 0, np.where(rejected, np.minimum(p, 0.5), p), 0.0)
                columns = [pa.array([langs[b] if c else "und" for b, c in zip(best, chars, strict=True)], pa.string()), pa.array(score), pa.array(low), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
