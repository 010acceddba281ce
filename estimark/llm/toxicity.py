"""Toxicity by a weighted finite-state grammar over clauses.

Words map to classes, five weighted transducers over these classes are composed (insults,
threats, targets, negation, reported speech; see ``grammar``), and each clause with an attack
gets the heaviest path. What the path writes says whether an attack is bare, directed, negated
or reported; an attack counts with its word's weight and its arcs' weights, and the document's
score is a logistic function of the attacks by those kinds, fitted to the labels.

Insults are learned: words and word beginnings that mark toxic documents among at most
``max_labelled`` labelled training documents (the sample's bound), picked one after another by
what they add. Words with a class of their own in the grammar (targets, negations and so on)
keep it. A short list of insults and threats is known from the start.

Words are runs of letters and digits in any script, however long. A clause ends at . ! ? ; or :
or where no transducer reaches. Null and empty texts match no clause and get the score of such
a document. Labels that are null, or name no document, teach nothing; if a document is labelled
twice, each label counts. Repeated rows are scored each. Without any labels only the known list
scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import grammar
from estimark.llm.common import split_runs, text_bytes, text_slices, written

MAX_LABELLED = 30_000
MAX_FEATURES, MAX_LEXEMES = 3000, 200
PREFIXES = range(3, 10)
KNOWN = {
    grammar.INSULT: "idiot idiots moron morons stupid imbecile fool dumb loser losers scum trash worthless pathetic disgusting clown coward idiota idiotas estupido imbecil basura dummkopf idioten abschaum trottel idiote imbecile ordure stupide".split(),
    grammar.THREAT: "kill hurt destroy beat crush stab shoot murder burn töten umbringen verletzen tuer blesser détruire matar destruir golpear".split(),
    grammar.TARGET: "you your yours he she they him her them this these those that people du ihr euch sie dich tu vous toi ils elles cette ces usted ustedes ellos ellas ese esa".split(),
    grammar.NEGATION: "not never no neither nor isnt arent wasnt dont wont nicht nie kein keine pas jamais aucun ni nunca jamás".split(),
    grammar.REPORT: "said says say wrote writes claimed claims reported reports quoted called sagte schrieb behauptet dit écrit affirme dijo escribió afirma".split(),
    grammar.STRONG: "total totally complete completely utter utterly absolute such so really very völliger totaler so complètement vraiment totalmente completo muy".split(),
    grammar.PART: "piece waste pile sack bunch stück haufen morceau tas pedazo montón".split(),
    grammar.FILTH: "filth garbage dirt space air dreck müll saleté merde mierda suciedad".split(),
    grammar.INTENT: "will gonna going shall must should hope wish want werde werden soll hoffe will vais va dois espère voy vas debe espero quiero".split(),
    grammar.FATE: "die suffer rot perish drown sterben leiden verrecken mourir crever souffrir morir sufrir pudrirte".split(),
}
#: Classes that a learned lexeme doesn't take a word out of.
FIXED = (grammar.TARGET, grammar.NEGATION, grammar.REPORT, grammar.STRONG, grammar.INTENT)
WORD = re.compile(r"[^\W_]+")
APOSTROPHES = str.maketrans("", "", "'’")
#: No transducer's memory is longer, so words further from an attack don't change it.
REACH = sum((grammar.REPORT_SPAN, grammar.NEGATION_SPAN, 4, 4, 2))


def fold(parts: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def clean(run: bytes) -> list[str]:
    """The lower-cased words of a run without ASCII white space."""
    return WORD.findall(run.decode("utf-8", "replace").lower().translate(APOSTROPHES))


def features(word: str) -> list[str]:
    """The word, its beginnings, and its beginnings as those of a longer word."""
    if len(word) < 3:
        return []
    return [f"={word}", *[f"{word[:k]}*" for k in PREFIXES if k <= len(word)], *[f"{word[:k]}+" for k in PREFIXES if k < len(word)]]


def coded_words(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    coded, first = split_runs(*text_bytes(batch.column("text")), False)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), first


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, pos, neg): toxic and other documents of the sample that have each feature."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            codes, words, first = coded_words(batch)
            table: dict[str, int] = {}
            by_word = [[table.setdefault(f, len(table)) for f in sorted({f for w in clean(run) for f in features(w)})] for run in words]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            pairs = np.unique(doc.astype(np.int64) * (len(words) + 1) + codes)
            d, w = np.divmod(pairs, len(words) + 1)
            sizes = np.array([len(x) for x in by_word], np.int64)
            flat = np.array([f for x in by_word for f in x], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            f = np.concatenate([flat[starts[x] : starts[x + 1]] for x in w]) if len(w) else np.zeros(0, np.int64)
            pairs = np.unique(np.repeat(d, sizes[w]) * (len(table) + 1) + f)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[pairs // (len(table) + 1)]
            f = pairs % (len(table) + 1)
            pos, neg = (np.bincount(f[toxic == x], minlength=len(table)) for x in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(pos), pa.array(neg)], ["feature", "pos", "neg"])

    return sample.mapInArrow(emit, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def pick(sample: DataFrame) -> dict[str, float]:
    """Lexemes with their weights (log odds), each the best on the toxic documents that the
    ones before it leave unexplained."""
    n1, n0 = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return {}
    expected = F.lit(n1 / (n1 + n0)) * (F.col("pos") + F.col("neg"))
    worth = F.col("pos") * F.log(F.col("pos") / expected)
    top = feature_counts(sample).where((F.col("pos") >= 4) & (F.col("pos") >= 3 * expected)).orderBy(worth.desc(), "feature").limit(MAX_FEATURES).collect()
    index = {r["feature"]: k for k, r in enumerate(top)}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            codes, words, first = coded_words(batch)
            has = [{index[f] for w in clean(run) for f in features(w) if f in index} for run in words]
            out = [sorted(set().union(*(has[c] for c in set(codes[a:b].tolist()) if has[c]))) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["toxic", "has"])

    rows = sample.mapInArrow(emit, "toxic int, has array<int>").where(F.size("has") > 0).toPandas()  # of the bounded sample
    lists = [np.asarray(x, np.int64) for x in rows["has"]]
    f = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    toxic = rows["toxic"].to_numpy() == 1
    neg = np.bincount(f[~toxic[doc]], minlength=len(top))
    left, picked = toxic.copy(), {}
    while len(picked) < MAX_LEXEMES:
        pos = np.bincount(f[left[doc]], minlength=len(top))
        rest = max(1, int(left.sum()) + n1 - int(toxic.sum()))
        odds = np.log((pos + 0.5) / (rest + 1)) - np.log((neg + 0.5) / (n0 + 1))
        gain = np.where((pos >= 4) & (odds > 1.5), pos * odds, 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 12:
            break
        picked[top[best]["feature"]] = float(min(odds[best], 6.0))
        left &= ~np.isin(np.arange(len(lists)), doc[f == best])
    return picked


def lexicon(picked: dict[str, float]):
    """word -> (class, weight). Words of a fixed class keep it; then learned lexemes count as
    insults; then come the known insults and threats."""
    known: dict[str, tuple[str, float]] = {}
    for kind, words in KNOWN.items():
        for w in words:
            known.setdefault(w, (kind, 3.0 if kind in (grammar.INSULT, grammar.THREAT) else 1.5 if kind in grammar.ATTACKS else 0.0))

    def look(word: str) -> tuple[str, float]:
        kind, own = known.get(word, (grammar.OTHER, 0.0))
        if kind in FIXED:
            return kind, own
        weight = max((picked[f] for f in features(word) if f in picked), default=0.0)
        return (grammar.INSULT, max(weight, own)) if weight else (kind, own)

    return look


def clauses(places: np.ndarray, first: int, end: int, stops: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of one document's runs around its attacks at ``places``: to the ends of the clause
    or as far as the grammar reaches; spans that meet are one. words: words up to each run."""
    k = np.searchsorted(stops, places)
    bounds = np.r_[-1, stops, end - 1]
    lo = np.maximum.reduce([np.full(len(k), first), bounds[k] + 1, np.searchsorted(words, words[places] - REACH)])
    hi = np.minimum.reduce([np.full(len(k), end), bounds[k + 1] + 1, np.searchsorted(words, words[places] + REACH, "right") + 1])
    starts = np.flatnonzero(np.r_[True, lo[1:] >= np.maximum.accumulate(hi)[:-1]])
    yield from zip(lo[starts].tolist(), np.maximum.reduceat(hi, starts).tolist(), strict=True)


def clause_features(batch: pa.RecordBatch, look) -> np.ndarray:
    """Per document, the summed and the largest weights of its attacks by kind."""
    codes, raw, first = coded_words(batch)
    kinds = [[look(w) for w in clean(run)] for run in raw]
    hit = np.array([any(k in grammar.ATTACKS for k, _ in run) for run in kinds] or [False])
    stop = np.array([any(c in w for c in b".!?;:") for w in raw] or [False])
    out = np.zeros((batch.num_rows, 2 * (max(grammar.GROUPS.values()) + 1)))
    if not len(codes):
        return out
    places = np.flatnonzero(hit[codes])
    doc = np.searchsorted(first, places, "right") - 1
    stops = np.flatnonzero(stop[codes])
    upto = np.cumsum(np.array([len(run) for run in kinds])[codes])
    for d in np.unique(doc).tolist():
        own = places[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        for lo, hi in clauses(own, int(first[d]), int(first[d + 1]), stops, upto):
            clause = [symbol for c in codes[lo:hi].tolist() for symbol in kinds[c]]
            _, written, arcs = grammar.CLAUSE.best([s for s, _ in clause])
            for (_, weight), s, arc in zip(clause, written, arcs, strict=True):
                if s in grammar.GROUPS:
                    g = 2 * grammar.GROUPS[s]
                    out[d, g] += weight + arc
                    out[d, g + 1] = max(out[d, g + 1], weight + arc)
    out[:, ::2] = np.log1p(np.maximum(out[:, ::2], 0))
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) by Newton's method, drawn to ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = prior.copy(), np.full(len(prior), 1.0)
    pull[-1] = 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Weights before any label is seen: bare and directed attacks count, negated and reported hardly.
PRIOR = np.array([0.5, 1.2, 0.7, 1.5, 0.3, 0.3, 0.7, 1.5, 0.1, 0.1, 0.1, 0.2, -3.0])


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """Lexemes and the weights of kinds, from (doc_id, text) and (doc_id, toxic) rows."""
    some = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)  # 12 bytes a row: 360 kB at most
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")
    sample = written(sample)
    picked = pick(sample)
    look = lexicon(picked)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            x = clause_features(batch, look)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(emit, "toxic int, x array<double>").toPandas()  # of the bounded sample
    if not len(rows):
        return picked, PRIOR
    return picked, logistic(np.stack(rows["x"]), rows["toxic"].to_numpy().astype(float), PRIOR)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """(doc_id, ``keep`` columns, score, predicted) for each document, from its text alone."""
    picked, w = model
    look, keep = lexicon(picked), keep or []

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            p = 1 / (1 + np.exp(-np.clip(clause_features(batch, look) @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", *keep, "score", "predicted"])

    types = dict(docs.dtypes)
    inputs = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    return inputs.mapInArrow(emit, ", ".join(["doc_id long", *[f"`{c}` {types[c]}" for c in keep], "score double", "predicted int"]))
