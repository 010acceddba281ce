"""Document log-likelihoods under a gated recurrent language model.

Tokens are runs without white space (A-Z lower-cased) and one end a document. The ``FREQUENT``
most counted words have outputs of their own, in classes of equal size by frequency; all other
known words fall into classes by their last two bytes, once for words counted several times
and once for words counted once. Unseen words share the latter's probability. P(word) is
P(class | state) times P(word | class, state) for frequent words, and P(class | state) times a
share by counts for the others. Counts cover every training document.

The recurrent layer is a minimal gated unit in numpy. Workers train on their share of the
training documents, all of them in each of the rounds, by truncated backpropagation, and
their weights are averaged after each round; the number of workers grows with the corpus. In scoring, many documents
run side by side in windows and each one's state is carried on from window to window.

Null and empty texts are one end token. Documents whose id is null train and are not held out.
Rows that repeat an id are scored each. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.common import scrambled, text_bytes, text_slices, written
from estimark.llm.wordblocks import distinct_words, meet, words_and_blocks

CLASS_SIZE, CLASSES, ENDINGS, HIDDEN = 64, 32, 16, 32
FREQUENT = CLASS_SIZE * CLASSES
ALL_CLASSES = CLASSES + 2 * ENDINGS
#: Inputs: frequent words (the end token is one of them), then the classes of the others.
INPUTS = FREQUENT + 2 * ENDINGS
#: The class of each input.
CLASS_OF = np.r_[np.repeat(np.arange(CLASSES), CLASS_SIZE), np.arange(CLASSES, ALL_CLASSES)].astype(np.uint8)
SMOOTH, UNSEEN_SHARE = 0.1, 0.5
#: Rates of the rounds, each over an equal part of the training documents, and documents that a
#: worker goes through in all of them: enough for its streams to end together in each.
RATES, WORKER_DOCS = (0.03, 0.02, 0.01, 0.005), 16000
STREAMS, WINDOW, SCORE_STREAMS, SCORE_WINDOW = 128, 24, 256, 32
END = b""
#: Bytes of documents' input indexes (two each) that are scored at once.
SLICE_BYTES = 4 << 20


def ending(words: pa.Array) -> np.ndarray:
    """The class of a word by its last two bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8).astype(np.int64)
    last = data[np.maximum(offsets[1:] - 1, 0)]
    before = np.where(offsets[1:] - offsets[:-1] > 1, data[np.maximum(offsets[1:] - 2, 0)], 0)
    return (before * 31 + last * 17 + before * last % 13) % ENDINGS


def inputs_of(words: pa.Array, counts: np.ndarray, frequent: pa.Array) -> np.ndarray:
    """The input index of each word."""
    at = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, at, FREQUENT + ending(words) + ENDINGS * (counts <= 1)).astype(np.int32)


class Room:
    """Arrays by name, kept from window to window: memory that is freed and asked for again for each
    window has to be cleared by the system each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        """An array of any content; what had this name before is no longer valid."""
        size = math.prod(shape)
        held = self.held.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self.held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows ``at``, which must be within ``table``."""
        # with another mode, take makes an array of its own first
        return table.take(at, axis=0, out=self(name, (*at.shape, *table.shape[1:]), table.dtype), mode="clip")


class Model:
    """Weights of the recurrent layer and of the outputs."""

    names = ("inputs", "uf", "ug", "wc", "bc", "ww", "bw")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, class_counts: np.ndarray, word_counts: np.ndarray) -> Model:
        """Small random weights; outputs begin as the counted unigram distribution."""
        rng = np.random.default_rng(3)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        by_class = word_counts.reshape(CLASSES, CLASS_SIZE)
        return cls({
            "inputs": small(INPUTS, 2 * HIDDEN), "uf": small(HIDDEN, HIDDEN), "ug": small(HIDDEN, HIDDEN), "wc": small(HIDDEN, ALL_CLASSES) * 0.1,
            "bc": np.log((class_counts + 0.5) / (class_counts + 0.5).sum()).astype(np.float32), "ww": small(CLASSES, HIDDEN, CLASS_SIZE) * 0.1,
            "bw": np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -30).astype(np.float32),
        })

    def halves(self, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inputs' rows for the gate, negated, and for the candidate, each without gaps, and
        the gate's weights of the state, negated."""
        inputs = self.w["inputs"]
        gate, candidate = (room(name, (len(inputs), HIDDEN), inputs.dtype) for name in ("by_gate", "by_candidate"))
        np.copyto(candidate, inputs[:, HIDDEN:])
        return np.negative(inputs[:, :HIDDEN], out=gate), candidate, -self.w["uf"]

    def gates(self, h: np.ndarray, af: np.ndarray, ag: np.ndarray, uf: np.ndarray, f: np.ndarray, r: np.ndarray, g: np.ndarray) -> None:
        """Writes gate, gated state and candidate of a step from the states before it; ``af``, ``ag``
        and ``uf`` are from ``halves``, the first two of the step's inputs."""
        np.matmul(h, uf, out=f)
        f += af
        np.exp(f, out=f)
        f += 1
        np.reciprocal(f, out=f)
        np.multiply(f, h, out=r)
        np.matmul(r, self.w["ug"], out=g)
        g += ag
        np.tanh(g, out=g)

    def outputs(self, h: np.ndarray, ids: np.ndarray, grad: dict | None = None, room: Room | None = None):
        """Natural log probability of each class or frequent word given the state before it;
        with ``grad``, fills it and returns the gradient by the states, too."""
        w, room = self.w, room or Room()
        cls = CLASS_OF.take(ids)
        # in the order of classes, so that each class's rows are neighbours
        order = np.argsort(cls, kind="stable")
        row = np.arange(len(ids))
        place = np.empty_like(order)
        place[order] = row
        h, ids, cls = room.rows("h", h, order), ids.take(order), cls.take(order)
        sizes = np.bincount(cls, minlength=ALL_CLASSES)[:CLASSES]
        cuts = [0, *np.cumsum(sizes).tolist()]
        some = [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        n = cuts[-1]
        p = np.matmul(h, w["wc"], out=room("p", (len(ids), ALL_CLASSES), h.dtype))
        p += w["bc"]
        out, p, total = log_shares(p, row, cls, room("p_shares", p.shape, p.dtype))
        z = room("z", (n, CLASS_SIZE), h.dtype)
        for c, a, b in some:
            np.matmul(h[a:b], w["ww"][c], out=z[a:b])
            z[a:b] += w["bw"][c]
        own = ids[:n] % CLASS_SIZE
        inner, z, within = log_shares(z, row[:n], own, room("z_shares", z.shape, z.dtype))
        out[:n] += inner
        back = out.take(place)
        if grad is None:
            return back
        p *= (1 / total)[:, None]
        p.reshape(-1)[row * ALL_CLASSES + cls] -= 1
        np.matmul(h.T, p, out=grad["wc"])
        one = np.ones(len(ids), h.dtype)
        np.matmul(one, p, out=grad["bc"])
        dh = np.matmul(p, w["wc"].T, out=room("dh", h.shape, h.dtype))
        if n:
            z *= (1 / within)[:, None]
            z.reshape(-1)[row[:n] * CLASS_SIZE + own] -= 1
            more = room("more", (n, HIDDEN), h.dtype)
            for c, a, b in some:
                np.matmul(h[a:b].T, z[a:b], out=grad["ww"][c])
                np.matmul(one[a:b], z[a:b], out=grad["bw"][c])
                np.matmul(z[a:b], w["ww"][c].T, out=more[a:b])
            dh[:n] += more
        return back, room.rows("dh_out", dh, place)


def log_shares(z: np.ndarray, row: np.ndarray, own: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log of each row's share at ``own`` of its exponentials, these (in ``out``) and their sums; rows
    are moved to their largest only if their sums leave the range of single precision otherwise."""
    with np.errstate(over="ignore"):
        e = np.exp(z, out=out)
    one = np.ones(z.shape[1], z.dtype)
    total = e @ one
    if len(z) and not (total.min() > 1e-20 and total.max() < 1e20):
        z = z - z.max(1, keepdims=True)
        e = np.exp(z, out=out)
        total = e @ one
    return z.reshape(-1).take(row * z.shape[1] + own) - np.log(total), e, total


def streams_of(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals sequences out to n streams, longest first, each to the stream that is the shortest by then.
    Returns for each stream (the longest first) and step the position in the concatenation
    (-1: none), whether a sequence begins there, and for each step how many streams go on."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    shortest, lists = [(0, s) for s in range(n)], [[] for _ in range(n)]
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        so_far, s = shortest[0]
        lists[s].append(k)
        heapq.heapreplace(shortest, (so_far + length, s))
    load = np.array([so_far for so_far, _ in sorted(shortest, key=itemgetter(1))], np.int64)
    rank = np.argsort(-load, kind="stable")
    place = np.full((int(load.max(initial=0)), n), -1, np.int64)
    begins = np.zeros(place.shape, bool)
    for s, own in enumerate(rank):
        at = 0
        for k in lists[own]:
            place[at : at + lengths[k], s] = np.arange(starts[k], starts[k] + lengths[k])
            begins[at, s] = True
            at += lengths[k]
    return place, begins, (place >= 0).sum(1)


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of P(class or frequent word | all tokens before) for each token of the
    concatenated documents."""
    n = min(SCORE_STREAMS, max(1, len(lengths)))
    place, begins, going = streams_of(lengths, n)
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((SCORE_WINDOW, n, HIDDEN), np.float32)
    f, r, g = (np.empty((n, HIDDEN), np.float32) for _ in range(3))
    room = Room()
    fresh, (by_gate, by_candidate, uf) = begins.any(1), model.halves(room)
    for at in range(0, len(place), SCORE_WINDOW):
        n = going[at]
        where = place[at : at + SCORE_WINDOW, :n]
        x = ids.take(np.maximum(where, 0))
        af, ag = room.rows("af", by_gate, x), room.rows("ag", by_candidate, x)
        for t in range(len(where)):
            k = going[at + t]
            if fresh[at + t]:
                h[:k][begins[at + t, :k]] = 0
            states[t, :k] = h[:k]
            model.gates(h[:k], af[t, :k], ag[t, :k], uf, f[:k], r[:k], g[:k])
            # h + f (g - h)
            g[:k] *= f[:k]
            h[:k] -= r[:k]
            h[:k] += g[:k]
        live = where >= 0
        if n == states.shape[1] and live.all():
            out[where.ravel()] = model.outputs(states[: len(where)].reshape(-1, HIDDEN), x.ravel(), room=room)
        else:
            out[where[live]] = model.outputs(states[: len(where), :n][live], x[live], room=room)
    return out


def gradients(model: Model, x: np.ndarray, begin: np.ndarray, live: np.ndarray, h: np.ndarray, grad: dict | None = None, room: Room | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of minus the summed log probability over a window of streams (steps x streams),
    by backpropagation to the window's beginning; the log probabilities of its live places and
    the states after it. ``grad``: arrays of zeros to hold them."""
    w, (steps, n), room = model.w, x.shape, room or Room()
    grad = {k: np.zeros_like(v) for k, v in w.items()} if grad is None else grad
    fresh, (by_gate, by_candidate, uf) = begin.any(1), model.halves(room)
    af, ag = room.rows("af", by_gate, x), room.rows("ag", by_candidate, x)
    hs, f, r, g = (room(name, af.shape, h.dtype) for name in ("hs", "f", "r", "g"))
    for t in range(steps):
        hs[t] = h
        if fresh[t]:
            hs[t][begin[t]] = 0
        model.gates(hs[t], af[t], ag[t], uf, f[t], r[t], g[t])
        h = f[t] * g[t]
        h -= r[t]
        h += hs[t]
    every = bool(live.all())
    out, dlive = model.outputs(hs.reshape(-1, HIDDEN) if every else hs[live], x.ravel() if every else x[live], grad, room)
    if every:
        dh_out = dlive.reshape(hs.shape)
    else:
        dh_out = np.zeros_like(hs)
        dh_out[live] = dlive
    # what the gradient by the state after a step is multiplied with on its ways back
    rest = np.subtract(1, f, out=room("rest", f.shape, h.dtype))
    by_r, by_f = np.multiply(f, rest, out=af), np.subtract(g, hs, out=ag)
    by_f *= by_r
    by_r *= hs
    g *= g
    np.subtract(1, g, out=g)
    g *= f
    da = room("da", (2, steps, n, HIDDEN), h.dtype)
    dh, dr, part, uft, ugt = np.zeros_like(h), np.empty_like(h), np.empty_like(h), np.ascontiguousarray(w["uf"].T), np.ascontiguousarray(w["ug"].T)
    for t in range(steps - 1, -1, -1):
        df, dg = da[0, t], da[1, t]
        np.multiply(dh, g[t], out=dg)
        np.matmul(dg, ugt, out=dr)
        np.multiply(dh, by_f[t], out=df)
        np.multiply(dr, by_r[t], out=part)
        df += part
        dh *= rest[t]
        dr *= f[t]
        dh += dr
        np.matmul(df, uft, out=part)
        dh += part
        dh += dh_out[t]
        if fresh[t]:
            dh[begin[t]] = 0
    da = da.reshape(2, -1, HIDDEN)
    np.matmul(hs.reshape(-1, HIDDEN).T, da[0], out=grad["uf"])
    np.matmul(r.reshape(-1, HIDDEN).T, da[1], out=grad["ug"])
    if not every:
        da *= live.reshape(-1, 1)
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    own = x.ravel()[order]
    begins_at = np.flatnonzero(np.diff(own, prepend=-1))
    times = np.diff(begins_at, append=len(own))
    # inputs that occur often are summed one by one, all others together, a row of each at a time
    often = times > OFTEN
    one, many = np.ones(times.max(), h.dtype), list(zip(own[begins_at[often]].tolist(), begins_at[often].tolist(), times[often].tolist(), strict=True))
    seldom = begins_at[~often][np.argsort(-times[~often], kind="stable")]
    more = np.bincount(times[~often], minlength=OFTEN + 1)[::-1].cumsum()[::-1].tolist()
    for half, part in zip((slice(HIDDEN), slice(HIDDEN, None)), da, strict=True):
        into, part = grad["inputs"][:, half], room.rows("by_input", part, order)
        for k, a, m in many:
            np.matmul(one[:m], part[a : a + m], out=into[k])
        sums = part.take(seldom, axis=0)
        for k in range(1, OFTEN):
            sums[: more[k + 1]] += part.take(seldom[: more[k + 1]] + k, axis=0)
        into[own[seldom]] = sums
    return grad, out, h


#: Inputs that occur more often in a window are summed one by one.
OFTEN = 8


def train(model: Model, ids: np.ndarray, lengths: np.ndarray, rate: float) -> Model:
    """One pass of truncated backpropagation over the documents, with Adam steps that shrink to a
    tenth of ``rate``."""
    values = flat(model)
    # views of one array each, so that a step goes over all weights at once
    model, sums = views(model, values), np.zeros_like(values)
    grad = views(model, sums).w
    place, begins, going = streams_of(lengths, min(STREAMS, max(1, len(lengths))))
    h = np.zeros((place.shape[1], HIDDEN), np.float32)
    m1, m2, room = np.zeros_like(values), np.zeros_like(values), Room()
    for step, at in enumerate(range(0, len(place), WINDOW), 1):
        n = going[at]
        where = place[at : at + WINDOW, :n]
        live = where >= 0
        sums[:] = 0
        _, _, h = gradients(model, ids[np.maximum(where, 0)], begins[at : at + WINDOW, :n], live, h[:n], grad, room)
        tokens = max(1, int(live.sum()))
        norm = np.sqrt(float(np.dot(sums, sums))) / tokens
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / tokens)
        # with m1 and m2 ten and a hundred times the averages of g and g g:
        # w -= rate m1' / (sqrt(m2') + 1e-8), in place
        root = np.sqrt(1 - 0.99**step)
        small = np.float32(1e-7 * root)
        by = np.float32(rate * (1 - 0.9 * at / len(place)) / (1 - 0.9**step) * root)
        sums *= scale
        m1 *= np.float32(0.9)
        m1 += sums
        sums *= sums
        m2 *= np.float32(0.99)
        m2 += sums
        np.sqrt(m2, out=sums)
        sums += small
        np.divide(m1, sums, out=sums)
        sums *= by
        values -= sums
    return model


def views(like: Model, values: np.ndarray) -> Model:
    """Weights in ``values``, without a copy."""
    ends = np.cumsum([like.w[k].size for k in Model.names])
    return Model({k: v.reshape(like.w[k].shape) for k, v in zip(Model.names, np.split(values, ends[:-1]), strict=True)})


def flat(model: Model) -> np.ndarray:
    return np.concatenate([model.w[k].ravel() for k in Model.names])


def shaped(like: Model, values: np.ndarray) -> Model:
    out, at = {}, 0
    for k in Model.names:
        n = like.w[k].size
        out[k] = values[at : at + n].reshape(like.w[k].shape).astype(np.float32)
        at += n
    return Model(out)


def indexes(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated input indexes of documents, and each one's number of them."""
    data, offsets = text_bytes(ids)
    return data.view(np.int16).astype(np.int32), np.diff(offsets) // 2


def fit(coded: DataFrame, model: Model) -> Model:
    """Weights after the rounds of training on all of ``coded`` (worker, ids): each document is in
    one of them, and a round begins with the average of all workers' weights after the one before,
    so more documents are more workers that each round learns from. A task adds up its workers'
    weights, so one model leaves each task."""
    parts, size = 64, len(flat(model))
    bounds = np.linspace(0, size, parts + 1).astype(int)
    rounds = coded.withColumn("round", F.col("worker") % len(RATES)).repartition("worker").sortWithinPartitions("round", "worker")
    dealt = written(rounds, by="round")

    for number, rate in enumerate(RATES):
        now = model

        def work(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            worker, held = None, []

            def train_held() -> tuple[np.ndarray, int]:
                ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
                return flat(train(now, ids, lengths, rate)).astype(np.float64) * len(ids), len(ids)

            total, tokens = np.zeros(size), 0
            for batch in batches:
                own = batch.column("worker").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if own[a] != worker and held:
                        values, n = train_held()
                        total, tokens, held = total + values, tokens + n, []
                    worker = own[a]
                    held.append(indexes(batch.column("ids").slice(a, b - a)))
            if held:
                values, n = train_held()
                total, tokens = total + values, tokens + n
            if tokens:
                total /= tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([total[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array(np.full(parts, float(tokens)))], ["part", "w", "n"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, values, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                    s = sums.setdefault(part, [0.0, 0.0])
                    s[0] = s[0] + n * np.frombuffer(values)
                    s[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).tobytes() for x, n in sums.values()], pa.binary())], ["part", "w"])

        trained = dealt.where(F.col("round") == number).drop("round").mapInArrow(work, "part int, w binary, n double").repartition("part").mapInArrow(average, "part int, w binary")
        rows = {r["part"]: np.frombuffer(bytes(r["w"])) for r in trained.collect()}  # the size of one model
        if rows:
            model = shaped(model, np.concatenate([rows[k] for k in range(parts)]))
    return model


def with_ends(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids with the end token behind each, and their lengths."""
    n = np.diff(first)
    out = np.empty(len(ids) + len(n), np.int32)
    last = first[1:] + np.arange(len(n))
    out[last] = end
    rest = np.ones(len(out), bool)
    rest[last] = False
    out[rest] = ids
    return out, n + 1


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document;
    rows that ``held_out`` selects teach nothing."""
    docs = docs.select("doc_id", "text", F.coalesce(~held_out, F.lit(True)).alias("train"))
    words, blocks = words_and_blocks(docs, True, ["doc_id", "train"], "train")
    totals = written(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    n_docs, train_docs = docs.agg(F.count("*"), F.count_if("train")).first()
    counted, distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = counted + train_docs, distinct + (train_docs > 0)
    top = [(r["word"], r["n"]) for r in totals.orderBy(F.desc("n"), "word").limit(FREQUENT - 1).collect()]
    place = sum(n > train_docs for _, n in top)
    top.insert(place, (END, train_docs))
    frequent = pa.array([bytes(w) for w, _ in top], pa.binary())
    word_counts = np.zeros(FREQUENT)
    word_counts[: len(top)] = [n for _, n in top]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = inputs_of(batch.column("word"), n, frequent) - FREQUENT
            some = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * ENDINGS)), pa.array(np.bincount(at[some], n[some], 2 * ENDINGS).astype(float)), pa.array(np.bincount(at[some], minlength=2 * ENDINGS))], ["at", "n", "kinds"])

    mass, members = np.zeros(2 * ENDINGS), np.zeros(2 * ENDINGS)
    for r in totals.mapInArrow(rare, "at long, n double, kinds long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        mass[r["at"]], members[r["at"]] = r["n"], r["kinds"]
    model = Model.fresh(np.concatenate([word_counts.reshape(CLASSES, CLASS_SIZE).sum(1), mass]), word_counts)
    floor = np.log10(tokens + SMOOTH * (kinds + 1)) if tokens else 0.0
    end_base = np.log10(train_docs + SMOOTH) - floor

    def describe(these: pa.Array, counts: np.ndarray) -> pa.Array:
        packed = np.empty(len(these), [("n", "<i8"), ("at", "<i4")])
        packed["n"], packed["at"] = counts, inputs_of(these, counts, frequent)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(these), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())

    workers = len(RATES) * max(1, round(train_docs / WORKER_DOCS))

    def use(batch: pa.RecordBatch, codes: np.ndarray, first: np.ndarray, payloads: pa.Array) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(payloads.buffers()[2], [("n", "<i8"), ("at", "<i4")], len(payloads)) if len(payloads) else np.zeros(0, [("n", "<i8"), ("at", "<i4")])
        n, at = data["n"], data["at"]
        base = np.log10(n + SMOOTH) - floor
        # the share of its class that a word gets, if it has no output of its own
        k = np.maximum(at - FREQUENT, 0)
        again = (n + SMOOTH) / np.maximum(mass[k] + SMOOTH * members[k], SMOOTH)
        once = np.where(n == 1, (1 - UNSEEN_SHARE) / np.maximum(members[k], 1), UNSEEN_SHARE)
        inner = np.where(at < FREQUENT, 0.0, np.log10(np.where(n > 1, again, once)))
        ids, lengths = with_ends(at[codes], first, place)
        ends = np.r_[0, np.cumsum(lengths)] * 2
        body = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(np.int16).tobytes())])
        # by id and place in the block, so that neither copies nor rows without an id meet at one worker
        doc = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        worker = scrambled(scrambled(doc) + np.arange(len(doc), dtype=np.uint64)) % np.uint64(workers)
        sums = lambda x: np.diff(np.r_[0.0, np.cumsum(x)][first])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.invert(batch.column("train")), pa.array(worker.astype(np.int32)), pa.array(sums((n > 0)[codes].astype(float)).astype(np.int64) + (train_docs > 0)), pa.array(sums(base[codes]) + end_base), pa.array(sums(inner[codes])), body],
            ["doc_id", "held_out", "worker", "n_known", "base_score", "inner", "ids"],
        )

    schema = "doc_id long, held_out boolean, worker int, n_known long, base_score double, inner double, ids binary"
    coded = written(meet(blocks, distinct_words(words, describe), use, schema))
    model = fit(coded.where(~F.col("held_out")).select("worker", "ids"), model)
    context = docs.sparkSession.sparkContext.broadcast(flat(model))  # the model's size: about 0.9 MB
    like = Model({k: np.empty(v.shape, np.int8) for k, v in model.w.items()})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shaped(like, context.value)
        # by length, so that the documents of a slice end together
        by_length = (batch.take(pc.array_sort_indices(pc.binary_length(batch.column("ids")), order="descending")) for batch in batches)
        for batch in text_slices(by_length, SLICE_BYTES, "ids"):
            ids, lengths = indexes(batch.column("ids"))
            outer = log_probabilities(model, ids, lengths).astype(np.float64) / np.log(10)
            outer = np.diff(np.r_[0.0, np.cumsum(outer)][np.r_[0, np.cumsum(lengths)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), batch.column("n_known"), pa.array(np.full(len(lengths), tokens)), batch.column("base_score"), pa.array(outer + batch.column("inner").to_numpy())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return coded.select("doc_id", "held_out", "n_known", "base_score", "inner", "ids").mapInArrow(emit, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
