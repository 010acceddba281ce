"""Removal of bytes in long strings that occur more than once, anywhere in the corpus.

Every window of ``length`` bytes has one anchor, the least hash among its 64-byte strings, so
equal windows share it. Runs of windows with one anchor are segments. An anchor that occurs
once has no repeated window, and segments that are equal as a whole repeat as a whole. One of
each other kind of segment meets those with its anchor. There, positions become symbols (the
string of ``length / n`` bytes that begins there), and a position's suffix is its symbol,
the one ``length / n`` bytes on, and so on: a window is repeated if, and only if, its suffix
shares its first n symbols with another suffix. Shards of segments, dealt by their documents,
get their Burrows-Wheeler transforms, which merge by interleave refinement, and the common
prefixes that the merging finds tell which windows are repeated.

An anchor with more segments than one task should hold is cut to narrower pieces, whose
windows all hold a longer common core, until the pieces with one core fit; a piece of one
window is its own core, and equal ones are counted.

Texts are UTF-8 bytes; null is empty. Windows never cross documents. Texts shorter than
``length`` lose nothing. Repeated rows are copies of each other, so each loses all its windows.
In ``without_repeats`` a character of which only some bytes are removed goes as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.bwt import SHARDS, common_prefixes
from estimark.llm.common import ranges, scrambled, span_hashes, text_bytes, text_slices, written

LENGTH, SEED_BYTES = 400, 64
#: Bytes of the segments that one task merges at once, and of an anchor's segments at most.
MERGE_BYTES = 1 << 20
#: Bytes of texts that one task looks at at once; its arrays take about 70 times as much.
SLICE_BYTES = 1 << 20
#: Windows of the pieces that hot segments are cut to, as shares of ``length``, level by level.
SHARES = (4, 40)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.unhex(F.md5("text")))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(h)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' segments: first and last window, the anchor's place and its hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    seeds = np.arange(len(data) - SEED_BYTES + 1)
    h = span_hashes(data, seeds, seeds + SEED_BYTES)
    bits = np.uint64(int(len(data)).bit_length())
    place = ((h >> bits) << bits) | seeds.astype(np.uint64)
    least = (window_minima(place, length - SEED_BYTES + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int64)
    begin, end = np.minimum(offsets[:-1], len(least)), np.clip(offsets[1:] - length + 1, 0, len(least))
    some = end > begin
    np.add.at(inside, begin[some], 1)
    np.add.at(inside, end[some], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    anchor = least[window]
    cut = np.r_[True, (np.diff(anchor) != 0) | (np.diff(window) != 1)]
    starts = np.flatnonzero(cut)
    # a text's last window and the next one's first can be neighbours only if they have other anchors
    return window[starts], window[np.r_[starts[1:], len(window)] - 1], anchor[starts], h[anchor[starts]]


def corpus_segments(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, segment, key, first, last, at): windows first .. last of the text ``key`` have
    the anchor at byte ``at``; ``segment`` is the hash of all their bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            first, last, at, anchor = segments(data, offsets, length)
            doc = np.searchsorted(offsets, first, "right") - 1
            segment = scrambled(span_hashes(data, first, last + length) + (at - first).astype(np.uint64)) if len(first) else anchor
            base = offsets[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int64)), pa.array(segment.astype(np.int64)), batch.column("key").take(pa.array(doc)), *[pa.array((x - base).astype(np.int32)) for x in (first, last, at)]],
                ["anchor", "segment", "key", "first", "last", "at"],
            )

    return docs.select("text", "key").mapInArrow(emit, "anchor long, segment long, key binary, first int, last int, at int")


PIECE = "core long, key binary, first int, at int, copies long, body binary"


def bodies(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The segments in ``rows`` (anchor, key, first, last, at, copies) with their bytes; their
    core is the anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("list")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]))
            core, first, last, at, copies = lists.flatten().flatten()
            a = offsets[owner] + first.to_numpy()
            b = offsets[owner] + last.to_numpy() + length
            body = [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([core, batch.column("key").take(pa.array(owner)), first, at, copies, pa.array(body, pa.binary())], ["core", "key", "first", "at", "copies", "body"])

    lists = rows.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last", "at", "copies")).alias("list"))
    # copies of a text would give the same segments again
    texts = docs.groupBy("key").agg(F.first("text").alias("text")).join(lists, "key")
    return texts.mapInArrow(emit, PIECE)


def narrower(wide: DataFrame, length: int, windows: int, with_body: bool) -> DataFrame:
    """Pieces of ``windows`` windows at most. They are cut at multiples of ``windows`` before
    the anchor, the same in all its segments, and the core is what all windows of a full piece
    hold. Without bodies, (core, copies, bytes)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES // (length // windows), "body"):
            data, offsets = text_bytes(batch.column("body"))
            first, at, copies = (batch.column(c).to_numpy() for c in ("first", "at", "copies"))
            last = first + np.diff(offsets) - length
            low, high = (at - last) // windows, (at - first) // windows
            n = high - low + 1
            row, d = np.repeat(np.arange(len(first)), n), ranges(low, n)
            begin = np.maximum(first[row], at[row] - d * windows - windows + 1)
            end = np.minimum(last[row], at[row] - d * windows)
            base = offsets[row] - first[row]
            core = base + at[row] - d * windows
            core = scrambled(span_hashes(data, core, core + length - windows + 1) + d.astype(np.uint64)).astype(np.int64)
            if not with_body:
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(copies[row]), pa.array((end - begin + length).astype(np.int64))], ["core", "copies", "bytes"])
                continue
            # a piece of one window is its core
            body = [data[x:y].tobytes() for x, y in zip((base + begin).tolist(), (base + end + length).tolist(), strict=True)] if windows > 1 else [b""] * len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core), batch.column("key").take(pa.array(row)), pa.array(begin.astype(np.int32)), batch.column("at").take(pa.array(row)), pa.array(copies[row]), pa.array(body, pa.binary())], ["core", "key", "first", "at", "copies", "body"]
            )

    return wide.mapInArrow(emit, PIECE if with_body else "core long, copies long, bytes long")


def symbols_of(length: int) -> int:
    """Of how many symbols a window consists: the fewest, from four on, that divide it."""
    return next(n for n in range(4, length + 1) if length % n == 0)


def repeated_windows(pieces: list[bytes], shard: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece and place of each window that occurs again among the pieces."""
    n = symbols_of(length)
    step = length // n
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.r_[0, np.cumsum([len(b) for b in pieces])].astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), np.diff(offsets) - step + 1)
    at = ranges(offsets[:-1], np.diff(offsets) - step + 1)
    _, symbol, times = np.unique(span_hashes(data, at, at + step), return_inverse=True, return_counts=True)
    # only windows whose symbols all occur again can; what's between them ends a string
    again = np.zeros(len(data), bool)
    again[at] = (times[symbol] > 1) | (copies[owner] > 1)
    window = ranges(offsets[:-1], np.diff(offsets) - length + 1)
    window = window[np.logical_and.reduce([again[window + k * step] for k in range(n)])]
    part = np.zeros(len(data), bool)
    for k in range(n):
        part[window + k * step] = True
    kept = part[at]
    at, owner, symbol = at[kept], owner[kept], symbol[kept]
    if not len(at):
        return at, at
    # strings go on from a position to the one a symbol further, shard by shard
    order = np.lexsort((at, (at - offsets[owner]) % step, owner, shard[owner]))
    at, owner, symbol = at[order], owner[order], symbol[order]
    begins = np.r_[True, (np.diff(at) != step) | (np.diff(owner) != 0)]
    heads = np.flatnonzero(begins)
    place = np.arange(len(at)) + np.cumsum(begins) - 1
    full = np.zeros(len(at) + len(heads), np.int64)
    full[place] = symbol + 1
    shared = common_prefixes(full, shard[owner[heads]])[place]
    found = np.zeros(len(data), bool)
    found[at[(shared >= n)]] = True
    found[window[(copies > 1)[np.searchsorted(offsets, window, "right") - 1]]] = True
    found = np.flatnonzero(found)
    piece = np.searchsorted(offsets, found, "right") - 1
    return piece, found - offsets[piece]


def compared(found: DataFrame, length: int) -> DataFrame:
    """(key, first, last): runs of repeated windows among pieces with equal cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, core = 0, None

        def out():
            _, key, first, copies, body = zip(*held, strict=True)
            # keys are digests, so their first byte deals documents to shards
            piece, at = repeated_windows(list(body), np.array([k[0] % SHARDS for k in key]), np.array(copies), length)
            edge = (np.diff(piece) != 0) | (np.diff(at) != 1)
            start, stop = np.flatnonzero(np.r_[True, edge][: len(at)]), np.flatnonzero(np.r_[edge, True][-len(at) :] if len(at) else edge)
            base = np.array(first, np.int64)[piece[start]]
            yield pa.RecordBatch.from_arrays([pa.array([key[k] for k in piece[start]], pa.binary()), pa.array((at[start] + base).astype(np.int32)), pa.array((at[stop] + base).astype(np.int32))], ["key", "first", "last"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("core", "key", "first", "copies", "body")], strict=True):
                if row[0] != core and size > MERGE_BYTES:
                    yield from out()
                    held, size = [], 0
                core = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield from out()

    return found.select("core", "key", "first", "copies", "body").repartition("core").sortWithinPartitions("core").mapInArrow(run, "key binary, first int, last int")


def compared_hot(hot: DataFrame, length: int) -> DataFrame:
    """As ``compared``, for segments too many to meet by their anchors alone."""
    done = None
    for share in SHARES:
        windows = max(1, length // share)
        sizes = narrower(hot, length, windows, False).groupBy("core").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
        sizes = written(sizes.select("core", (F.col("bytes") > MERGE_BYTES).alias("hot")))
        pieces = written(narrower(hot, length, windows, True).join(sizes, "core"), hot, sizes)
        part = compared(pieces.where("not hot"), length)
        done = part if done is None else done.unionByName(part)
        hot = pieces.where("hot").drop("hot")
        if hot.isEmpty():
            return done
    single = narrower(hot, length, 1, False).groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1")
    single = written(single.select("core"))
    return done.unionByName(narrower(hot, length, 1, True).join(single, "core").select("key", "first", F.col("first").alias("last")))


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(key, runs): for each distinct text its runs of repeated windows."""
    if length <= SEED_BYTES + max(1, length // SHARES[0]):
        raise ValueError(f"strings of {length} bytes are too short for anchors of {SEED_BYTES}")
    every = written(corpus_segments(docs, length))
    # both sides of these joins are tables, so that Spark can split hot anchors
    again = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    rows = written(every.join(again, "anchor"), every, again)
    kinds = rows.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("key", "first", "last", "at")).alias("one"))
    kinds = written(kinds)
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("one.last") - F.col("one.first") + length).alias("bytes")).where("kinds > 1")
    mixed = written(mixed.select("anchor", (F.col("bytes") > MERGE_BYTES).alias("hot")))
    ones = written(kinds.join(mixed, "anchor").select("anchor", "one.*", "copies", "hot"), mixed)
    part = compared(bodies(docs, ones.where("not hot"), length), length)
    if not ones.where("hot").isEmpty():
        part = part.unionByName(compared_hot(written(bodies(docs, ones.where("hot"), length)), length))
    part = written(part, ones)
    twice = written(kinds.where("copies > 1").select("anchor", "segment"), kinds)
    whole = rows.join(twice, ["anchor", "segment"]).select("key", "first", "last")
    runs = whole.unionByName(part).distinct()
    # written before the texts are dealt out again, so that segments and texts don't fill the disk together
    return written(runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs")), rows, twice, part)


def spans(runs: pa.ListArray, k: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed spans (start, end) of document k."""
    out: list[tuple[int, int]] = []
    for run in sorted((r["first"], r["last"]) for r in runs[k].as_py() or []):
        a, b = run[0], run[1] + length
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document, without its strings
    of ``length`` bytes that occur again."""
    docs = keyed(docs.select("doc_id", "text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column("text")):
                body, found = text.as_buffer(), spans(batch.column("runs"), k, length)
                digest, at = hashlib.sha256(), 0
                body = memoryview(body) if body is not None else memoryview(b"")
                for a, b in found:
                    digest.update(body[at:a])
                    at = b
                digest.update(body[at:])
                out.append((len(body), sum(b - a for a, b in found), len(found), digest.hexdigest()))
            t = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in t[:3]], pa.array(t[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(repeated_runs(docs, length), "key", "left").select("doc_id", "text", "runs").mapInArrow(emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; other columns are as they were."""
    names, types = docs.columns, dict(docs.dtypes)
    runs = repeated_runs(keyed(docs.select("text")), length)
    inner = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text")).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    joined = inner.join(runs, "key", "left").select("row", "runs")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            columns = dict(zip(names, row.flatten(), strict=True))
            texts = []
            for k, text in enumerate(columns["text"]):
                body, at, kept = text.as_buffer(), 0, []
                if body is None:
                    texts.append(None)
                    continue
                body = memoryview(body)
                for a, b in spans(batch.column("runs"), k, length):
                    kept.append(bytes(body[at:a]).decode("utf-8", "ignore"))
                    at = b
                texts.append("".join([*kept, bytes(body[at:]).decode("utf-8", "ignore")]))
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return joined.mapInArrow(emit, ", ".join(f"`{n}` {types[n]}" for n in names))
