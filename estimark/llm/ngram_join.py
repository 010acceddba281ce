"""Similar documents by a chosen-path join on word 5-grams.

A document is the set of its shingles: five consecutive words (runs without white space, A-Z
lower-cased), or all its words if it has fewer. Equal sets are one set from here on. In each
run every set samples some of its shingles by a hash, and sets that sampled a common one share
a bucket. Buckets too large to compare are split again by another sampled shingle, level by
level; small ones are compared by their exact sets. A large bucket in which half of the sets
share their least shingle hash holds alike sets, which no split would part, and is not split. Runs repeat until a pair at the threshold
is missed with a probability of at most 1 - ``RECALL``. What stays large is compared exactly in
blocks. Links found join the sets to components, and in
these every pair is compared in blocks, so the counts of links are exact. A block of a group of
n sets holds about the root of ``BUCKET`` times n of them, so a group is copied to as many
places as it has blocks, the root of n over ``BUCKET``, and no task holds more than two blocks.

Documents without words (null, empty, white space) link with nothing. Repeated rows are copies
of each other. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.common import chunk_spans, components, emptied, lower_ascii, ranges, scrambled, span_hashes, text_bytes, text_slices, written
from estimark.llm.near_vectors import spanning

WORDS = 5
#: Shingles that two sets at the threshold both sample on average, levels, and sets of a bucket
#: that are compared at once. ``RECALL`` counts on buckets that take all levels.
RATE, LEVELS, BUCKET = 2.0, 3, 128
#: Sets of two blocks that are compared at once.
TILE = 512
RECALL = 0.9997
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - math.exp(-RATE)) ** LEVELS))
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' shingles, each document's sorted and distinct, and where each
    document's begin."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = chunk_spans(data, offsets)
    words = span_hashes(lower_ascii(data), starts, ends)
    n = np.diff(first)
    long = n >= WORDS
    at = ranges(first[:-1][long], n[long] - WORDS + 1)
    full = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        full += words[at + k] * _STEPS[k]
    full = scrambled(full)
    sizes = np.zeros(len(n), np.int64)
    sizes[long] = n[long] - WORDS + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for d in range(len(n)):
        if long[d]:
            out.append(np.unique(full[begin[d] : begin[d + 1]]))
        elif n[d]:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[first[d] : first[d + 1]].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def packed(own: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to compare two sets, too few to name one of all."""
    return (own >> np.uint64(16)).view(np.uint16).reshape(-1, 4)[:, :3].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    parts = np.frombuffer(blob, np.uint16).reshape(-1, 3)
    out = np.zeros((len(parts), 4), np.uint16)
    out[:, :3] = parts
    return out.view(np.uint64).ravel()


def set_id(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def sampled_sets(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, text_key, set, least, t0 ..): each document's set, its least shingle hash (the
    upper bits), and the shingles it samples at each level, with the run they are for."""
    odd = np.random.default_rng(5).integers(0, 1 << 63, (LEVELS, RUNS), np.uint64) * np.uint64(2) + np.uint64(1)
    pick = pa.list_(pa.struct([("run", pa.int32()), ("token", pa.int64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            all_, first = shingles(batch)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            bound = np.minimum(RATE / (least * np.maximum(1, np.diff(first))), 1.0)
            bound = np.minimum(bound * 2.0**64, 2.0**64 - 4096).astype(np.uint64)[doc]
            columns = []
            for level in range(LEVELS):
                chosen = [np.flatnonzero(all_ * odd[level, run] < bound) for run in range(RUNS)]
                at = np.concatenate(chosen)
                run = np.repeat(np.arange(RUNS, dtype=np.int32), [len(c) for c in chosen])
                order = np.argsort(at, kind="stable")
                at, run = at[order], run[order]
                ends = np.searchsorted(at, first).astype(np.int32)
                token = scrambled(all_[at] + np.uint64(level)).astype(np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(run), pa.array(token)], ["run", "token"]), type=pick))
            ids = [set_id(all_[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            head = np.zeros(batch.num_rows, np.int32)
            full = np.diff(first) > 0
            head[full] = (all_[first[:-1][full]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(ids, pa.binary()), pa.array(head), *columns], ["doc_id", "text_key", "set", "least", *[f"t{k}" for k in range(LEVELS)]])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(emit, "doc_id long, text_key long, set binary, least int, " + ", ".join(f"t{k} array<struct<run:int,token:long>>" for k in range(LEVELS)))


def shared_samples(sets: DataFrame, level: int) -> DataFrame:
    """(set, run, token): what sets sample at a level, if another set samples it in the same run.
    A bucket that went on by anything else would hold one set."""
    every = written(sets.select("set", F.explode(f"t{level}").alias("t")).select("set", "t.run", "t.token"))
    again = written(every.groupBy("run", "token").agg(F.count("*").alias("n")).where("n > 1").select("run", "token"))
    return written(every.join(again, ["run", "token"]).select("set", "run", "token"), every, again)


def buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small buckets (bucket, set), and the sets of buckets that stay large (group, set)."""
    now = sets.select("set", "least", F.explode("t0").alias("t")).select("set", "least", F.col("t.run").alias("run"), F.xxhash64(F.lit(0), "t.run", "t.token").alias("path"))
    small = stay = None
    for level in range(1, LEVELS + 1):
        if level > 1:
            now = written(now)
            if now.isEmpty():
                break
        # both sides of these joins are tables, so that Spark can split hot paths
        size = written(now.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        sized = written(now.join(size, "path"), size)
        done = sized.where(F.col("n") <= BUCKET).groupBy("path").agg(F.sort_array(F.collect_set("set")).alias("sets"))
        done = done.where(F.size("sets") > 1).select("sets")
        small = done if small is None else small.unionByName(done)
        now = sized.where(F.col("n") > BUCKET)
        if level < LEVELS:
            alike = written(now.groupBy("path", "least").agg(F.count("*").alias("alike")).groupBy("path").agg(F.max("alike").alias("alike")))
            now = written(now.join(alike, "path"), alike)
            dense = now.where(F.col("alike") * 2 >= F.col("n")).select("set", "path")
            stay = dense if stay is None else stay.unionByName(dense)
            split = now.where(F.col("alike") * 2 < F.col("n"))
            if split.isEmpty():
                now = split
                break
            more = split.join(shared_samples(sets, level), ["set", "run"])
            now = more.select("set", "least", "run", F.xxhash64("path", "token").alias("path")).distinct()
    small = small.distinct().select(F.xxhash64("sets").alias("bucket"), F.explode("sets").alias("set"))
    now = now.select("set", "path").unionByName(stay)
    if now.isEmpty():
        return small, None
    # buckets that share sets are one group, compared once
    low = now.groupBy("path").agg(F.min("set").alias("b"))
    groups = components(now.join(low, "path").select(F.col("set").alias("a"), "b"))
    return small, groups.select(F.col("component").alias("group"), F.col("node").alias("set"))


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, copies, shingles) for the ``wanted`` (doc_id, set, copies) rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            all_, first = shingles(batch)
            ids = [set_id(all_[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            good = [k for k, w in enumerate(batch.column("set").to_pylist()) if ids[k] == w]
            blobs = [packed(all_[first[k] : first[k + 1]]) for k in good]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in good], pa.binary()), batch.column("copies").take(pa.array(good, pa.int64())), pa.array(blobs, pa.binary())], ["set", "copies", "shingles"])

    wanted = wanted.select(F.col("doc_id").alias("id"), "set", "copies")
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "set", "copies")
    return rows.mapInArrow(emit, "set binary, copies long, shingles binary")


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with a Jaccard similarity of ``least`` or more, i of a and j of b
    (or i < j, both of a)."""
    sets = a if b is None else a + b
    sizes = np.array([len(x) for x in sets])
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = df[inverse] > 1
    column = np.cumsum(df > 1)[inverse[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(a)
    inter = np.zeros((n, n if b is None else len(b)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(max(256, (2 << 20) // len(sets)), columns)
    for lo in range(0, columns, max(1, width)):
        p, q = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[p:q], column[p:q] - lo] = 1
        inter += m[:n] @ (m if b is None else m[n:]).T
    union = sizes[:n, None] + (sizes[:n] if b is None else sizes[n:])[None, :] - inter
    near = inter >= least * union - 1e-6
    return np.nonzero(np.triu(near, 1) if b is None else near)


def compared(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(set, n, root) from comparing all sets of each group (group, set): linked documents
    besides its own copies, and a set that its links reach. Large groups are cut to blocks,
    and each pair of blocks is compared on its own, so a set has a row for each."""
    n = F.count("*")
    size = written(groups.groupBy("group").agg(F.ceil(n / F.greatest(F.lit(BUCKET), F.sqrt(BUCKET * n))).cast("int").alias("blocks")))
    rows = groups.join(size, "group").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    # a block meets itself once, alone
    rows = rows.select(key.alias("key"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "set")
    full = rows.join(sets, "set").repartition("key").sortWithinPartitions("key", "side", "set")

    def group_links(sides):
        """(set, n, root) of a block's sets or of two blocks', from tiles of them."""
        left, right = sides
        all_ = left + right
        bodies, copies = [x[1] for x in all_], np.array([x[2] for x in all_])
        count, frm, to = np.zeros(len(all_), np.int64), [], []
        for a in range(0, len(left), TILE):
            end = min(a + TILE, len(left))
            for b in range(len(left), len(all_), TILE) if right else range(a, len(left), TILE):
                i, j = similar(bodies[a:end], None if b == a else bodies[b : b + TILE], least)
                if not len(i):
                    continue
                m = end - a
                count[a:end] += np.bincount(i, copies[b + j], m).astype(np.int64)
                count[b : b + TILE] += np.bincount(j, copies[a + i], len(bodies[b : b + TILE])).astype(np.int64)
                name = np.arange(a, end) if b == a else np.r_[a:end, b : min(b + TILE, len(all_))]
                root = spanning(i, j + (b != a) * m, len(name))
                moved = np.flatnonzero(root != np.arange(len(root)))
                frm.append(name[moved])
                to.append(name[root[moved]])
        root = spanning(np.concatenate(frm), np.concatenate(to), len(all_)) if frm else np.arange(len(all_))
        return [(all_[x][0], int(count[x]), all_[root[x]][0]) for x in np.flatnonzero(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, out = None, ([], []), []

        def flush():
            nonlocal out
            t = list(zip(*out, strict=True)) if out else [[], [], []]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(t[0], pa.binary()), pa.array(t[1], pa.int64()), pa.array(t[2], pa.binary())], ["set", "n", "root"])

        for batch in batches:
            for k, side, name, blob, copies in zip(*[batch.column(c).to_pylist() for c in ("key", "side", "set", "shingles", "copies")], strict=True):
                if k != now:
                    if now is not None and len(sides[0]) + len(sides[1]) > 1 and sides[0]:
                        out += group_links(sides)
                    now, sides = k, ([], [])
                if not sides[side] or sides[side][-1][0] != name:
                    sides[side].append((name, unpacked(blob), copies))
            if len(out) > 5000:
                yield flush()
        if now is not None and len(sides[0]) + len(sides[1]) > 1 and sides[0]:
            out += group_links(sides)
        yield flush()

    return full.select("key", "side", "set", "shingles", "copies").mapInArrow(run, "set binary, n long, root binary")


def classes(docs: DataFrame, least: float = 0.8, count: bool = True) -> DataFrame:
    """(doc_id, text_key, n_links, class_id, kept, is_empty) for each document: other documents
    with a similarity of ``least`` or more (null, if they need no ``count``), the smallest doc_id
    that such links reach, and a hash of the text."""
    all_sets = written(sampled_sets(docs, least))
    of = all_sets.where("set IS NOT NULL")
    reps = written(of.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    sets = of.select("set", "least", *[f"t{k}" for k in range(LEVELS)]).dropDuplicates(["set"])
    small, large = buckets(sets)
    small = written(small)
    wanted = small.select("set") if large is None else small.select("set").unionByName(large.select("set"))
    bodies = written(shingles_of(docs, wanted.distinct().join(reps, "set")))
    found = compared(small.withColumnRenamed("bucket", "group"), bodies, least)
    if large is not None:
        found = found.select("set", "root").unionByName(compared(large, bodies, least).select("set", "root"))
    linked = written(components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))), small)
    info = reps.join(linked.withColumnRenamed("node", "set"), "set", "left")
    if count:
        counts = compared(linked.select(F.col("component").alias("group"), F.col("node").alias("set")), bodies, least).groupBy("set").agg(F.sum("n").alias("n"))
        info = info.join(written(counts), "set", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        info = info.withColumn("n", F.lit(None).cast("long"))
    emptied(bodies)
    info = info.select("set", "doc_id", "copies", F.coalesce("component", "set").alias("component"), "n")
    top = info.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    info = info.join(top, "component").select("set", "class_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    every = all_sets.select("doc_id", "text_key", "set").join(info, "set", "left")
    class_id = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    n_links = F.coalesce("n_links", F.lit(0)) if count else F.col("n_links")
    every = every.select("doc_id", "text_key", n_links.alias("n_links"), class_id.alias("class_id"), F.col("set").isNull().alias("is_empty"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class; documents without words all stay."""
    found = written(classes(docs, least, count=False))
    hashed = docs.withColumn("__key", F.xxhash64("text"))

    def match(rows: DataFrame, kind: str, frame: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
        return frame.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), kind)

    rest = match(found.where(~F.col("kept")), "left_anti", hashed)
    kept = found.where(F.col("kept") & ~F.col("is_empty"))
    # rows of one class that share the kept doc_id: one of them stays
    twins = kept.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    if not twins.isEmpty():
        rows = kept.join(twins, kept["class_id"].eqNullSafe(twins["class_id"]), "left_semi")
        rest = match(rows, "left_anti", rest).unionByName(match(rows, "left_semi", rest).dropDuplicates(["doc_id"]))
    return rest.select(docs.columns)
