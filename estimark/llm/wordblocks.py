"""Distinct words of blocks of documents, and blocks meeting what a table says of their words.

A block is a batch of documents as its table's scan delivers it. One scan gives the distinct
words of each block, numbered by how often they occur; another gives the documents as numbers
of words. What is known of each distinct word comes back by block and number. The two scans
must deliver the same batches, as scans of files do; write anything else to a table first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.common import lower_ascii, split_runs, text_bytes, text_slices, written

#: Rows of distinct words that a task packs at once.
PACK_ROWS = 200_000


def block_of(batch: pa.RecordBatch) -> int:
    """An id of a batch from what it holds, the same whenever the batch is computed again."""
    data, offsets = text_bytes(batch.column("text"))
    digest = xxhash.xxh3_64(offsets.tobytes())
    digest.update(data.tobytes())
    digest.update(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).tobytes())
    return int(np.uint64(digest.intdigest()).astype(np.int64))


def special_in_capitals(data: np.ndarray) -> bool:
    """True if lower-casing might turn some text into one of the tokenizer's markers."""
    bars = np.flatnonzero(data[:-1] == 124) if len(data) else data
    return bool(len(bars)) and bool(((data[bars + 1] >= 65) & (data[bars + 1] <= 90) | (data[bars + 1] == 115) | (data[bars + 1] == 101)).any())


def numbered(batch: pa.RecordBatch, chunks: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The (A-Z lower-cased) words of a batch as numbers, where each document's begin, and the
    word for each number, the most frequent first."""
    data, offsets = text_bytes(batch.column("text"))
    if chunks or not special_in_capitals(data):
        data = lower_ascii(data)
    coded, first = split_runs(data, offsets, chunks)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    times = np.bincount(codes, minlength=len(coded.dictionary))
    order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
    rank = np.zeros(len(times), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return rank[codes], first, coded.dictionary.take(pa.array(order))


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of all of them, compressed."""
    planes = [((values >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8).tobytes() for k in range(4)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def restored(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).astype(np.uint32)
    return planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16) | planes[3] << np.uint32(24)


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def block_words(docs: DataFrame, chunks: bool, train: str | None = None) -> DataFrame:
    """(word, block, at, n): the distinct words of each block with their numbers and counts in
    the rows where ``train`` is true (in all rows, if no such column is named)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            codes, first, words = numbered(batch, chunks)
            if train:
                codes = codes[np.repeat(batch.column(train).to_numpy(zero_copy_only=False), np.diff(first))]
            n, block = np.bincount(codes, minlength=len(words)).astype(np.int32), block_of(batch)
            for at in range(0, len(words), 100_000):
                part = np.arange(at, min(at + 100_000, len(words)), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([words.slice(at, len(part)), pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[part])], ["word", "block", "at", "n"])

    return docs.select("doc_id", "text", *([train] if train else [])).mapInArrow(emit, "word binary, block long, at int, n int")


def blocks_of_documents(docs: DataFrame, chunks: bool, keep: list[str]) -> DataFrame:
    """(block, part = 0, data, rest): each block's words as numbers, and its documents' columns
    ``keep`` with their counts of words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            codes, first, _ = numbered(batch, chunks)
            rest = pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(np.diff(first))], [*keep, "words"])
            yield pa.RecordBatch.from_arrays([pa.array([block_of(batch)]), pa.array([0], pa.int32()), pa.array([squeezed(codes)], pa.binary()), pa.array([packed(rest)], pa.binary())], ["block", "part", "data", "rest"])

    return docs.select(*dict.fromkeys(["doc_id", "text", *keep])).mapInArrow(emit, "block long, part int, data binary, rest binary")


def words_and_blocks(docs: DataFrame, chunks: bool, keep: list[str], train: str) -> tuple[DataFrame, DataFrame]:
    """``block_words`` and ``blocks_of_documents`` from one scan, which both read as one written
    table, so the documents are numbered once and their scan need not be the same twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "block", "at", "n", "data", "rest"]
        for batch in text_slices(batches):
            codes, first, words = numbered(batch, chunks)
            taught = codes[np.repeat(batch.column(train).to_numpy(zero_copy_only=False), np.diff(first))]
            n, block = np.bincount(taught, minlength=len(words)).astype(np.int32), block_of(batch)
            for at in range(0, len(words), 100_000):
                part = np.arange(at, min(at + 100_000, len(words)), dtype=np.int32)
                none = pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([words.slice(at, len(part)), pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[part]), none, none], names)
            rest = pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(np.diff(first))], [*keep, "words"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([block]), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([squeezed(codes)], pa.binary()), pa.array([packed(rest)], pa.binary())], names)

    both = written(docs.select(*dict.fromkeys(["doc_id", "text", *keep, train])).mapInArrow(emit, "word binary, block long, at int, n int, data binary, rest binary"))
    blocks = both.where("at < 0").select("block", F.lit(0).alias("part"), "data", "rest")
    return both.where("at >= 0").select("word", "block", "at", "n"), blocks


def distinct_words(words: DataFrame, describe: Callable) -> DataFrame:
    """(block, part = -1, data, rest): what ``describe(words, counts)`` says of each distinct
    word, asked once a word, packed for the blocks that hold the word.

    Words meet by a shuffle on the word: a row for each block it occurs in, never one for each
    occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(k) for h in held]) for k in range(5)], ["word", "block", "at", "n", "hash"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACK_ROWS:
                now = rows()
                last = pc.index(now.column("hash"), now.column("hash")[size - 1]).as_py()
                held, size = [now.slice(last)], size - last  # the last hash's words may go on
                if last:
                    yield from describe_rows(now.slice(0, last))
        if size:
            yield from describe_rows(rows())

    def describe_rows(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([rows.column("word")]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        totals = np.bincount(codes, rows.column("n").to_numpy(zero_copy_only=False), len(coded.dictionary)).astype(np.int64)
        payload = describe(coded.dictionary, totals)
        blocks, at = rows.column("block").to_numpy(zero_copy_only=False), rows.column("at").to_numpy(zero_copy_only=False)
        order = np.lexsort((at, blocks))
        cuts = [0, *(np.flatnonzero(np.diff(blocks[order])) + 1).tolist(), len(order)]
        keys, data, rest = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            keys.append(int(blocks[own[0]]))
            data.append(squeezed(np.diff(at[own], prepend=0).astype(np.uint32)))
            rest.append(packed(pa.RecordBatch.from_arrays([payload.take(pa.array(codes[own]))], ["payload"])))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), -1, np.int32)), pa.array(data, pa.binary()), pa.array(rest, pa.binary())], ["block", "part", "data", "rest"])

    # by one number, which sorts without comparing words; words of one hash stay together
    dealt = words.select("word", "block", "at", "n").repartition("word").withColumn("hash", F.xxhash64("word"))
    return dealt.sortWithinPartitions("hash").mapInArrow(run, "block long, part int, data binary, rest binary")


def meet(blocks: DataFrame, words: DataFrame, use: Callable, schema: str) -> DataFrame:
    """``use(rest, codes, first, payloads)`` for each block: its documents' kept columns, their
    words as numbers, where each document's begin, and what is said of each number's word.

    Both go to the block's partition, words first; a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, payloads = None, [], None
        for batch in batches:
            for block, part, data, rest in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if block != now:
                    now, held, payloads = block, [], None
                if part < 0:
                    held.append((np.cumsum(restored(data)), unpacked(rest).column(0)))
                    continue
                codes, rest = restored(data), unpacked(rest)
                if payloads is None:
                    at = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                    at, where = np.unique(at, return_index=True)
                    if len(at) != int(codes.max(initial=0)) + bool(len(codes)):
                        raise ValueError("the documents' scans disagree; write them to a table first")
                    payloads = pa.concat_arrays([h[1] for h in held]).take(pa.array(where)) if held else pa.array([], pa.binary())
                    held = []
                first = np.concatenate([[0], np.cumsum(rest.column("words").to_numpy())])
                yield from use(rest, codes, first, payloads)
                del codes, rest, first
                pa.default_memory_pool().release_unused()

    return blocks.unionByName(words).repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def with_vocabulary(docs: DataFrame, describe: Callable, use: Callable, schema: str, chunks: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run ``use`` (see ``meet``) on blocks of documents (doc_id, text), each with what
    ``describe`` says of its own words.

    Neither the table of distinct words nor a block is broadcast or held by one task."""
    return meet(blocks_of_documents(docs, chunks, list(keep)), distinct_words(block_words(docs, chunks), describe), use, schema)
