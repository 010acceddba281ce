"""Packing of documents into token sequences by lexical retrieval.

Documents are tokenised by the distinct-word table of ``bpe`` and stay in the blocks in which
they meet their words. Each block is a shard with a BM25 inverted index over its documents'
words. A seed document opens a sequence; its best unused neighbours by BM25 fill it. What
doesn't fit is cut, and the rest opens the next sequence as its seed, so only a shard's last
sequence can be short.

Every document ends with the id ``END_ID``; null and empty texts have that id alone. Rows that
repeat a doc_id are packed each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from estimark.llm.bpe import ids_of, word_ids
from estimark.llm.wordblocks import with_vocabulary

SEQUENCE, END_ID = 2048, 1
#: BM25's parameters; a query is its document's QUERY_TERMS rarest shared words, and words that
#: more than one in COMMON documents have don't tell documents apart (None for either: all words,
#: which is plain BM25). Neighbours are ranked in slices: first the best SLICE, and all others if
#: these don't fill the sequence.
K1, B, QUERY_TERMS, COMMON, SLICE = 1.2, 0.75, 24, 8, 32


class Index:
    """Inverted index of a shard: postings by word with their BM25 weights. Documents all of
    whose shared words are common (large groups of copies) are listed by their least words."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, size: int, terms: int | None = QUERY_TERMS, common: int | None = COMMON):
        n, self.terms = len(first) - 1, terms
        lengths = np.diff(first)
        # a word that occurs once is in one document; copies of a pair follow each other when sorted
        shared = (np.bincount(codes, minlength=size) > 1)[codes]
        pairs = np.repeat(np.arange(n, dtype=np.int32), lengths)[shared] * np.int64(size)
        pairs += codes[shared]
        pairs.sort()
        begin = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf, pairs = np.diff(begin, append=len(pairs)), pairs[begin]
        doc, word = np.divmod(pairs, np.int64(size))
        del shared, pairs, begin
        df = np.bincount(word, minlength=size)
        # numbers rise as words get rarer, so the last two words of a document tell its group
        start, last = np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(n), "right")
        tail = lambda k: np.where(last - k >= start, word[np.maximum(last - k, 0)], -1) if len(word) else np.full(n, -1)
        group = np.where(last == start, -1, tail(1) * (size + 1) + tail(2) + 1)
        kept = (df[word] > 1) & (df[word] <= (n if common is None else max(2, n // common)))
        doc, word, tf = doc[kept].astype(np.int32), word[kept].astype(np.int32), tf[kept]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        weight = (idf[word] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.df, self.words, self.begin = df, word, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(word, kind="stable")
        self.posted, self.weight = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=size))])
        common = np.flatnonzero((np.diff(self.begin) == 0) & (group >= 0))
        self.group, self.alike = group, {}
        for d in common[::-1].tolist():
            self.alike.setdefault(int(group[d]), []).append(d)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share rare words with the seed, best first."""
        words = self.words[self.begin[seed] : self.begin[seed + 1]]
        if not len(words):
            yield from self.of_group(int(self.group[seed]), unused)
            return
        if self.terms is not None and len(words) > self.terms:
            words = words[np.argpartition(self.df[words], self.terms)[: self.terms]]
        lists = [slice(self.at[w], self.at[w + 1]) for w in words.tolist()]
        docs = np.concatenate([self.posted[x] for x in lists])
        weight = np.concatenate([self.weight[x] for x in lists])
        live = unused[docs]
        found, inverse = np.unique(docs[live], return_inverse=True)
        if not len(found):
            return
        score = np.bincount(inverse, weight[live])
        if len(found) > 2 * SLICE:
            edge = np.partition(score, len(score) - SLICE)[len(score) - SLICE]
            best = score >= edge  # with all ties
            yield from found[best][np.lexsort((found[best], -score[best]))].tolist()
            found, score = found[~best], score[~best]
        yield from found[np.lexsort((found, -score))].tolist()

    def of_group(self, group: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with the same least words; each is looked at once."""
        held = self.alike.get(group, [])
        while held:
            d = held.pop()
            if unused[d]:
                yield d


def pack(lengths: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    out: list[tuple[int, int, int, int, int]] = []
    unused = np.ones(len(lengths), bool)
    sequence = fill = 0
    seeds = iter(np.argsort(-lengths, kind="stable").tolist())
    sizes = lengths.tolist()

    def place(doc: int) -> bool:
        """Puts the document down; true if it runs over into a new sequence."""
        nonlocal sequence, fill
        unused[doc] = False
        start, opened = 0, False
        while start < sizes[doc]:
            n = min(SEQUENCE - fill, sizes[doc] - start)
            out.append((doc, start, n, sequence, fill))
            start, fill = start + n, fill + n
            if fill == SEQUENCE:
                sequence, fill = sequence + 1, 0
                opened = start < sizes[doc]
        return opened

    seed = next((s for s in seeds if unused[s]), None)
    if seed is not None:
        place(seed)
    while seed is not None:
        follow = None
        for doc in index.neighbours(seed, unused) if fill else ():
            if place(doc):
                follow = doc  # its rest opens the next sequence
                break
            if not fill:
                break
        if follow is None:
            follow = next((s for s in seeds if unused[s]), None)
            if follow is not None:
                place(follow)
        seed = follow
    return out


def packed_pieces(docs: DataFrame, path: str, terms: int | None = QUERY_TERMS, common: int | None = COMMON) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece. terms and
    common: how many words ask for neighbours, and which are too common to (None: all, plain BM25)."""

    def use(batch: pa.RecordBatch, codes: np.ndarray, first: np.ndarray, payloads: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, begin = ids_of(codes, first, payloads)
        lengths = np.diff(begin) + 1
        ends = np.cumsum(lengths)
        full = np.full(int(ends[-1]), END_ID, "<u4")
        inner = np.ones(len(full), bool)
        inner[ends - 1] = False
        full[inner] = ids
        del ids, inner
        found = pack(lengths, Index(codes, first, len(payloads), terms, common))
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
        view, at = memoryview(full).cast("B"), (ends - lengths)[doc] + start
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        sequence += sequence_base(int(sequence[-1]) + 1)
        columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    given = [None, 0]

    def sequence_base(n: int) -> int:
        """The first of the next n sequence numbers of this task: numbers are unique over tasks."""
        part = TaskContext.get().partitionId()
        if given[0] != TaskContext.get().taskAttemptId():
            given[:] = TaskContext.get().taskAttemptId(), 0
        base = (part << 40) + given[1]
        given[1] += n
        return base

    return with_vocabulary(docs.select("doc_id", "text"), word_ids(path), use, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
