"""BPE encoding and decoding through a table of distinct words.

Words are split in batches, their distinct forms are tokenised once each, and the ids come
back to every document by (block, word) and position. Decoding takes each id's piece from the
tokenizer's id-to-piece table, whose size is the vocabulary's (49,408 rows here), and joins the
pieces with a space, as the tokenizer does when it has no decoder.

Null and empty texts have no tokens and decode to the empty string. Repeated rows are encoded
each. Other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from estimark.llm.wordblocks import with_vocabulary

#: Words that go to the tokenizer in one call.
WORDS_A_CALL = 2000


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=2)
def id_to_piece(path: str) -> tuple[pa.Array, pa.Array]:
    """For each id its piece, and its decimal digits, both with a space behind."""
    tok = tokenizer(path)
    n = tok.get_vocab_size(with_added_tokens=True)
    return (
        pa.array([((tok.id_to_token(i) or "") + " ").encode() for i in range(n)], pa.binary()),
        pa.array([f"{i} ".encode() for i in range(n)], pa.binary()),
    )


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word as packed unsigned 16-bit numbers; a word holds no ASCII white space."""
    tok = tokenizer(path)
    if tok.get_vocab_size(with_added_tokens=True) > 1 << 16:
        raise ValueError("the tokenizer has more ids than 16 bits hold")
    out = []
    for at in range(0, len(words), WORDS_A_CALL):
        part = [w.decode("utf-8", "replace") for w in words[at : at + WORDS_A_CALL]]
        found = tok.encode("\n".join(part), add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.cumsum([len(w) + 1 for w in part])
        begins = np.array([o[0] for o in found.offsets], np.int64)
        cuts = np.searchsorted(np.searchsorted(ends, begins, "right"), np.arange(len(part) + 1))
        packed = ids.astype("<u2").tobytes()
        out += [packed[2 * a : 2 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def word_ids(path: str):
    return lambda words, _: pa.array(encode_words(words.to_pylist(), path), pa.binary())


def ids_of(codes: np.ndarray, first: np.ndarray, payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block's documents in order, and where each document's begin."""
    offsets = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1] // 2 if len(payloads) else np.zeros(1, np.int32)
    data = payloads.buffers()[2] if len(payloads) else None
    flat = np.frombuffer(data, "<u2", count=int(offsets[-1])) if data is not None else np.zeros(0, "<u2")
    counts = np.diff(offsets)[codes]
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    at = np.repeat((offsets[:-1][codes] - total[:-1]).astype(np.int32), counts)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], total[first]


def joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The table's strings for all ids, one after the other, and where each begins."""
    strings = table.take(pa.array(ids))
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1]
    return memoryview(strings.buffers()[2] or b""), offsets


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (packed unsigned 16-bit), decoded text."""

    def use(batch, codes, first, payloads):
        ids, first = ids_of(codes, first, payloads)
        pieces, _ = id_to_piece(path)
        text, at = joined(pieces, ids)
        packed = ids.astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first)), pa.array([packed[2 * a : 2 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
             pa.array([bytes(text[at[a] : max(at[a], at[b] - 1)]).decode() for a, b in zip(first[:-1], first[1:], strict=True)], pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )

    return with_vocabulary(docs.select("doc_id", "text"), word_ids(path), use, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the decimal ids joined by one space,
    decoded_sha256 of the decoded text. The same work as encode_decode, hashed in place."""

    def use(batch, codes, first, payloads):
        ids, first = ids_of(codes, first, payloads)
        pieces, decimals = id_to_piece(path)
        columns = []
        for table in (decimals, pieces):
            text, at = joined(table, ids)
            columns.append(pa.array([hashlib.sha256(text[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_vocabulary(docs.select("doc_id", "text"), word_ids(path), use, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
