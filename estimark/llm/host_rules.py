"""Quality rules by host: failures of documents are counted a host, the host's rates are shrunk
by a beta prior fitted to all hosts, and the hosts' verdicts go back to the documents.

One scan counts each text's words, symbols and repetitions; the counts, not the texts, are
written and go on. A rule is an expression over the counts. For each rule, the hosts' failures
are taken as binomial with rates of a beta distribution, whose mean and strength come from the
hosts' counts by moments; a host's rate is its posterior mean, so that a host of few documents is
judged mostly by the corpus. A host with a rate over the limit is rejected with all its documents.
A document that fails the base rules is rejected whatever its host.

Null and empty texts have no words. Documents without a host are judged alone. Repeated rows are
judged each and count each. Texts of any length are counted whole. Other columns are ignored. An
empty table gives an empty result. Where hosts have one document each, or there is one host only,
nothing tells hosts apart, and all rates are the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm.common import SPACE, _CLASS, pieces_array, split_runs, text_bytes, text_slices, written

#: Bytes of text counted at once.
SLICE = 4 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Bytes that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Rules that a text fails, by name; the first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "words": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ["short", "repetitive"]


def repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text (its words' codes begin at ``first``), how many of its words lie in a window
    of three words that is found twice or more in the text."""
    n, texts = len(codes), len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    begins = np.flatnonzero(text[2:] == text[:-2]) if n > 2 else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros(texts, np.int64)
    codes = codes.astype(np.int64)
    size = int(codes.max()) + 1
    pair = np.unique(text[begins] * size + codes[begins], return_inverse=True)[1]
    for step in (1, 2):
        key, at, counts = np.unique(pair * size + codes[begins + step], return_inverse=True, return_counts=True)
        pair = at
    twice = begins[counts[pair] > 1]
    hit = np.zeros(n, bool)
    for step in range(3):
        hit[twice + step] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[first[1:]] - total[first[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines that hold a word, and how many of them equal an earlier one."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros((2, texts), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    ends = np.flatnonzero(data == 10)
    cut[ends] = cut[ends + 1] = cut[offsets] = True
    cut[-1] = True
    bounds = np.flatnonzero(cut)
    word = np.add.reduceat(solid, bounds[:-1], dtype=np.int64) > 0
    code = pieces_array(data, bounds).dictionary_encode().indices.to_numpy(zero_copy_only=False)[word].astype(np.int64)
    text = np.searchsorted(offsets, bounds[:-1][word], "right") - 1
    distinct = np.unique(text * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1)
    n = np.bincount(text, minlength=texts)
    return n, n - np.bincount(distinct, minlength=texts)


def counted(docs: DataFrame, host: F.Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, host, and the counts): a row for each row of ``docs``."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), host.cast("string").alias("host"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE):
            data, offsets = text_bytes(batch.column("text"))
            solid = _CLASS[data] != SPACE
            coded, first = split_runs(data, offsets, True)
            within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
            counts = [np.diff(first), within(solid & ((data & 0xC0) != 0x80)), within(SYMBOLS[data]), *lines(data, offsets, solid), repeated_words(coded.indices.to_numpy(zero_copy_only=False), first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *[pa.array(c.astype(np.int64)) for c in counts]], ["doc_id", "host", *COUNTS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def prior(n: int, hosts: int, squares: int, fails: int, spread: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the beta distribution of hosts' rates, by the moments
    of ``hosts`` hosts with n documents in all. squares: sum of their squared counts; fails: failing documents;
    spread: sum of squared failures divided by the count."""
    if not n:
        return 0.0, 1.0
    mean, weakest = fails / n, 1e-6
    if hosts < 2 or n == hosts:
        return mean, 1 / weakest - 1
    between, inside = (spread - n * mean**2) / (hosts - 1), (fails - spread) / (n - hosts)
    size = (n - squares / n) / (hosts - 1)
    alike = (between - inside) / (between + (size - 1) * inside) if between + (size - 1) * inside > 0 else 0.0
    return mean, 1 / min(max(alike, weakest), 1 - weakest) - 1


def host_verdicts(counts: DataFrame, rules: dict[str, str] = RULES, limit: float = 0.5) -> DataFrame:
    """(host, n_docs, fail_rate, host_kept): a host is kept unless the shrunk rate of a rule is over
    the limit; fail_rate is the greatest of these rates. One row of sums comes to the driver."""
    fails = [F.sum(F.coalesce(F.expr(rule), F.lit(False)).cast("long")).alias(f"f_{name}") for name, rule in rules.items()]
    hosts = counts.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *fails)
    n = F.col("n_docs")
    moments = [x for name in rules for x in (F.sum(f"f_{name}").alias(f"s_{name}"), F.sum(F.col(f"f_{name}") * F.col(f"f_{name}") / n).alias(f"q_{name}"))]
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), F.sum(n * n.cast("decimal(38,0)")).alias("squares"), *moments).first()
    rates = []
    for name in rules:
        mean, strength = prior(int(sums["n"] or 0), sums["hosts"], int(sums["squares"] or 0), int(sums[f"s_{name}"] or 0), float(sums[f"q_{name}"] or 0))
        rates.append((F.col(f"f_{name}") + F.lit(mean * strength)) / (n + F.lit(strength)))
    return hosts.select("host", "n_docs", (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("fail_rate")).withColumn("host_kept", F.col("fail_rate") <= limit)


def verdicts(docs: DataFrame, host: F.Column, rules: dict[str, str] = RULES, base: list[str] = BASE, limit: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, host, the counts, base_failed, fail_rate, kept): a row for each row of ``docs``.
    Rows of a host that holds much of the corpus meet one row of verdicts, which Spark's skew join splits."""
    counts = written(counted(docs, host, doc_id, text))
    failed = F.lit(False)
    for name in base:
        failed = failed | F.expr(rules[name])
    both = counts.withColumn("base_failed", failed).join(host_verdicts(counts, rules, limit), "host", "left")
    return both.select("doc_id", "host", *COUNTS, "base_failed", "fail_rate", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))
