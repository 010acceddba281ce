"""Burrows-Wheeler transforms of collections of symbol strings and their merging.

Each shard's suffixes are sorted once. Two shards merge by refining the interleave of their
transforms: one pass puts the suffixes in order by one more symbol, and the pass that first
tells two neighbours apart gives their common prefix. No pass compares suffixes or sorts them
again. A string's end sorts before all symbols and is no part of a common prefix.
"""

from __future__ import annotations

import numpy as np

SHARDS = 4


class Transform:
    """order: suffixes (their indices) in sorted order; before: the symbol before each of them,
    -1 before a string's first; lcp: symbols that each shares with the one before it; strings:
    how many strings it holds."""

    def __init__(self, order: np.ndarray, before: np.ndarray, lcp: np.ndarray, strings: int):
        self.order, self.before, self.lcp, self.strings = order, before, lcp, strings


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 to 2^32, by two passes over 16 bits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def sorted_shard(symbols: np.ndarray, first: int) -> Transform:
    """The transform of a shard's symbols; each string ends with the symbol 0. first: index of
    the shard's first symbol. Ends of strings sort by their place."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    ends = np.flatnonzero(symbols == 0)
    rank[symbols != 0] += len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        follows = np.full(n, -1, np.int64)
        follows[:-step] = rank[step:]
        follows[rank < len(ends)] = -1  # nothing lies behind a string's end
        order = np.lexsort((follows, rank))
        new = np.cumsum(np.r_[False, (np.diff(rank[order]) != 0) | (np.diff(follows[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if n == 0 or new[-1] == n - 1 or step >= n:
            break
    before = np.where(np.r_[True, symbols[:-1] == 0], -1, np.r_[-1, symbols[:-1]])
    return Transform(order + first, before[order], np.zeros(n, np.int32), len(ends))


def merged(a: Transform, b: Transform) -> Transform:
    """The transform of both shards' strings.

    ``from_b`` is the interleave: true where the next suffix comes from b. A pass lists the
    symbols before the suffixes in the present order and moves, for each symbol, what precedes
    in that order, which is the order by one symbol more."""
    n, m = len(a.order), len(b.order)
    from_b = np.r_[np.zeros(n, bool), np.ones(m, bool)]
    block = np.zeros(n + m, np.int64)  # equal for suffixes that agree so far
    lcp = np.zeros(n + m, np.int32)
    began = np.zeros(n + m, bool)
    head = a.strings + b.strings
    ends = np.r_[np.zeros(a.strings, bool), np.ones(b.strings, bool)]
    symbol = np.empty(n + m, np.int64)
    depth = 0
    while n + m:
        symbol[from_b], symbol[~from_b] = b.before, a.before
        order = stable_order(symbol + 1)
        new = from_b[order]
        new[:head] = ends  # the first of all are the strings' ends, in the order of the strings
        s, old = symbol[order], block[order]
        start = np.r_[True, (np.diff(s) != 0) | (np.diff(old) != 0)]
        start[:head] = True
        lcp[start & ~began] = depth
        block = np.cumsum(start)
        done = (new == from_b).all() and (start == began).all()
        from_b, began = new, began | start
        depth += 1
        if done:
            break
    order = np.empty(n + m, a.order.dtype)
    order[from_b], order[~from_b] = b.order, a.order
    before = np.empty(n + m, a.before.dtype)
    before[from_b], before[~from_b] = b.before, a.before
    return Transform(order, before, lcp, head)


def common_prefixes(symbols: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each position of the strings (each ends with the symbol 0), how many symbols the
    suffix there shares with any other suffix. ``shard`` (rising) names each string's shard;
    shards get their transforms alone, and these are merged pair by pair."""
    closing = np.flatnonzero(symbols == 0)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    parts = []
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(shard)], strict=True):
        p = closing[lo - 1] + 1 if lo else 0
        parts.append(sorted_shard(symbols[p : closing[hi - 1] + 1], p))
    nothing = np.zeros(0, np.int64)
    if len(parts) == 1:  # merged with nothing to get its common prefixes
        parts.append(Transform(nothing, nothing, np.zeros(0, np.int32), 0))
    while len(parts) > 1:
        parts = [merged(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    (whole,) = parts
    out = np.zeros(len(symbols), np.int32)
    out[whole.order] = np.maximum(whole.lcp, np.r_[whole.lcp[1:], 0])
    return out
