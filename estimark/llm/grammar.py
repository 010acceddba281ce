"""Weighted finite-state transducers over the word classes of a clause.

Five transducers are composed: insults, threats, targets, negation and reported speech. Each
reads what the one before it wrote. Arcs carry weights, and where several arcs read a symbol
the heaviest path through the clause decides: whether a word before a noun strengthens it,
whether a target belongs to the attack before or behind it, whether a verb is meant as a threat.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

#: Classes of words: other, negation, reported speech, target of an attack, insult, threat, a
#: word that strengthens an insult ("total"), one that begins an insult of several words ("piece"
#: of), what such an insult ends in ("filth"), an intent ("will", "hope") and a fate ("die").
OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT, STRONG, PART, FILTH, INTENT, FATE = "o n r t i h x p b m f".split()
CLASSES = (OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT, STRONG, PART, FILTH, INTENT, FATE)
#: Classes that can begin or end an attack; a clause without any of them holds none.
ATTACKS = (INSULT, THREAT, FILTH, FATE)
#: Written by the insult transducer: I, a strengthened insult. By the threat transducer: H, a
#: meant threat. By the target transducer: d and D, a directed insult and threat.
WRITTEN = "I H d D N R".split()
EPSILON_WEIGHT = 0.0


@dataclass(frozen=True)
class Arc:
    reads: str
    writes: str
    weight: float
    to: int


class Transducer:
    """States are numbers; every path begins in 0 and ends in one of ``finals``. A symbol for
    which a state has no arc of its own passes unchanged along ``idle``."""

    def __init__(self, arcs: dict[int, list[Arc]], idle: dict[int, int], finals: Iterable[int]):
        self.idle, self.finals = idle, frozenset(finals)
        self.arcs: dict[int, dict[str, list[Arc]]] = {}
        for state, own in arcs.items():
            for arc in own:
                self.arcs.setdefault(state, {}).setdefault(arc.reads, []).append(arc)

    def step(self, state: int, symbol: str) -> list[tuple[str, float, int]]:
        """(written symbol, weight, next state) of every arc that reads the symbol."""
        own = self.arcs.get(state, {}).get(symbol)
        if own is not None:
            return [(a.writes, a.weight, a.to) for a in own]
        return [(symbol, EPSILON_WEIGHT, self.idle[state])] if state in self.idle else []


class Composed:
    """The composition of transducers: what one writes, the next reads."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, (0,) * len(parts)
        self.known: dict = {}

    def step(self, states: tuple, symbol: str) -> list[tuple[str, float, tuple]]:
        """All (written symbol, weight, next states) for a symbol read in the given states."""
        key = states, symbol
        if key not in self.known:
            paths = [(symbol, 0.0, ())]
            for part, state in zip(self.parts, states, strict=True):
                paths = [(out, w + v, (*nexts, n)) for read, w, nexts in paths for out, v, n in part.step(state, read)]
            self.known[key] = paths
        return self.known[key]

    def final(self, states: tuple) -> bool:
        return all(s in part.finals for part, s in zip(self.parts, states, strict=True))

    def best(self, symbols: list[str]) -> tuple[float, list[str], list[float]]:
        """The heaviest path over the symbols that ends in final states: its weight, and what
        it writes with which weight at each symbol. Of equal paths the first in the order of
        arcs is taken."""
        front = {self.start: (0.0, ())}
        for symbol in symbols:
            new: dict = {}
            for states, (weight, written) in front.items():
                for out, w, nexts in self.step(states, symbol):
                    if nexts not in new or weight + w > new[nexts][0] + 1e-12:
                        new[nexts] = weight + w, (written, out, w)
            front = new
        weight, written = max(((w, p) for states, (w, p) in front.items() if self.final(states)), key=lambda x: x[0])
        outs, weights = [], []
        while written:
            written, out, w = written
            outs.append(out)
            weights.append(w)
        return weight, outs[::-1], weights[::-1]

    def paths(self, symbols: list[str]) -> list[tuple[float, list[str]]]:
        """Every path that ends in final states (for tests; their number grows exponentially)."""
        front = [(0.0, [], self.start)]
        for symbol in symbols:
            front = [(w + v, [*outs, out], nexts) for w, outs, states in front for out, v, nexts in self.step(states, symbol)]
        return [(w, outs) for w, outs, states in front if self.final(states)]


def insults() -> Transducer:
    """Insults of several words: one or two strengtheners before an insult ("total idiot"), and
    a part of something vile ("piece of filth"). States: 0 none, 1 and 2 a strengthener at most
    two words ago, 3 and 4 such a part, waiting for its end (not final: the path must get there)."""
    arcs = {
        s: [Arc(STRONG, STRONG, 0.0, 2), Arc(INSULT, INSULT, 0.0, 0) if s == 0 else Arc(INSULT, "I", 0.5, 0), Arc(PART, PART, 0.0, 0), Arc(PART, PART, -0.1, 4), Arc(FILTH, OTHER, 0.0, 0) if s == 0 else Arc(FILTH, "I", 0.2, 0)]
        for s in (0, 1, 2)
    }
    arcs[4] = [Arc(FILTH, "I", 1.0, 0), Arc(INSULT, "I", 1.0, 0)]
    arcs[3] = arcs[4]
    return Transducer(arcs, {0: 0, 1: 0, 2: 1, 4: 3}, (0, 1, 2))


def threats(span: int = 4) -> Transducer:
    """Threats of several words: an intent within ``span`` words before a violent verb or a fate
    ("I will find and hurt", "hope you die"). A violent verb alone stays a weak threat, a fate
    alone is none. Negation between the two takes the intent back."""
    arcs: dict[int, list[Arc]] = {0: [Arc(INTENT, OTHER, 0.0, span), Arc(FATE, OTHER, 0.0, 0)]}
    for s in range(1, span + 1):
        arcs[s] = [Arc(INTENT, OTHER, 0.0, span), Arc(THREAT, "H", 1.0, s - 1), Arc(FATE, "H", 0.8, s - 1), Arc(NEGATION, NEGATION, 0.0, 0)]
    return Transducer(arcs, {0: 0} | {s: s - 1 for s in range(1, span + 1)}, range(span + 1))


def targets(before: int = 4, behind: int = 3) -> Transducer:
    """Directs attacks at a target: one at most ``before`` words ahead of the attack, or at most
    ``behind`` words after it. For the latter a path guesses, and dies if no target comes."""
    hits = {INSULT: ("d", 1.0), "I": ("d", 1.2), THREAT: ("D", 0.6), "H": ("D", 1.0)}
    wait = before + 1  # states wait .. wait + behind - 1: so many more words may follow
    arcs: dict[int, list[Arc]] = {}
    for s in range(before + 1):
        arcs[s] = [Arc(TARGET, TARGET, 0.0, before)]
        for symbol, (out, weight) in hits.items():
            after = max(0, s - 1)
            if s:
                arcs[s].append(Arc(symbol, out, weight, after))
            else:
                arcs[s] += [Arc(symbol, symbol, 0.0, 0), Arc(symbol, out, weight - 0.2, wait + behind - 1)]
    for k in range(behind):
        arcs[wait + k] = [Arc(TARGET, TARGET, 0.0, before)]
    idle = {s: max(0, s - 1) for s in range(before + 1)} | {wait + k: wait + k - 1 for k in range(1, behind)}
    return Transducer(arcs, idle, range(before + 1))


def weakened(trigger: str, out: str, weight: float, span: int) -> Transducer:
    """Rewrites attacks that follow ``trigger`` within ``span`` words to ``out``."""
    hits = (INSULT, THREAT, "I", "H", "d", "D", "N")
    arcs: dict[int, list[Arc]] = {0: [Arc(trigger, trigger, 0.0, span)]}
    for s in range(1, span + 1):
        arcs[s] = [Arc(trigger, trigger, 0.0, span), *[Arc(h, out if h != "N" else "N", weight if h != "N" else 0.0, s - 1) for h in hits]]
    return Transducer(arcs, {0: 0} | {s: s - 1 for s in range(1, span + 1)}, range(span + 1))


#: Words that the longest memory of a transducer spans: what lies further off changes nothing.
NEGATION_SPAN, REPORT_SPAN = 3, 8
CLAUSE = Composed(insults(), threats(), targets(), weakened(NEGATION, "N", -0.5, NEGATION_SPAN), weakened(REPORT, "R", -0.3, REPORT_SPAN))
#: Groups of what the grammar writes, each with a weight of its own in the score.
GROUPS = {INSULT: 0, "I": 0, "d": 1, THREAT: 2, "H": 2, "D": 3, "N": 4, "R": 5}
