"""The promised recall holds for pairs whose buckets are split at every level."""

import math

from estimark.llm import ngram_join


def test_runs_count_all_levels():
    meets = (1 - math.exp(-ngram_join.RATE)) ** ngram_join.LEVELS
    assert (1 - meets) ** ngram_join.RUNS <= 1 - ngram_join.RECALL
