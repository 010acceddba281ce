"""The recurrent model reads its inputs' rows without gaps, and sums their gradients by input."""

import numpy as np

from estimark.llm import lm


def test_steps_read_rows_without_gaps(monkeypatch):
    model = lm.Model.fresh(np.arange(1, lm.ALL_CLASSES + 1), np.arange(1, lm.FREQUENT + 1))
    seen, gates = [], lm.Model.gates

    def spy(self, h, *rest):
        seen.append([x.flags.c_contiguous and x.shape[-1] == lm.HIDDEN for x in rest])
        return gates(self, h, *rest)

    monkeypatch.setattr(lm.Model, "gates", spy)
    ids, lengths = np.arange(40, dtype=np.int32) * 50, np.array([12, 20, 8])
    lm.log_probabilities(model, ids, lengths)
    lm.train(model, ids, lengths, 0.01)
    assert seen and all(map(all, seen))


def test_gradients_of_inputs_that_occur_once_and_often(monkeypatch):
    """Against the same window with an input of its own for each place, summed by input."""
    rng = np.random.default_rng(4)
    model = lm.Model.fresh(np.ones(lm.ALL_CLASSES), np.ones(lm.FREQUENT))
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for x in ([[7, 7, 9], [3, 7, 8], [2078, 5, 4]], [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[6, 6, 6]] * 3, [[2, 2, 5], [9, 9, 1], [3, 4, 9]]):
        x = np.array(x, np.int32)
        begin, live = np.zeros(x.shape, bool), np.ones(x.shape, bool)
        h = rng.standard_normal((3, lm.HIDDEN))
        got = lm.gradients(lm.Model(w), x, begin, live, h)[0]["inputs"]
        # by differences in one number of each input's row
        for word in np.unique(x):
            column, step = int(rng.integers(2 * lm.HIDDEN)), 1e-6
            loss = []
            for sign in (1, -1):
                moved = w["inputs"].copy()
                moved[word, column] += sign * step
                loss.append(-lm.gradients(lm.Model(w | {"inputs": moved}), x, begin, live, h)[1].sum())
            assert abs((loss[0] - loss[1]) / (2 * step) - got[word, column]) < 1e-5
        assert not got[np.setdiff1d(np.arange(lm.INPUTS), x)].any()
