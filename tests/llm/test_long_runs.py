"""Language of letter runs of several hundred thousand characters."""

from __future__ import annotations

import numpy as np

from mattelake.llm import langid


def test_long_runs_keep_their_scores_apart():
    vocab = {"▁": 0, "a": 1, "b": 2}
    probs = np.array([[0.5, 0.5], [0.495, 0.49], [0.005, 0.01]])
    size = 250_000
    got = langid.word_scores(["b" * size], langid.Pieces(vocab), probs)[0]
    assert np.allclose(got, np.log(0.5) + size * np.log(probs[2]), rtol=1e-9)
    assert got[1] > got[0] + 1000
