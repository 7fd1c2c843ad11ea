"""The byte network reads patterns at every position."""

from __future__ import annotations

import numpy as np

from mattelake.llm import byte_cnn


def test_a_pattern_answers_alike_at_every_position():
    model, pattern = byte_cnn.Model(), b"qzxjvk"
    model.tables[:] = 0
    for j, c in enumerate(pattern):
        model.tables[j, c, 0] = 1
    for lead in range(8):
        top = model.pooled(byte_cnn.chunks(b"." * lead + pattern + b"." * 40))
        assert np.isclose(top[0, 0], 6.0), lead
