"""Toxicity: long texts and folds at the ends of words."""

from __future__ import annotations

import pytest

from mattelake.llm import toxicity

COMBINE = [-3.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("times", [10, 100, 2500])
def test_score_does_not_fall_with_length(times):
    auto = toxicity.automaton({" idiot ": 2.0, " scu": 1.0})
    text = "idiot " + "plain " * 18 + "scum "
    total, words = toxicity.weigh(text, auto)
    assert (total, words) == (3.0, 20)
    assert toxicity.weigh(text * times, auto) == (total * times, words * times)
    assert toxicity.score(text * times, auto, COMBINE) == pytest.approx(toxicity.score(text, auto, COMBINE))


def test_folds_at_ends_of_words_and_after_signs():
    auto = toxicity.automaton({f" {w} ": 2.0 for w in ("worthless", "idiot", "stupid", "asshole", "pathetic")})
    for masked in ("worthle55", "worthle55!", "(5tupid", "\"5tupid!\"", "a5shole$$$", "pa7hetic", "id10t", "idio7.", "[1diot]", "idiot!", "worthle$$"):
        assert toxicity.weigh(f"you are {masked} 100 times", auto)[0] == 2.0, masked
    for plain in ("room 101!", "5 $ a1", "(7)", "10:45", "not 5tupid", "not (5tupid)"):
        assert toxicity.weigh(plain, auto)[0] == 0.0, plain
    assert toxicity.weigh("x" * 200_000 + "5", auto)[0] == 0.0
