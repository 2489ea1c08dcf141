"""Spaced-out words in running text."""

import pytest
from test_llm_free import labelled

from millrace.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*labelled(spark))


def test_spaced_words_in_text(model):
    idiot, both = model.weights["idiot"], model.weights["idiot"] + model.weights["moron"]
    for text, weight in (
        ("the i d i o t.", idiot), ('the "i d i o t" of', idiot), ("“i d i o t”, of", idiot), ("i. d. i. o. t.", idiot),
        ("the i d i o t, of", idiot), ("the 1 d ! 0 t! of", idiot), ("what a i d i o t", idiot), ("i  d  i  o  t", idiot),
        ("i d i o t m o r o n", both), ("i d i o t  m o r o n!", both), ("i-d-i-o-t", idiot), ("i d i o o t i", idiot),
    ):
        found = model.words(text) & model.weights.keys()
        assert sum(model.weights[w] for w in found) == pytest.approx(weight), (text, found)
        assert model.score(text) > model.score("the of"), text


def test_gaps_and_boundaries():
    own = toxicity.Model(dict(toxicity._counted(["a bad idiot", "the idiot is a moron"] * 50)))
    assert {"a", "idiot"} <= own.words("w a  i d i o t") | own.words("was a i d i o t")
    assert {"idiot", "moron"} <= own.words("i d i o t  m o r o n")
    assert {"idiot", "moron"} <= own.words("i d i o t m o r o n")


def test_clean_runs_and_long_runs(model):
    assert model.score("a b c d e f g") == model.score("the of")
    assert model.score("1 | ! " * 3000) == model.score("the of")
