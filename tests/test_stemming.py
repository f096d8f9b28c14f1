from __future__ import annotations

import pyarrow as pa
import pytest

from scanmill.functions.stemming import porter_stem, stem_lists

PAIRS = """caresses caress, ponies poni, ties ti, cats cat, feed feed, agreed agre, plastered plaster,
bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop,
tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky,
relational relat, conditional condit, rational ration, valenci valenc, digitizer digit,
conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog,
vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl,
triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, adjustable adjust,
defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend,
adoption adopt, communism commun, activate activ, homologous homolog, effective effect,
bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, as as, be be"""


@pytest.mark.parametrize("pair", PAIRS.replace("\n", " ").split(", "))
def test_published_examples(pair):
    word, stem = pair.split()
    assert porter_stem(word) == stem


def test_lists_keep_shape():
    lists = pa.array([["cats", "running"], None, [], ["cats"]], pa.list_(pa.string()))
    assert stem_lists(lists).to_pylist() == [["cat", "run"], None, [], ["cat"]]
    assert stem_lists(lists.slice(2)).to_pylist() == [[], ["cat"]]
