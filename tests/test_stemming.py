"""The stemmer against pairs of the algorithm's published sample vocabulary."""

import pytest

from lodeseek.functions.stemming import stem

PAIRS = """consigned consign, consigning consign, consistency consist, consistently consist, consolations consol, consolatory consolatori, consoled consol, consolidated consolid, consolingly consol,
conspicuously conspicu, conspiracy conspiraci, conspirators conspir, constancy constanc, knackeries knackeri, knavish knavish, kneaded knead, knightly knight, knitted knit, knives knive,
generously generous, generate generat, general general, generic generic, communities communiti, skies sky, dying die, news news, proceed proceed, herring herring, happily happili,
hopping hop, hoping hope, ties tie, cries cri, by by, say say, agreed agre, feed feed, gas gas, this this, gaps gap, kiwis kiwi, relational relat, conditional condit, rational ration, sensibly sensibl,
fluently fluentli, nationalize nation, electricity electr, hopefulness hope, formative format, adjustment adjust, adoption adopt, controlling control, rolled roll, owed owe, bled bled, 's 's"""


@pytest.mark.parametrize("pair", [p.strip() for p in PAIRS.split(",")])
def test_stem(pair):
    word, want = pair.split()
    assert stem(word) == want
