"""Texts that no strategy can link go no further than their counted words; those that one can link stay."""

import pytest

from citeweave.functions import text as T
from citeweave.operators import corpus as C
from citeweave.operators import match
from citeweave.plans import engine

VERSES = "the river runs below the quiet harbour wall. seven lanterns burn beside the wooden gate. nobody answers when winter comes early."
TEXTS = {
    1: "seven lanterns burn beside the wooden gate",
    2: "sevn lnterns burn beside the wooden gate",
    3: "seven lanterns burn beside the brazen gate",
    4: "zebras gallop over dusty plains while hunters dream nightly",
    5: "sevenlanterns burn beside the wooden gate",
    6: "nobody answers when winter",
}


@pytest.mark.parametrize("correct, expected", [(False, {1, 2, 6}), (True, {1, 2, 3, 5, 6})])
def test_only_what_can_be_linked(spark, correct, expected):
    corpus = C.from_passages(spark.createDataFrame([(1, VERSES)], "item_id int, text string"), "item_id", "text")
    cands = match.candidates(spark.createDataFrame(list(TEXTS.items()), "id int, text string"), T.LATIN)
    got = engine.reachable(cands, corpus, engine.Config(profile=T.LATIN, correct=correct))
    assert {r.id for r in got.collect()} == expected
