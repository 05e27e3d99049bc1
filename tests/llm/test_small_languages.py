"""A language with few documents beside one with many is learned from all it has."""

import random

import pytest

from lodestar.llm import common, langid
from test_operators import make


def test_level_leaves_small_groups_whole():
    assert common.level([2, 50, 100], 62) == 30 and common.level([1, 2], 3) == float("inf") and common.level([10, 10], 4) == 2
    assert langid._least([(9, 2), (5, 4), (3, 10)], 4) == (5, 0.5) and langid._least([(9, 2)], 2) == (0, 1.0)


@pytest.mark.parametrize("bounds", [{"max_train": 60}, {"max_words": 60, "max_grams": 400}])
def test_small_languages_are_learned(spark, bounds):
    rng = random.Random(3)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 6))) for _ in range(n))
    words = say("abcdefgh", 400).split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)), "aa", "s") for i in range(2000)]
    rows += [(5000 + i, f"ahem bedd {'chaf' * (i % 2)} fadge", "bb", "s") for i in range(5)]
    model = langid.train(make(spark, rows), **bounds)
    assert model.langs == ["aa", "bb"] and {"ahem", "bedd", "fadge"} <= set(model.known)
    assert len(model.known) <= 1.2 * bounds.get("max_words", 60_000) and len(model.grams) <= 1.2 * bounds.get("max_grams", 60_000)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(make(spark, [(1, "bedd ahem", None, None), (2, rows[0][1], None, None)]), model).collect()}
    assert got == {1: "bb", 2: "aa"}
