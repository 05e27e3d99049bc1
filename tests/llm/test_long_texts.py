"""Texts of a megabyte, and words with marks."""

from lodestar.llm import langid, merkle, quality
from test_operators import make

LONG = "some words that are said again and again in one text. " * 20_000


def test_quality_of_a_megabyte(spark):
    rows = {r["doc_id"]: r for r in quality.judge(make(spark, [(1, LONG, "en", "s"), (2, "w" * 1_200_000, "en", "s"), (3, LONG + "\n" + LONG, "en", "s")])).collect()}
    assert (rows[1]["n_words"], rows[1]["n_repeat_words"], rows[1]["base_failed"]) == (220_000, 220_000, True)
    assert (rows[2]["n_words"], rows[2]["word_chars"], rows[2]["n_dup_lines"]) == (1, 1_200_000, 0) and rows[3]["n_words"] == 440_000 and rows[3]["n_dup_lines"] in (0, 1)


def test_fingerprints_of_a_megabyte(spark):
    rows = {r["doc_id"]: r for r in merkle.fingerprints(make(spark, [(1, LONG, "en", "s"), (2, LONG, "en", "s"), (3, "w" * 1_200_000, "en", "s")])).collect()}
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"] and rows[1]["near_next"] == 1 and rows[3]["n_chars"] == 1_200_000


def test_words_have_their_marks(spark):
    assert langid.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and langid.words("ภาษาไทย") == ["ภาษาไทย"] and langid.words("لُغَة") == ["لُغَة"]
    assert langid.words("Été ÉTÉ") == ["été", "été"] and langid.words("́ 1a_b") == ["a", "b"] and langid.words(None) == []
    learn = [(i, t, x, "s") for i, (t, x) in enumerate([("यह हिन्दी भाषा है", "hi"), ("ही मराठी भाषा आहे", "mr")] * 20)]
    asked = make(spark, [(1, "हिन्दी है", None, None), (2, "मराठी आहे", None, None), (3, "हिन्दी है " * 100_000, None, None), (4, "ि́", None, None)])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, langid.train(make(spark, learn))).collect()}
    assert got == {1: "hi", 2: "mr", 3: "hi", 4: "und"}
