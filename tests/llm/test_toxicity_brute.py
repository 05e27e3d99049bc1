"""Operator 1 against the likelihood and the features written out by hand."""

import math
import re

import numpy as np

from lodestar.llm import toxicity
from test_operators import corpus, docs, make  # noqa: F401


def log_likelihood(rows, grades, w, t):
    """The mean log-probability of the grades, less the penalty that the fit has."""
    logistic = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    total = 0.0
    for r, g in zip(rows, grades):
        x = sum(w[i] for i in r)
        above = [1.0, *(logistic(x - tk) for tk in t), 0.0]
        total += math.log(max(above[g] - above[g + 1], 1e-12))
    return total / len(rows) - 5e-5 * float((w * w).sum())


def test_the_fit_is_at_the_top_of_the_likelihood():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(400)]
    true = np.array([2.0, 1.0, 0.5, -0.5, -1.0])
    grades = np.array([int((true[r].sum() + rng.logistic() > np.array([0.5, 1.5, 2.5])).sum()) for r in rows])
    w, t = toxicity.fit_cumulative(rows, grades, 5, steps=1500)
    top = log_likelihood(rows, grades, w, t)
    both = np.concatenate([w, t])
    for i in range(8):
        for step in (0.05, -0.05):
            moved = both.copy()
            moved[i] += step
            assert log_likelihood(rows, grades, moved[:5], moved[5:]) < top + 1e-5
        slope = [both.copy(), both.copy()]
        slope[0][i] += 1e-4
        slope[1][i] -= 1e-4
        assert abs(log_likelihood(rows, grades, slope[0][:5], slope[0][5:]) - log_likelihood(rows, grades, slope[1][:5], slope[1][5:])) / 2e-4 < 2e-3


def test_scores_are_those_of_the_features(spark, docs):  # noqa: F811
    index = {"river1": 0, "tree*": 1, "tree*3": 2, "über1*": 3, "日本語": 4}
    model = toxicity.Model(index, np.array([1.0, 0.5, 0.75, 2.0, 4.0]), np.array([0.5, 1.0, 2.5]), 0.9)
    got = sorted((str(r["doc_id"]), round(r["expected_severity"], 9), r["severity"], r["toxic"]) for r in toxicity.score(docs, model).collect())
    want = []
    for i, text, *_ in corpus():
        words = set(re.findall(r"\w+", (text or "").lower()))
        x = 1.0 * ("river1" in words) + 4.0 * ("日本語" in words)
        trees = {w for w in words if w.startswith("tree") and len(w) > 4}
        x += 0.5 * bool(trees) + 0.75 * (len(trees) >= 3) + 2.0 * any(w.startswith("über1") and len(w) > 5 for w in words)
        above = [1 / (1 + math.exp(-(x - t))) for t in (0.5, 1.0, 2.5)]
        want.append((str(i), round(sum(above), 9), sum(a >= 0.5 for a in above), sum(above) >= 0.9))
    assert got == sorted(want)


def test_given_grades_are_used(spark):
    rows = [(i, f"w{i % 7} " + ("mild " if i % 3 == 1 else "harsh " if i % 3 == 2 else "") + "rest of it", "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), (0, 1, 3)[i % 3]) for i in range(300)], "doc_id long, toxic int, severity int")
    model = toxicity.train(make(spark, rows), labels)
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(make(spark, rows), model).collect()}
    assert sum(got[i] == (0, 1, 3)[i % 3] for i in range(300)) >= 290


def test_rare_classes_are_sampled_whole(spark):
    rows = [(i, ("vile thing " if i % 50 == 0 else "fine thing ") + f"n{i % 11}", "en", "s") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.train(make(spark, rows), labels, max_train=200)
    got = toxicity.score(make(spark, rows), model)
    assert got.where("toxic = (doc_id % 50 = 0)").count() == 2000


def test_repeated_rows_score_alike(docs):  # noqa: F811
    model = toxicity.Model({"tree*": 0}, np.array([1.0]), np.array([0.5, 1.0, 2.5]), 0.9)
    twice = toxicity.score(docs.unionAll(docs), model)
    assert twice.groupBy("doc_id").agg({"expected_severity": "min"}).count() == len({i for i, *_ in corpus()})
    assert twice.distinct().count() == toxicity.score(docs, model).distinct().count()
