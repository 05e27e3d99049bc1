"""Components of chains, and the number of rounds that they take."""

import random

import pytest

from lodestar.llm import components


def chains(n):
    ids = list(range(n + 1))
    random.Random(1).shuffle(ids)
    return {"backwards": [(0, n), *((i + 1, i) for i in range(1, n))], "random": list(zip(ids, ids[1:]))}


@pytest.mark.parametrize("kind", ["backwards", "random"])
def test_rounds_on_long_chains(spark, monkeypatch, kind):
    links = spark.createDataFrame(chains(1600)[kind], "a long, b long")
    tables = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: tables.append(1) or cut(df))
    got = components.components(links).collect()
    assert sorted(r["node"] for r in got) == list(range(1601)) and {r["label"] for r in got} == {0}
    assert len(tables) - 1 <= 12


def test_many_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    top = {i: i for link in links for i in link}
    for _ in range(300):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in top.items() if any(i in link and link[0] != link[1] for link in links)}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_round_is_planned_with_few_exchanges(spark):
    """A star that stands in a plan several times costs the driver memory with each round."""
    edges = components.cut(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"))
    assert _exchanges(components.small_star(edges)) <= 4
    assert _exchanges(components.large_star(edges)) <= 4


@pytest.mark.parametrize("links", [[], [(7, 3), (9, 20), (20, 30), (1, 30), (40, 41)]])
def test_more_links_join_known_labels(spark, links):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(3, 2), (5, 3), (9, 8)]
    want = {(r["node"], r["label"]) for r in components.components(frame(first + links)).collect()}
    got = components.joined(components.cut(components.components(frame(first))), frame(links)).collect()
    assert len(got) == len(want) and {(r["node"], r["label"]) for r in got} == want
