"""Closures over tables, comparisons of two runs and the tables of the scale report."""

import random

from lodestar.operators import survey
from lodestar.operators.closure import ancestors


def brute(edges, terms=()):
    out = set()
    for start in {t for t, p in edges if t and p} | {t for t in terms if t}:
        seen, todo = set(), [start]
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                todo += [p for a, p in edges if a == t and p]
        out |= {(start, a) for a in seen}
    return out


def closed(spark, edges, terms=None):
    t = None if terms is None else spark.createDataFrame([(x,) for x in terms], "term string")
    rows = ancestors(spark.createDataFrame(edges, "term string, parent string"), t).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return {tuple(r) for r in rows}


def test_closure_of_cycles_and_repeats(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", None), (None, "g")]
    assert closed(spark, edges) == brute(edges)
    assert closed(spark, edges, ["f", "z", None]) == brute(edges, ["f", "z"])
    assert closed(spark, []) == set()


def test_closure_of_a_random_hierarchy(spark):
    rng = random.Random(2)
    edges = [(f"t{i}", f"t{rng.randrange(max(1, i // 2), i)}") for i in range(2, 80) for _ in range(rng.randrange(1, 3))] + [(f"leaf{i}", "t7") for i in range(60)]
    assert closed(spark, edges) == brute(edges)


RUN = "doc_id string, pass string, code string, n int"


def test_two_runs(spark):
    before = spark.createDataFrame([("a", "x", "OLD", 3), ("a", "x", "SAME", 2), ("b", "x", "OLD", 1), ("c", "x", "OLD", 2), ("d", "x", "SAME", 1), ("e", "x", "OLD", 1), ("a", "y", "OLD", 1)], RUN)
    after = spark.createDataFrame([("a", "x", "OLD", 1), ("a", "x", "NEW", 2), ("a", "x", "SAME", 2), ("b", "x", "NEW", 1), ("b", "x", "MORE", 1), ("c", "x", "NEW", 1), ("d", "x", "SAME", 1), ("e", "x", "OLD", 1), ("f", "x", "NEW", 1)], RUN)
    changed = {(r["doc_id"], r["pass"], r["code"]): (r["n_before"], r["n_after"]) for r in survey.compare_runs(before, after).collect()}
    assert changed == {("a", "x", "OLD"): (3, 1), ("a", "x", "NEW"): (0, 2), ("b", "x", "OLD"): (1, 0), ("b", "x", "NEW"): (0, 1), ("b", "x", "MORE"): (0, 1), ("c", "x", "OLD"): (2, 0), ("c", "x", "NEW"): (0, 1), ("f", "x", "NEW"): (0, 1), ("a", "y", "OLD"): (1, 0)}
    moves = {(r["doc_id"], r["pass"]): (r["n_moved"], r["explained"]) for r in survey.reclassified(before, after, "OLD", "NEW").collect()}
    assert moves == {("a", "x"): (2, True), ("b", "x"): (1, False), ("c", "x"): (2, False), ("f", "x"): (0, False), ("a", "y"): (1, False)}
    plan = survey.compare_runs(before, after)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_error_table_and_shares(spark):
    found = [("a", "E1", "ERROR", "_:z", "p", "_:v", "m"), ("a", "E1", "ERROR", "_:b", "p", "a secret", "m"), ("a", "W1", "WARNING", "_:b", "p", "v", "m"), ("b", "E2", "ERROR", "_:c", "p", "-", "m")]
    rows = spark.createDataFrame(found, "doc_id string, code string, severity string, entity string, property string, value string, message string")
    codes = survey.summarize(rows).selectExpr("*", "'alone' AS pass")
    got = {(r["doc_id"], r["code"]): (r["n"], r["example"]["entity"], r["example"]["value"]) for r in survey.error_table(codes).collect()}
    assert got == {("a", "E1"): (2, "_:b", "<withheld: 8 characters>"), ("b", "E2"): (1, "_:c", "-")}
    docs = spark.createDataFrame([(d, "alone") for d in "abcdefgh"], "doc_id string, pass string")
    shares = {(r["severity"], r["code"]): (r["documents"], r["share"]) for r in survey.share_report(codes, docs).collect()}
    assert shares == {("ERROR", "E1"): (1, 12), ("ERROR", "E2"): (1, 12), ("ERROR", "*"): (2, 25), ("WARNING", "W1"): (1, 12), ("WARNING", "*"): (1, 12)}
