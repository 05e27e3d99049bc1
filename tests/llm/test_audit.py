"""Operator 12 against a replay document by document."""

import random
import re
from collections import Counter
from itertools import permutations

from lodestar.llm import audit

DOCS = "doc_id long, text string, source string, part string, n long, A boolean, quality int"
LABELS = "doc_id long, quality int, toxic int, n long, part string"


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def brute(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    out = Counter()
    for i, t, s in docs:
        f = fails(t or "") | {"E": i is not None and i > least[t or ""]}
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                key = (s or "", "".join(order), step)
                removed = f[letter] and not gone
                for name, holds in (("redundant", f[letter] and gone), ("removed", removed), ("good_lost", removed and i in good), ("toxic_lost", removed and i in toxic), ("unique_fails", f[letter] and sum(f.values()) == 1), ("kept", not gone and not f[letter])):
                    out[*key, name] += holds
                gone |= f[letter]
    for part, order, step, name in [k for k in out if k[3] == "removed"]:
        out[part, "all", order[step - 1], "shapley"] += out[part, order, step, name]
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, "clash", 9, True, 5) for i, t, s in docs], DOCS)
    lab = spark.createDataFrame([(i, q, x, 1, "p") for i, q, x in labels], LABELS)
    want, rows = brute(docs, labels), audit.audit(d, lab).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == 600 * len({s or "" for *_, s in docs})
    for r in rows:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[r["part"], r["filter_order"], r["step"], name], (r, name)
        assert r["shapley"] == want[r["part"], "all", r["filter_order"][r["step"] - 1], "shapley"]


def test_replay_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["w%d" % rng.randrange(300), "same", "UP", "a#b", "É", "W"][: rng.randrange(1, 7)]) for _ in range(rng.randrange(1, 420))) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["s0", "s0", "s1", "", None])) for i in range(150)]
    docs += [(200, None, "s0"), (201, "", None), (202, " \t\n", "s1"), (None, texts[0], "s0"), (None, texts[0], "s0"), (None, "alone", "s1"), (5, docs[5][1], docs[5][2]), (5, docs[6][1], "s1"), (203, "x y " * 150_000, "s1"), (204, "q" * 1_000_000, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(None, 1, 1), (2, 1, 0), (2, 0, 1), (999, 1, 1)]
    check(spark, docs, labels)


def test_bounds_are_strict(spark):
    exactly = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(["w0"] * 100)  # 200 words, 100 of them distinct
    check(spark, [(1, exactly, "s"), (2, exactly + " w0", "s"), (3, "A" + "b" * 49, "s"), (4, "A" + "b" * 48, "s"), (5, "a\x0bb\x0cc d", "s"), (6, exactly, "s")], [])


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
