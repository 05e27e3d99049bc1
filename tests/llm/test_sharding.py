"""Operator 13: what its law, groups and slots promise, and placing against a plain version."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from lodestar.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string, slot double, unit int, rows long"


def result(spark, rows, shards=16):
    docs = spark.createDataFrame([(i, t, "s", "x", 0.5, 1, 2) for i, t in rows], SCHEMA)
    got = sharding.shard(docs, shards).collect()
    keep = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is not None, i or 0, keep(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return got


def loads(got, shards=16, of=lambda r: r["size"]):
    out = Counter({s: 0 for s in range(shards)})
    for r in got:
        out[r["shard"]] += of(r)
    return list(out.values())


def text(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n))


def test_shards_are_near_equal_and_groups_whole(spark):
    rng = random.Random(2)
    base = [text(rng, rng.randrange(1, 200)) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(base)] + [(4000 + i, base[i % 40]) for i in range(2000)] + [(7000, None), (7001, ""), (None, ""), (None, base[3]), (5, base[9]), (5, base[9])]
    got = result(spark, rows)
    size, tokens, count = loads(got), loads(got, of=lambda r: r["tokens"]), loads(got, of=lambda r: 1)
    assert max(size) - min(size) <= 0.01 * max(size)
    assert max(tokens) <= 1.05 * min(tokens) and max(count) <= 1.1 * min(count)
    where = defaultdict(set)
    for r in got:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    again = result(spark, rows[::-1])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_a_third_of_all_rows_share_a_text(spark):
    rng = random.Random(6)
    rows = [(i, "a text that very many documents share with each other" if i % 3 == 0 else text(rng, rng.randrange(20))) for i in range(9000)]
    rows += [(20_000 + i, None if i % 2 else "") for i in range(2500)]
    got = result(spark, rows)
    size = loads(got)
    assert max(size) - min(size) <= 0.01 * max(size)


def test_long_texts(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, 30)) for i in range(500)] + [(900, "long words " * 100_000), (901, "w" * 200_000)]
    got = result(spark, rows)
    alone = {r["shard"] for r in got if r["doc_id"] == 900}
    others = [x for s, x in enumerate(loads(got)) if s not in alone]
    assert sum(r["shard"] in alone for r in got) == 1  # it exceeds a shard, nothing is put beside it
    assert len(others) == 15


def test_few_and_none(spark):
    assert result(spark, []) == []
    got = result(spark, [(i, "x" * 50) for i in range(3)] + [(9, "y" * 50)])
    assert len(got) == 4
    assert max(loads(result(spark, [(i, f"text {i:02d}") for i in range(32)]))) == 2 * len("text 00x")


def test_place_takes_the_highest_dot_product_with_room():
    rng = np.random.default_rng(1)
    vectors = -np.sort(-rng.random((200, 3)) / 20, axis=0)
    got = sharding.place(vectors, 4)
    left = [[1.0] * 3 for _ in range(4)]
    for v, s in zip(vectors.tolist(), got.tolist()):
        room = [k for k in range(4) if left[k][0] + sharding.SLACK >= v[0]]
        dot = {k: sum(a * b for a, b in zip(left[k], v)) for k in room}
        assert s in (room or range(4))
        assert (dot[s] >= max(dot.values()) - 1e-9) if room else left[s][0] == max(x[0] for x in left)
        left[s] = [a - b for a, b in zip(left[s], v)]
