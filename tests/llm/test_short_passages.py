"""The query of operator 10 finds passages of over 50 words, also those of less than 400 bytes, which its contract's columns keep."""

import os
import random

from lodestar.llm import suffixes
from lodestar.llm.queries import op10_suffix_dedup
from test_operators import corpus, make
from test_passages import left_by_brute_force


def test_the_query_finds_passages_under_400_bytes(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    passage, short, long_ = say(51), say(50), say(120)
    assert len(passage) < 400 < len(long_)
    rows = [(i, f"{say(30)} x{i} {passage} y{i} {say(20)} z{i} {short} {i}w", "en", "s") for i in range(4)]
    rows[2] = (2, rows[2][1].replace(passage, passage.replace(" ", "\n ", 9)), "en", "s")  # wrapped elsewhere
    rows += [(10 + i, f"{say(9)} a{i} {long_} b{i} {say(300)}", "en", "s") for i in range(2)] + [(20, say(400), "en", "s")]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        r, body = got[i], t.split()
        n = 51 if i < 4 else 120 if i < 20 else 0
        assert (r["n_passages"], r["n_passage_words"]) == (int(n > 0), n)
        at = body.index(f"x{i}") + 1 if i < 4 else 10
        assert r["text_without_passages"].split() == body[:at] + body[at + n :]
        assert (r["n_removed"] > 0) == (10 <= i < 20)


def test_passages_are_those_of_brute_force(spark, monkeypatch):
    """Small lengths, pieces and buckets; nulls, copies and equal rows; what was written on the way is deleted."""
    monkeypatch.setattr(suffixes, "PIECE", 8 * 600)
    docs, texts = make(spark, corpus()), [(t or "").encode() for _, t, *_ in corpus()]
    want = sorted((str(i), kept.decode()) for (i, *_), kept in zip(corpus(), left_by_brute_force(texts, 8)))
    shared = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/lodestar"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    rows = suffixes.without_repeats_and_passages(docs, "lang", passage_words=8, passage_gram=3, length=60, gram=20, bucket_runs=1)
    assert len(set(os.listdir(shared)) - before) == 2
    got = rows.collect()
    assert sorted((str(r["doc_id"]), r["text_without_passages"]) for r in got) == want
    plain = suffixes.without_repeats(docs, "lang", length=60, gram=20)
    assert sorted(map(str, rows.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
