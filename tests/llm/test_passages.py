"""Passages of over 50 words go from the pipeline, also those of less than 400 bytes."""

import random

import pytest

import corpus_pipeline as p
from lodestar.llm import suffixes
from test_operators import brute_spans, corpus, docs, make  # noqa: F401


def left_by_brute_force(texts, length):
    """The texts without the strings of ``length`` words that start anywhere else too."""
    places = [list(zip(*(x.tolist() for x in suffixes.word_places(t)))) for t in texts]
    out = []
    for t, at, spans in zip(texts, places, brute_spans([tuple(t.split()) for t in texts], length)):
        out.append(suffixes.kept_bytes(t, [(at[a][0], at[b - 1][1]) for a, b in spans]))
    return out


def test_words_are_those_of_split():
    for t in (b"", b" ", b"a", b" a\tb\x0bc \n", "ça   x\x1cy".encode()):
        assert [t[a:b] for a, b in zip(*suffixes.word_places(t))] == t.split()
    texts = [b"aa b", b"", b"b a aa", b"\n"]
    got = [[h[i : i + 8] for i in range(0, len(h), 8)] for h in suffixes.word_hashes(texts)]
    assert [len(h) for h in got] == [2, 0, 3, 0] and got[0] == [got[2][2], got[2][0]] and len({*got[0], *got[2]}) == 3


@pytest.mark.parametrize(("length", "gram", "bucket_runs"), [(51, 16, 1000), (8, 3, 1000), (8, 3, 1)])
def test_repeated_words_are_removed_exactly(docs, length, gram, bucket_runs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(suffixes, "PIECE", 8 * 600)
    rows = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    want = [(str(i), kept.decode()) for (i, _), kept in zip(rows, left_by_brute_force([t for _, t in rows], length))]
    got = suffixes.without_repeats(docs, words=True, length=length, gram=gram, bucket_runs=bucket_runs).collect()
    assert sorted((str(r["doc_id"]), r["kept_text"]) for r in got) == sorted(want)


def test_passages_of_51_short_words_go(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    passage, short = say(51), say(50)
    assert len(passage) < 250
    rows = [(i, f"{say(30)}x{i} {passage} y{i}{say(20)} z{i} {short} {i}w", "en", "s") for i in range(3)]
    rows[2] = (2, rows[2][1].replace(passage, passage.replace(" ", "\n", 1)), "en", "s")  # wrapped elsewhere
    left = make(spark, rows)
    for name, stage in p.STAGES:
        if name == "repeats":
            left = stage(spark, left, "")
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    for i, t, *_ in rows:
        a, b = t.index(f"x{i} ") + len(f"x{i} "), t.index(f" y{i}")
        assert got[i] == t[:a] + t[b:]
