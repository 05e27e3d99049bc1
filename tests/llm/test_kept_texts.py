"""The query of operator 10 returns the texts that are left, so that what it removes can be read off its result."""

import hashlib
import random

from lodestar.llm.queries import op10_suffix_dedup
from test_operators import make


def test_the_query_returns_what_is_left(spark, tmp_path):
    """A shared passage of 400 bytes goes; one of 399 bytes, of over 50 words, stays."""
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("abcdefghijé  ") for _ in range(n))
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    short = ("".join(rng.choice("kmnpq") + " " for _ in range(200)))[:399]
    rows = [(i, f"{say(200)}{i}{passage}{i}{say(100)}{i}{short}{i}{say(50)}", "en", "s") for i in range(1, 4)]
    rows += [(8, say(900), "en", "s"), (9, None, None, None)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t, r = t or "", got[i]
        left, at = t.replace(passage, ""), t.encode().find(passage.encode())
        assert r["kept_text"] == left and r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        assert [tuple(s) for s in r["spans"]] == ([(at, at + 400)] if i < 8 else [])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == ((len(t.encode()), 400, 1) if i < 8 else (len(t.encode()), 0, 0))
