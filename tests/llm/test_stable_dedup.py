"""Of rows that repeat a doc_id with different texts, the same one stays in every run."""

from lodestar.llm import neardup
from test_operators import make


def test_one_row_of_a_doc_id_stays(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, say(k), "en", f"s{k}") for k in range(6)] + [(2, say(7), "en", "s"), (3, say(8), "en", "a"), (3, say(8), "en", "b"), (None, say(9), "en", "s"), (None, say(10), "en", "s"), (4, None, "en", "s"), (4, "", "en", "s")]
    runs = []
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        docs = make(spark, order).repartition(3)
        got = neardup.deduplicated(docs)
        assert got.columns == docs.columns
        runs.append(sorted((str(r["doc_id"]), r["text"] or "", r["source"]) for r in got.collect()))
    assert runs[0] == runs[1] == runs[2] and [r[0] for r in runs[0]] == ["1", "2", "3", "4", "None", "None"]
