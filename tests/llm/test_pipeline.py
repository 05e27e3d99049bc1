"""The pipeline's stages on the smallest tables, each held against its own input."""

import duckdb
import pytest

import corpus_pipeline as p
from lodestar.llm import neardup, queries
from test_operators import brute_components, make, words
from test_passages import left_by_brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return {n: x for n, *x in out}


def test_documents_keep_their_columns(stages):
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert sorted(columns) == sorted(p.COLUMNS), name


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in want.values()})


def test_repeats_go(stages):
    before, after, _ = stages["repeats"]
    texts = [(r["text"] or "").encode() for r in before]
    want = {r["doc_id"]: kept.decode() for r, kept in zip(before, left_by_brute_force(texts, 51))}
    assert {r["doc_id"]: r["text"] for r in after} == want


def test_mix_and_tokens(stages):
    before, after, _ = stages["mix"]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    taken = {}
    for r in after:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in stages["tokens"][1])
    assert len(stages["tokens"][1]) == len(after)


def test_toxic_documents_go(stages):
    before, after, _ = stages["toxicity"]
    marks = {"idiot", "moron", "scum", "pathetic"}
    kept = {r["doc_id"] for r in after}
    bad = {r["doc_id"] for r in before if len(marks & set((r["text"] or "").lower().replace(".", " ").replace(",", " ").split())) >= 2}
    assert len(bad & kept) <= 0.2 * len(bad) and len(kept) >= 0.75 * len(before)


def test_license_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()["op5_license_scan"](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op5_license_scan']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)
    assert neardup.WORDS == 4


def test_stages_are_the_ones_asked_for(spark, tmp_path):
    assert [name for name, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeats", "mix", "tokens"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (1, None, "en", None), (2, "", None, "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (4, "x" * 3_000_000, "en", "s"), (5, "word " * 200_000, "en", "t")]])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and very long texts, repeated rows, an empty table and columns with names that the operators use."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(spark, rows)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
        ids = sorted(r[0] for r in docs.select("doc_id").collect() if r[0] is not None)
        if not rows:
            assert docs.count() == 0, name
        elif name in ("toxicity", "near_duplicates", "repeats"):
            assert ids == [1, 2, 3, 3, 4, 5] if name == "toxicity" else ids == [1, 2, 3, 4, 5], name
        else:
            assert set(ids) <= {3, 4, 5}, name
    assert docs.where("NOT round_trip").count() == 0
