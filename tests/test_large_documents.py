"""Documents with very many nodes, and texts that are read entity by entity."""

import json
import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from lodestar.operators import checks, joins
from lodestar.operators.flatten import LONG_BYTES, MAX_DEPTH, Walker, batches_of, flatten, nodes_of_long, nodes_of_text
from lodestar.plans.mini_vocabulary import mini

from test_checks import BROKEN, CASES, cert, graph


def documents(spark, *raws):
    return spark.createDataFrame([(f"d{i}", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "doc_id string, raw string")


def read(how, raw):
    try:
        return list(how(raw))
    except (ValueError, RecursionError) as e:
        return type(e)


def long(raw):
    return nodes_of_long(memoryview(raw.encode()), Walker(mini()))


def short(raw):
    return nodes_of_text(raw, Walker(mini()))


ODD = [
    "", " ", "[", "]", "{}", "[]", " [ ] ", " { } ", "[{}]", "[{},{}]", "[{},]", "[,{}]", "[{}] x", "[{}]]", "[{}}", "[[]]", "[1]", '[{"a:b": "]},{[\\""}, {"a:b": ["\\\\"]}]', '{"@graph": []}', '{"@graph": [{}] }', '{"@graph": [{}], "x": }', '{"@graph": [{}], "x": [1, {"y": "}"}]}', '{"x": 1, "@graph": [{"@id": "a"}], "@graph": [{"@id": "b"}, {}]}',
    '{"@graph": [{}], "@graph": 3}', '{"@graph": 3, "@graph": [{}]}', '{"@graph": nope, "@graph": [{}]}', '{"\\u0040graph": [{"@id": "z"}]}', '{"@graph" [{}]}', '{3: [{}]}', '{"@graph": [{}] "x": 1}', '{"@graph": [{}]} {}', '{"a": {"@graph": [{}]}}', '{"a:b": 1, "c:d": {"e:f": [2, {"g:h": NaN}]}}', "﻿[{}]", "[{}\x00]", '["a]', '{"@graph": [{"é:ü": "日本 \U0001f600"}]}', "null", '"[]"', "[{}] ", "[{},{}]\n", '{"@graph": [{}],}', "{,}", '{"a"}', '{"a":}', '{"a:b":1,"@graph":[{}]}x',
]


@pytest.mark.parametrize("raw", [*ODD, *BROKEN.values(), *(json.dumps(d, indent=i) for d, _ in CASES.values() for i in (None, 1))])
def test_both_readers_agree(raw):
    a, b = read(long, raw), read(short, raw)
    assert a == b or all(isinstance(x, type) and issubclass(x, ValueError) for x in (a, b))


def test_damaged_texts_are_read_alike():
    rng = random.Random(1)
    for _ in range(1500):
        raw = rng.choice([json.dumps(graph(cert(), {"a:b": ["x", {"c:d": 'q"\\'}]})), json.dumps([cert(), {"e:f": [[1], {}]}])])
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(raw))
            raw = raw[:at] + rng.choice(['"', "\\", "[", "]", "{", "}", ",", ":", " ", "", "1"]) + raw[at + rng.randrange(2) :]
        a, b = read(long, raw), read(short, raw)
        assert a == b or all(isinstance(x, type) and issubclass(x, ValueError) for x in (a, b)), raw


def test_depth_is_stated(spark):
    nest = lambda n: '{"a:b":' * n + "{}" + "}" * n
    rows = flatten(documents(spark, nest(MAX_DEPTH - 1), nest(MAX_DEPTH), "[" * 100_000), mini()).groupBy("doc_id", "error").count().collect()
    got = {r["doc_id"]: (r["count"], r["error"]) for r in rows}
    assert got["d0"] == (MAX_DEPTH, None) and got["d1"][0] == 1 and str(MAX_DEPTH) in got["d1"][1] and got["d2"][0] == 1 and got["d2"][1]


def test_a_long_document_takes_little_memory():
    entity = json.dumps({"@id": "_:x", "@type": "ceterms:Course", "ceterms:hasPart": [f"_:{i}" for i in range(20)], "ceterms:name": {"en": "y" * 200}})
    raw = ('{"@context": "c", "@graph": [' + ",".join([entity] * 40_000) + "]}").encode()
    assert len(raw) > 4 * LONG_BYTES
    batch = pa.record_batch([pa.array(["d"]), pa.array([raw]).cast(pa.string())], names=["doc_id", "raw"])
    del raw
    tracemalloc.start()
    rows = sum(b.num_rows for b in batches_of(iter([batch]), mini()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40_000 and peak < 40 << 20


def test_long_document_in_spark(spark):
    entity = json.dumps({"@id": "_:x", "@type": "ceterms:Course", "a:b": ["z" * 1000] * 30})
    whole, broken = "[" + ",".join([entity] * 300) + "]", "[" + ",".join([entity] * 300) + ",{]"
    assert len(whole) > LONG_BYTES
    rows = flatten(documents(spark, whole, broken, "{}"), mini()).groupBy("doc_id").agg({"ord": "max", "error": "count", "*": "count"}).collect()
    assert {r["doc_id"]: (r["max(ord)"], r["count(error)"], r["count(1)"]) for r in rows} == {"d0": (299, 0, 300), "d1": (None, 1, 1), "d2": (0, 0, 1)}


def test_inverses_of_many_children(spark):
    n = 40_000
    parent = {"@id": "_:p", "@type": "ceasn:Competency", "ceasn:hasChild": [f"_:{i}" for i in range(n)]}
    children = [{"@id": f"_:{i}", "@type": "ceasn:Competency", "ceasn:isChildOf": "_:p" if i else "_:q"} for i in range(n)] + [{"@id": f"_:{n}", "@type": "ceasn:Competency", "ceasn:isChildOf": "_:p"}]
    s = checks.session(documents(spark, graph(parent, *children)), mini())
    s.references()
    began = time.perf_counter()
    found = [(r["code"], r["entity"], r["value"]) for r in checks.inverses(s).collect()]
    took = time.perf_counter() - began
    # The parent names child 0, which names another; the last child is not named back.
    assert found == [("INVERSE_MISMATCH", "_:p", "_:0")] or sorted(found) == [("INVERSE_MISMATCH", "_:40000", "_:p"), ("INVERSE_MISMATCH", "_:p", "_:0")]
    assert len(found) == 2 and took < 5


def test_many_frameworks_in_one_document(spark):
    n = 100_000
    nodes = [{"@id": f"_:f{i:06d}", "@type": "ceasn:CompetencyFramework"} for i in range(n)] + [{"@id": "_:c", "@type": "ceasn:Competency", "ceasn:isPartOf": ["https://x.example/1", "_:f000007"]}]
    beside = spark.createDataFrame([("s", '{"@id": "https://a.example/f", "@type": "ceasn:CompetencyFramework"}', "s.json", 0)], "doc_id string, raw string, source string, set_ord int")
    (r,) = checks.domain_and_range(checks.session(documents(spark, graph(*nodes)), mini(), beside)).where("code = 'ISPARTOF_FRAMEWORK_MISMATCH'").collect()
    assert r["value"] == "https://x.example/1" and f"{n + 1 - checks.SHOWN} more" in r["message"] and "_:f000010" not in r["message"] and "_:f000000" in r["message"]


def test_hot_keys_are_spread(spark):
    left = spark.range(90_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id as string) END AS k", "id").persist()
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("4", 3)], "k string, x int")
    hot, bound = joins.hot_keys(left, ["k"], least=1000)
    ((key, salts),) = hot.collect()
    assert key == "hot" and bound == 90_000 // 16 and salts == -(-30_000 // bound)
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain, spread = left.join(right, ["k"], how), joins.spread_join(left, right, ["k"], how, least=1000)
        assert spread.columns == plain.columns and spread.exceptAll(plain).count() == plain.exceptAll(spread).count() == 0
    assert joins.hot_keys(left.where("k != 'hot'"), ["k"], least=1000)[0] is None


def test_a_third_of_all_references_name_one_supplied_entity(spark, monkeypatch):
    """No task of the join reads more than three times the median."""
    monkeypatch.setattr(joins.spread_join, "__defaults__", ("left", 200))
    org = "https://o.example/hot"
    docs = documents(spark, *({"@id": f"https://c.example/{i}", "@type": "ceterms:Certification", "ceterms:ownedBy": org if i % 3 == 0 else f"https://o.example/{i}"} for i in range(6000)))
    beside = spark.createDataFrame([("s", json.dumps({"@id": org, "@type": "ceterms:Organization"}), "s.json", 0)], "doc_id string, raw string, source string, set_ord int")
    s = checks.session(docs, mini(), beside)
    rows = s.references().where("t_ord IS NULL")
    assert rows.where("s_source IS NOT NULL").count() == 2000 and rows.count() == 6000
    asked = rows.selectExpr("text AS open").persist()
    hot, bound = joins.hot_keys(asked, ["open"], least=200)
    keys = {r["open"]: r["salts"] for r in hot.collect()}
    assert set(keys) == {org} and 2000 / keys[org] <= 6000 / 4 / 4 + 1
