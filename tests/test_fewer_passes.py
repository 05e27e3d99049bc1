"""What the checks of a whole corpus send and read: each table once, and texts only where they are asked for."""

import re

from lodestar.operators import checks
from lodestar.plans import projection
from lodestar.plans.mini_vocabulary import mini
from lodestar.plans.registry import COLUMNS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark):
    raw = [
        '{"@graph": [{"@id": "https://e.example/a", "@type": "ceterms:Certification", "ceterms:ctid": "nope", "ceterms:ownedBy": ["https://e.example/o", "https://e.example/o", "Acme"]}, {"@id": "https://e.example/o", "@type": "ceterms:Place"}]}',
        '{"@graph": [{"@id": "https://credentialengineregistry.org/resources/x", "@type": ["ceterms:Certification", "ceterms:NotAClass"], "ceterms:ctid": 5, "ceterms:notAProperty": 1}]}',
        "{broken",
    ]
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "doc_id string, raw string")


def test_values_are_read_once_for_ctids(spark):
    s = checks.session(corpus(spark), mini())
    assert plan(checks.ctid_format(s)).count("Generate explode") <= 3


def test_findings_without_messages_are_as_many(spark):
    s = checks.session(corpus(spark), mini())
    want = sorted(map(tuple, checks.validate(s).select(*COLUMNS).collect()), key=str)
    assert want and sorted(map(tuple, checks.validated(s).collect()), key=str) == want
    shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(checks.validated(s)))
    assert not any("message" in x for x in shuffled)


def test_each_hash_of_an_order_is_made_once(spark):
    fields = projection._hashed_once(projection.FIELDS)
    found = re.findall(r"md5\(concat\('(\w+)'", fields)
    assert len(found) == len(set(found)) and len(set(found)) == len(set(re.findall(r"md5\(concat\('(\w+)'", projection.FIELDS)))
    spark.range(500).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").createOrReplaceTempView("orders")
    got, want = (spark.sql(x).orderBy("k").collect() for x in (fields, projection.FIELDS))
    assert got == want


def test_large_documents_are_gathered_as_numbers(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id % 10 AS l_suppkey", "id AS l_orderkey", "cast(id % 7 + 1 AS int) AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(projection, "TASK_ROWS", 500)
    docs = projection.large(spark, str(tmp_path))
    assert len(re.findall(r"Exchange hashpartitioning", plan(docs))) == 1
    assert docs.rdd.getNumPartitions() == 8 and docs.count() == 10
