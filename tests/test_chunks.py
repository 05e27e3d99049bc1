"""Renderings in chunks equal the whole ones, also of documents that span tasks."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import findings

SCHEMA = "doc_id string, code string, severity string, entity string, property string, value string, message string, rule struct<citation:string,url:string,retrieved:string>"


def rows(spark, sizes):
    made = [(doc, f"C{i % 3}", findings.SEVERITIES[i % 4], f"_:é{i % 7}", "p:q", f'v "{i}"\n', "says", ("c", "u", "-")) for doc, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(made, SCHEMA).repartition(5).persist()


def whole(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["doc_id"] or "", r["part"], r["chunk"])):
        out[r["doc_id"]] = out.get(r["doc_id"], "") + r["text"]
    return out


@pytest.fixture
def many_tasks(spark):
    """Small partitions are left apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_chunks_put_together_are_the_rendering(spark, many_tasks):
    found = rows(spark, {"a": 1, "b": 700, "c": 3, "d": 40, None: 2})
    want = {r["doc_id"]: r["text"] for r in findings.as_text(found).collect()}
    for limit in (1, 300, 5000, 1 << 20):
        assert whole(findings.text_chunks(found, limit)) == want
    want = {r["doc_id"]: r["json"] for r in findings.as_json(found, 't"ool', "1").collect()}
    for limit in (1, 300, 5000, 1 << 20):
        assert whole(findings.json_chunks(found, 't"ool', "1", limit)) == want
    parts = findings.json_chunks(found, "t", "1", 300).where("doc_id = 'b' AND part BETWEEN 0 AND 1000").agg(F.countDistinct("part").alias("n")).collect()
    assert parts[0]["n"] > 1  # one document, several tasks
    assert findings.text_chunks(found.limit(0)).count() == 0 and findings.json_chunks(found.limit(0), "t", "1").count() == 0


def test_a_document_of_very_many_findings(spark):
    n = 200_000
    found = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("C").alias("code"), F.lit("ERROR").alias("severity"), F.format_string("_:%06d", "id").alias("entity"), F.lit("p").alias("property"), F.lit("v").alias("value"), F.lit("m").alias("message"), F.struct(F.lit("c").alias("citation"), F.lit("u").alias("url"), F.lit("-").alias("retrieved")).alias("rule"))
    chunks = findings.json_chunks(found, "t", "1", 100_000).persist()
    assert chunks.agg(F.max(F.length("text"))).collect()[0][0] < 101_000
    data = json.loads(whole(chunks)["d"])
    assert [f["entity"] for f in data["findings"]] == [f"_:{i:06d}" for i in range(n)] and data["summary"]["ERROR"] == n
