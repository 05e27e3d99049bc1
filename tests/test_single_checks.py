"""A check resolves the references that it reads, and no others."""

import json

import pytest

from lodestar.operators import checks, findings
from lodestar.plans import projection
from lodestar.plans.mini_vocabulary import mini

DOC = [
    {"@id": "_:a", "@type": ["ceterms:Certification", "ceterms:NotAClass"], "ceterms:ownedBy": "_:o", "ceterms:notAProperty": "x", "ceterms:hasPart": ["_:c", {"@id": "_:c"}], "ceterms:creditUnitType": {"@type": "ceterms:CredentialAlignmentObject"}},
    {"@id": "_:o", "@type": "ceterms:Place"},
    {"@id": "_:o", "@type": "ceterms:Organization"},
    {"@id": "_:c", "@type": "ceterms:Course"},
    {"@id": "_:m", "@type": "ceasn:Competency", "ceasn:isPartOf": "https://f.example/gone"},
    {"@id": "_:f", "@type": "ceasn:CompetencyFramework"},
]


@pytest.fixture()
def session(spark):
    return checks.session(spark.createDataFrame([("d", json.dumps({"@graph": DOC}))], "doc_id string, raw string"), mini())


def test_only_what_is_read_is_resolved(session, monkeypatch):
    whole, asked = checks.Session._resolved, []
    monkeypatch.setattr(checks.Session, "_resolved", lambda self, wanted: asked.append(wanted) or whole(self, wanted))
    codes = lambda df: sorted({r["code"] for r in df.collect()})
    assert codes(checks.undeclared_terms(session)) == ["UNKNOWN_CLASS", "UNKNOWN_PROPERTY"] and codes(checks.domains(session)) == [] and asked == []
    assert codes(checks.ranges(session)) == ["CONCEPT_RANGE_CONFLICT", "RANGE_VIOLATION"] and codes(checks.frameworks(session)) == ["ISPARTOF_FRAMEWORK_MISMATCH"]
    assert len(asked) == 2 and checks.ENTITIES not in asked


def test_parts_and_whole_agree(session):
    parts = checks.ctid_format(session)
    for check in (checks.identifier_kind, checks.references, checks.undeclared_terms, checks.domains, checks.ranges, checks.frameworks, checks.inverses):
        parts = parts.unionAll(check(session))
    found = checks.validate(session)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(parts.dropDuplicates()) == rows(found) and session._references is not None
    assert rows(checks.severities(session)) == rows(found.select("doc_id", "severity"))
    docs = session.nodes.select("doc_id").distinct()
    assert [r["exit_code"] for r in findings.exit_codes(docs, session.nodes, checks.every(session)).collect()] == [1]


def test_tasks_make_a_bounded_number_of_documents(spark, monkeypatch):
    monkeypatch.setattr(projection, "TASK_ROWS", 100)
    assert projection.dealt(spark.range(2_000).coalesce(1), "id").rdd.getNumPartitions() == 20
    assert projection.dealt(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
