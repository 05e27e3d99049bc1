"""Every finding code, positive and negative, on small documents."""

import json

import pytest

from lodestar.operators import checks, findings
from lodestar.operators.flatten import Walker, flatten, nodes_of_text, values_of
from lodestar.plans.mini_vocabulary import files, mini
from lodestar.sources.vocabulary import Vocabulary

R = "https://credentialengineregistry.org/resources/"
U = ["0f6d1c1e-52a3-4c7b-9a01-aa00bb11cc{:02d}".format(i) for i in range(10)]
C = [f"ce-{u}" for u in U]
ID = [R + c for c in C]


def graph(*nodes):
    return {"@graph": list(nodes)}


def cert(i=0, **more):
    return {"@id": ID[i], "@type": "ceterms:Certification", "ceterms:ctid": C[i], **{k.replace("__", ":"): v for k, v in more.items()}}


#: name: document and the findings it must have, as code: value
CASES = {
    "clean_empty": (graph(), []),
    "clean_single": (cert(), []),
    "clean_array": ([{"@type": "ceterms:Course"}], []),
    "clean_framework": (graph({"@id": ID[0], "@type": "ceasn:CompetencyFramework", "ceasn:hasTopChild": ID[1]}, {"@id": ID[1], "@type": "ceasn:Competency", "ceasn:isPartOf": ID[0], "ceasn:isTopChildOf": ID[0], "ceasn:hasChild": ID[2]}, {"@id": ID[2], "@type": "ceasn:Competency", "ceasn:isPartOf": {"@id": ID[0]}, "ceasn:isChildOf": [ID[1]]}), []),
    "bare_uuid": ({"@id": R + U[0], "@type": "ceterms:Certification", "ceterms:ctid": U[0]}, [("CTID_BARE_UUID", U[0]), ("REGISTRY_URI_MALFORMED", R + U[0])]),
    "upper_v1": ([{"ceterms:ctid": C[0].upper()}, {"ceterms:ctid": C[0].replace("-4c7b", "-1c7b")}], [("CTID_UPPERCASE", C[0].upper()), ("CTID_NOT_UUIDV4", C[0].replace("-4c7b", "-1c7b"))]),
    "not_text": ({"ceterms:ctid": [True, None, {"x": 1}]}, [("CTID_MALFORMED", "True"), ("CTID_MALFORMED", "None"), ("CTID_MALFORMED", "NestedRef(target_path='$.ceterms:ctid[2]', target_id=None)")]),
    "newline": ({"ceterms:ctid": C[0] + "\n"}, []),
    "two_newlines": ({"ceterms:ctid": C[0] + "\r\n"}, [("CTID_MALFORMED", C[0] + "\r\n")]),
    "tail": ({"schema:x": R + "zzz"}, [("REGISTRY_URI_MALFORMED", R + "zzz")]),
    "mismatch": ({"@id": ID[0], "ceterms:ctid": C[1]}, [("CTID_URI_MISMATCH", C[1])]),
    "kinds": (cert(ceterms__ownedBy=[U[1], C[1], "Acme", "x:y"]), [("REF_BARE_UUID", U[1]), ("REF_BARE_CTID", C[1]), ("REF_NOT_IRI", "Acme"), ("REF_OUTSIDE_PAYLOAD", "x:y")]),
    "literal_id": (cert(ceterms__subjectWebpage="no scheme"), []),
    "bnode": (cert(ceterms__ownedBy="_:gone"), [("REF_UNRESOLVED_BNODE", "_:gone")]),
    "nested": (cert(ceterms__ownedBy={"@type": "ceterms:CredentialOrganization"}), []),
    "full_iri": (cert(**{"https://purl.org/ctdl/terms/ownedBy": "_:gone"}), [("REF_UNRESOLVED_BNODE", "_:gone")]),
    "unknown": ({"@type": ["ceterms:Zzz", "foaf:Agent"], "ceasn:zzz": 1, "foaf:name": "x"}, [("UNKNOWN_CLASS", "ceterms:Zzz"), ("UNKNOWN_PROPERTY", "-")]),
    "domain": ({"@id": "_:o", "@type": "ceterms:Organization", "ceterms:isPartOf": []}, [("DOMAIN_VIOLATION", "@type=[ceterms:Organization]")]),
    "range": (graph(cert(ceterms__ownedBy="_:p"), {"@id": "_:p", "@type": "ceterms:Place"}), [("RANGE_VIOLATION", "_:p")]),
    "range_nested": (cert(ceterms__ownedBy={"@type": "ceterms:Place"}), [("RANGE_VIOLATION", "$.ceterms:ownedBy[0]")]),
    "universal": (graph(cert(ceterms__isSimilarTo="_:p"), {"@id": "_:p", "@type": "ceterms:Place"}), []),
    "untyped": (graph(cert(ceterms__ownedBy="_:p"), {"@id": "_:p"}), []),
    "concept": (cert(ceterms__creditUnitType={"@type": "ceterms:CredentialAlignmentObject"}), [("CONCEPT_RANGE_CONFLICT", "$.ceterms:creditUnitType[0]")]),
    "no_scheme": (cert(ceterms__classification={"@type": "ceterms:CredentialAlignmentObject"}), [("RANGE_VIOLATION", "$.ceterms:classification[0]")]),
    "version": (graph({"@id": "_:a", "@type": "ceterms:TransferValueProfile", "ceterms:previousVersion": "_:b"}, {"@id": "_:b", "@type": "ceterms:TransferValueProfile"}), [("VERSION_RANGE_CONFLICT", "_:b")]),
    "version_other": (graph({"@id": "_:a", "@type": "ceterms:TransferValueProfile", "ceterms:previousVersion": "_:b"}, {"@id": "_:b", "@type": "ceterms:Pathway"}), [("RANGE_VIOLATION", "_:b")]),
    "child_of": (graph({"@id": "_:c", "@type": "ceasn:Competency", "ceasn:isChildOf": "_:f"}, {"@id": "_:f", "@type": "ceasn:CompetencyFramework", "ceasn:hasChild": "_:c"}), [("RANGE_DOCS_CONFLICT", "_:f")]),
    "framework": (graph({"@id": ID[0], "@type": "ceasn:CompetencyFramework"}, {"@id": ID[1], "@type": "ceasn:Competency", "ceasn:isPartOf": ID[5]}), [("ISPARTOF_FRAMEWORK_MISMATCH", ID[5]), ("REF_OUTSIDE_PAYLOAD", ID[5])]),
    "no_framework": ({"@type": "ceasn:Competency", "ceasn:isPartOf": ID[5]}, [("REF_OUTSIDE_PAYLOAD", ID[5])]),
    "one_way": (graph(cert(ceterms__hasPart=ID[1]), {"@id": ID[1], "@type": "ceterms:Course"}), [("INVERSE_ONE_DIRECTION", ID[1])]),
    "inverse": (graph(cert(ceterms__hasPart=ID[1]), {"@id": ID[1], "@type": "ceterms:Course", "ceterms:isPartOf": []}), [("INVERSE_MISMATCH", ID[1])]),
    "inverse_object": (graph(cert(ceterms__hasPart=ID[1]), {"@id": ID[1], "@type": "ceterms:Course", "ceterms:isPartOf": {"@id": ID[0], "@type": "ceterms:Certification"}}), [("INVERSE_MISMATCH", ID[1]), ("INVERSE_ONE_DIRECTION", ID[0])]),
    "anonymous": (graph({"@type": "ceterms:Certification", "ceterms:hasPart": ID[1]}, {"@id": ID[1], "@type": "ceterms:Course"}), []),
    "first_wins": (graph(cert(ceterms__ownedBy="_:o"), {"@id": "_:o", "@type": "ceterms:Place"}, {"@id": "_:o", "@type": "ceterms:Organization"}), [("RANGE_VIOLATION", "_:o")]),
    "twice": (cert(ceterms__ownedBy=["_:gone", "_:gone"]), [("REF_UNRESOLVED_BNODE", "_:gone")]),
}
BROKEN = {"broken": "{", "scalar": "3", "graph_object": '{"@graph": {}}', "not_objects": "[1]"}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, raw string")


@pytest.fixture(scope="module")
def session(spark):
    rows = [(k, json.dumps(d)) for k, (d, _) in CASES.items()] + list(BROKEN.items()) + [("null", None)]
    return checks.session(documents(spark, rows), mini())


@pytest.fixture(scope="module")
def found(session):
    return checks.validate(session).persist()


def test_every_case(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["code"], r["value"]))
    for name, (_, want) in CASES.items():
        assert sorted(got.get(name, [])) == sorted(want), name


def test_gates(session, found):
    docs = session.nodes.select("doc_id").unionAll(found.sparkSession.createDataFrame([("clean_empty",)], "doc_id string"))
    codes = {r["doc_id"]: r["exit_code"] for r in findings.exit_codes(docs, session.nodes, found).collect()}
    assert codes["clean_empty"] == 0 and codes["bare_uuid"] == 1 and codes["upper_v1"] == 0 and codes["concept"] == 0
    assert all(codes[k] == 2 for k in (*BROKEN, "null"))
    warned = {r["doc_id"]: r["exit_code"] for r in findings.exit_codes(docs, session.nodes, found, "warning").collect()}
    assert warned["upper_v1"] == 1 and warned["concept"] == 0 and warned["no_framework"] == 0
    batch = findings.batch_gate(docs, session.nodes, found).collect()[0]
    assert batch["exit_code"] == 2 and batch["unreadable"] == len(BROKEN) + 1
    assert "exit_code=2" in [r[0] for r in findings.output_lines(findings.batch_gate(docs, session.nodes, found)).collect()]
    with pytest.raises(ValueError):
        findings.exit_codes(docs, session.nodes, found, "unverifiable")


def test_renderings(found):
    one = found.where("doc_id = 'kinds'")
    text = findings.as_text(one).collect()[0]["text"]
    assert text.splitlines()[0].startswith("ERROR        REF_BARE_UUID") or "WARNING      REF_NOT_IRI" in text
    assert text.endswith("4 finding(s): 1 ERROR, 2 WARNING, 0 INFO, 1 UNVERIFIABLE")
    data = json.loads(findings.as_json(one, "t", "1").collect()[0]["json"])
    assert [f["code"] for f in data["findings"]] == ["REF_BARE_CTID", "REF_BARE_UUID", "REF_NOT_IRI", "REF_OUTSIDE_PAYLOAD"] and data["summary"]["INFO"] == 0
    line = findings.as_annotations(found.where("doc_id = 'two_newlines'")).collect()[0]["line"]
    assert line.startswith("::error file=two_newlines,title=CTID_MALFORMED (ERROR)::$: ceterms:ctid = ") and "%0D%0A" in line


def test_order_does_not_depend_on_partitions(spark, found):
    rows = [(k, json.dumps(d)) for k, (d, _) in reversed(CASES.items())]
    again = checks.validate(checks.session(documents(spark, rows).repartition(7), mini()))
    assert findings.ordered(again).collect() == findings.ordered(found.where(f"doc_id != 'null'")).collect()


def test_no_cartesian_products(session):
    plan = checks.validate(session)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def supplied(spark, *entries):
    return spark.createDataFrame([(f"d{i}", json.dumps(e), f"file{i}.json", i) for i, e in enumerate(entries)], "doc_id string, raw string, source string, set_ord int")


def codes_of(spark, doc, *beside):
    s = checks.session(documents(spark, [("d", json.dumps(doc))]), mini(), supplied(spark, *beside))
    return checks.validate(s).collect()


def test_supplied_documents(spark):
    doc = cert(ceterms__ownedBy=ID[7])
    (r,) = codes_of(spark, doc, {"@id": ID[7], "@type": "ceterms:Organization", "ceterms:ctid": U[7]})
    assert r["code"] == "REF_RESOLVED_SUPPLIED" and "file0.json" in r["message"] and "ceterms:Organization" in r["message"]
    assert {r["code"] for r in codes_of(spark, doc, {"@id": ID[7], "@type": "ceterms:Place"})} == {"REF_RESOLVED_SUPPLIED", "RANGE_VIOLATION"}
    (r,) = codes_of(spark, doc, {"@id": ID[6], "@type": "ceterms:Place"})
    assert r["code"] == "REF_OUTSIDE_PAYLOAD" and "None of the 1 document " in r["message"]
    (r,) = codes_of(spark, doc, {"@id": ID[7], "@type": "ceterms:Organization"}, {"@id": ID[7], "@type": "ceterms:Place"})
    assert "file0.json" in r["message"]
    assert checks.supplied_entities(supplied(spark, {"@id": "_:b", "@type": "ceterms:Place"}), mini()).count() == 0
    comp = {"@id": ID[1], "@type": "ceasn:Competency", "ceasn:isPartOf": ID[5]}
    assert "ISPARTOF_FRAMEWORK_MISMATCH" in {r["code"] for r in codes_of(spark, comp, {"@id": ID[0], "@type": "ceasn:CompetencyFramework"})}
    with pytest.raises(ValueError):
        checks.session(documents(spark, [("d", "{}")]), mini(), spark.createDataFrame([("x", "{", "x", 0)], "doc_id string, raw string, source string, set_ord int"))


def test_flatten_paths_and_collisions(spark):
    v, walker = mini(), Walker(mini())
    paths = lambda d: [path for _, path, *_ in nodes_of_text(json.dumps(d), walker)]
    assert paths({"@graph": [{}, {"ceterms:ownedBy": [{"x": 1}, "a", {"y": 2}]}]}) == ["$.@graph[0]", "$.@graph[1]", "$.@graph[1].ceterms:ownedBy[0]", "$.@graph[1].ceterms:ownedBy[2]"]
    assert paths([{}]) == ["$"] and paths([{}, {}]) == ["$[0]", "$[1]"]
    ((_, _, _, types, _, props),) = nodes_of_text('{"ceterms:ctid": "a", "https://purl.org/ctdl/terms/ctid": ["b"], "ceterms:name": {"en": "x"}, "@type": ""}', walker)
    assert types == [] and [text for _, text, _ in props["ceterms:ctid"]] == ["b"]
    ((*_, props),) = nodes_of_text('{"a:b": NaN, "a:c": 123456789012345678901234567890}', walker)
    assert props["a:c"][0][1] == "123456789012345678901234567890"
    rows = values_of(flatten(documents(spark, [("d", '{"a:b": "\\ud800", "a:c": []}')]), v)).collect()
    assert [r["text"] for r in rows] == ["?"]


def test_vocabulary_rules():
    encoding, context = files()
    v = Vocabulary.build([encoding, {"@graph": [{"@id": "ceterms:A", "@type": "rdfs:Class", "rdfs:subClassOf": "ceterms:B"}, {"@id": "ceterms:B", "@type": "rdfs:Class", "rdfs:subClassOf": ["ceterms:A"]}, {"@id": "ceterms:ownedBy", "@type": "rdf:Property", "schema:domainIncludes": "ceterms:A", "owl:inverseOf": ["ceterms:owns"]}]}], [context, {"@context": {"ceterms": "https://other/"}}])
    assert v.closure["ceterms:A"] == {"ceterms:A", "ceterms:B"} and v.ancestors(["zz:z"]) == {"zz:z"}
    p = v.properties["ceterms:ownedBy"]
    assert "ceterms:A" in p.domain and "ceterms:Credential" in p.domain and p.inverse == "ceterms:owns" and p.id_coerced
    assert v.prefixes["ceterms"] == "https://purl.org/ctdl/terms/"
    assert v.compact("https://purl.org/ctdl/terms/x") == "ceterms:x" and v.compact("https://purl.org/ctdl/terms/") == "https://purl.org/ctdl/terms/"
    assert v.normalize("http://schema.org/name") == "schema:name" and v.compact("http://schema.org/name") == "http://schema.org/name"
    assert v.crosswalk[(True, "equivalent", "schema:Course")] == ("ceterms:Course",) and v.siblings("ceterms:creditLevelType") == ["ceterms:audienceLevelType"]
    with pytest.raises(ValueError):
        Vocabulary.build([{"@graph": {}}], [])


def test_references_are_resolved_once(spark):
    """All checks together read the nodes by narrow scans: what needs a shuffle is written before."""
    docs = spark.createDataFrame([("d", '{"@id": "_:a", "@type": "ceterms:Certification", "ceterms:ownedBy": "_:b"}')], "doc_id string, raw string")
    s = checks.session(docs, mini())
    plan = checks.validate(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 14 and plan.count("Aggregate [") <= 2 and "min_by" not in plan


def test_many_supplied_sources_and_frameworks(spark):
    docs = spark.createDataFrame([("d", '[{"@id": "_:c", "@type": "ceasn:Competency", "ceasn:isPartOf": "https://x.example/f"}]')], "doc_id string, raw string")
    beside = spark.createDataFrame([(str(i), f'{{"@id": "https://f.example/{i:02d}", "@type": "ceasn:CompetencyFramework"}}', f"f{i}.json", i) for i in range(30)], "doc_id string, raw string, source string, set_ord int")
    found = {r["code"]: r["message"] for r in checks.validate(checks.session(docs, mini(), beside)).collect()}
    assert "None of the 30 documents supplied (f0.json" in found["REF_OUTSIDE_PAYLOAD"] and "f10.json" not in found["REF_OUTSIDE_PAYLOAD"]
    said = found["ISPARTOF_FRAMEWORK_MISMATCH"]
    assert "https://f.example/00" in said and "https://f.example/10" not in said and "20 more supplied" in said
