"""Tables of the vocabulary against the one that is built on the driver."""

import json

from lodestar.plans.mini_vocabulary import files, mini
from lodestar.sources import vocabulary_tables as tables
from lodestar.sources.vocabulary import Vocabulary


def made(spark, tmp_path, encodings, contexts):
    paths = {}
    for kind, some in (("e", encodings), ("c", contexts)):
        paths[kind] = []
        for i, x in enumerate(some):
            (tmp_path / f"{kind}{i}.json").write_text(json.dumps(x, indent=1))
            paths[kind].append(str(tmp_path / f"{kind}{i}.json"))
    rows = tables.entries(spark, paths["e"])
    return rows, tables.classes(rows), tables.properties(spark, rows, paths["c"]), tables.crosswalk(rows)


def check(spark, tmp_path, encodings, contexts):
    v = Vocabulary.build(encodings, contexts)
    rows, classes, properties, crosswalk = made(spark, tmp_path, encodings, contexts)
    assert sorted(map(tuple, classes.collect())) == sorted(map(tuple, v.class_table(spark).collect()))
    names = ["prop", "domain", "range", "target_scheme", "inverse", "id_coerced", "language_map", "has_entities", "universal"]
    assert sorted(map(str, properties.select(names).collect())) == sorted(map(str, v.property_table(spark).select(names).collect()))
    assert sorted(map(tuple, crosswalk.collect())) == sorted(map(tuple, v.crosswalk_table(spark).collect()))
    return v


def test_mini_vocabulary(spark, tmp_path):
    encoding, context = files()
    assert check(spark, tmp_path, [encoding], [context]).parents == mini().parents


def test_declarations_add_up(spark, tmp_path):
    encoding, context = files()
    more = {"@graph": [
        {"@id": "ceterms:A", "@type": "rdfs:Class", "rdfs:subClassOf": "ceterms:B"}, {"@id": "ceterms:B", "@type": "rdfs:Class", "rdfs:subClassOf": ["ceterms:A", "zz:z"]}, {"@id": "ceterms:A", "@type": "rdfs:Class", "owl:equivalentClass": "schema:A"},
        {"@id": "ceterms:ownedBy", "@type": "rdf:Property", "schema:domainIncludes": "ceterms:A", "owl:inverseOf": ["ceterms:owns", "x:y"]}, {"@id": "ceterms:hasPart", "@type": "rdf:Property", "owl:inverseOf": "ceterms:other"}, {"@id": "ceterms:hasPart", "@type": "rdf:Property"},
        {"@id": "odd", "@type": ["rdfs:Class"]}, {"@type": "rdfs:Class"}, {"@id": "ceterms:own", "@type": "rdf:Property", "owl:equivalentProperty": ["ceasn:x", "schema:name"]},
    ]}
    other = {"@context": {"ceterms": "https://other/", "ceterms:ownedBy": {"@type": "xsd:string"}, "ceterms:own": {"@type": "@id", "@container": "@language"}}}
    v = check(spark, tmp_path, [encoding, more], [context, other])
    assert v.closure["ceterms:A"] == {"ceterms:A", "ceterms:B", "zz:z"} and v.properties["ceterms:hasPart"].inverse == "ceterms:other"
