"""The vocabulary: classes, properties, prefixes and the crosswalk to other vocabularies.

It is an input: schema encodings (``@graph`` arrays) and JSON-LD contexts, a
few thousand terms at most, held on the driver and sent to tasks whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.identifiers import CHECKED_PREFIXES

# Range terms that stand for literals, and the one that admits everything.
LITERAL_RANGES = frozenset("xsd:anyURI xsd:boolean xsd:date xsd:dateTime xsd:decimal xsd:duration xsd:float xsd:integer xsd:language xsd:string rdf:langString rdfs:Literal schema:Date schema:Duration".split())
UNIVERSAL_RANGE = "rdfs:Resource"
CONCEPT, ALIGNMENT = "skos:Concept", "ceterms:CredentialAlignmentObject"

PROPERTY = "prop string, domain array<string>, range array<string>, inverse string, id_coerced boolean, language_map boolean, target_scheme array<string>, has_entities boolean, universal boolean, scheme_bound boolean, siblings array<string>, dropped array<string>, domain_below array<string>, range_below array<string>"


@dataclass
class Property:
    domain: set[str] = field(default_factory=set)
    range: set[str] = field(default_factory=set)
    scheme: set[str] = field(default_factory=set)
    inverse: str | None = None
    id_coerced: bool = False
    language_map: bool = False

    @property
    def has_entities(self) -> bool:
        return bool(self.range - LITERAL_RANGES)

    @property
    def takes_reference(self) -> bool:
        return self.id_coerced and self.has_entities


def _listed(value: Any) -> list[Any]:
    return value if isinstance(value, list) else [] if value is None else [value]


@dataclass
class Vocabulary:
    parents: dict[str, set[str]] = field(default_factory=dict)
    properties: dict[str, Property] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    #: (is_class, relation, foreign term): CTDL terms, sorted
    crosswalk: dict[tuple[bool, str, str], tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def build(cls, encodings: Iterable[dict], contexts: Iterable[dict]) -> Vocabulary:
        """Encodings add up, the last inverse wins; of contexts the first to name a key wins."""
        v = cls()
        walk: dict[tuple[bool, str, str], set[str]] = {}
        relations = {"rdfs:Class": (("owl:equivalentClass", "equivalent"), ("rdfs:subClassOf", "specialized")), "rdf:Property": (("owl:equivalentProperty", "equivalent"), ("rdfs:subPropertyOf", "specialized"))}
        for encoding in encodings:
            if not isinstance(encoding.get("@graph"), list):
                raise ValueError("an encoding needs an @graph array")
            for entry in encoding["@graph"]:
                term, kind = (entry.get("@id"), entry.get("@type")) if isinstance(entry, dict) else (None, None)
                if not isinstance(term, str) or not isinstance(kind, str) or kind not in relations:
                    continue
                if kind == "rdfs:Class":
                    v.parents.setdefault(term, set()).update(_listed(entry.get("rdfs:subClassOf")))
                else:
                    p = v.properties.setdefault(term, Property())
                    for into, key in ((p.domain, "schema:domainIncludes"), (p.range, "schema:rangeIncludes"), (p.scheme, "meta:targetScheme")):
                        into.update(_listed(entry.get(key)))
                    if inverse := _listed(entry.get("owl:inverseOf")):
                        p.inverse = inverse[0]
                if term.startswith(CHECKED_PREFIXES):
                    for key, relation in relations[kind]:
                        for foreign in _listed(entry.get(key)):
                            if isinstance(foreign, str) and not foreign.startswith(CHECKED_PREFIXES):
                                walk.setdefault((kind == "rdfs:Class", relation, foreign), set()).add(term)
        v.crosswalk = {k: tuple(sorted(t)) for k, t in walk.items()}
        coercions: dict[str, dict] = {}
        for context in contexts:
            for key, value in context["@context"].items():
                if isinstance(value, str):
                    v.prefixes.setdefault(key, value)
                elif isinstance(value, dict):
                    coercions.setdefault(key, value)
        for term, p in v.properties.items():
            how = coercions.get(term, {})
            p.id_coerced, p.language_map = how.get("@type") == "@id", how.get("@container") == "@language"
        return v

    @classmethod
    def read(cls, spark: SparkSession, encodings: list[str], contexts: list[str]) -> Vocabulary:
        """From files that Spark can read, in the order given."""
        load = lambda path: json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls.build(map(load, encodings), map(load, contexts))

    @cached_property
    def namespaces(self) -> list[tuple[str, str]]:
        return sorted(((ns, p) for p, ns in self.prefixes.items()), key=lambda x: -len(x[0]))

    def compact(self, iri: str) -> str:
        if "://" in iri:
            for ns, prefix in self.namespaces:
                if iri.startswith(ns) and len(iri) > len(ns):
                    return f"{prefix}:{iri[len(ns):]}"
        return iri

    def normalize(self, term: str) -> str:
        return self.compact("https" + term[4:] if term.startswith("http://schema.org/") else term)

    @cached_property
    def closure(self) -> dict[str, frozenset[str]]:
        """Each class with all it descends from, itself included; cycles end where they close."""
        out = {}
        for term in self.parents:
            seen, todo = set(), [term]
            while todo:
                t = todo.pop()
                if t not in seen:
                    seen.add(t)
                    todo.extend(self.parents.get(t, ()))
            out[term] = frozenset(seen)
        return out

    def ancestors(self, terms: Iterable[str]) -> set[str]:
        return {a for t in terms for a in self.closure.get(t, (t,))}

    def below(self, terms: Iterable[str]) -> list[str]:
        """Declared classes that are one of ``terms`` or descend from it."""
        wanted = set(terms)
        return sorted(t for t, up in self.closure.items() if up & wanted)

    def siblings(self, prop: str) -> list[str]:
        """Other properties of one of its schemes whose range is the alignment object."""
        own = self.properties[prop].scheme
        return sorted(t for t, p in self.properties.items() if t != prop and ALIGNMENT in p.range and p.scheme & own)

    def property_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, sorted(p.domain), sorted(p.range), p.inverse, p.id_coerced, p.language_map, sorted(p.scheme), p.has_entities, UNIVERSAL_RANGE in p.range, CONCEPT in p.range and bool(p.scheme), self.siblings(t), sorted(p.domain - p.range), self.below(p.domain), self.below(p.range))
            for t, p in sorted(self.properties.items())
        ]
        return spark.createDataFrame(rows, PROPERTY)

    def class_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, sorted(p), sorted(self.closure[t])) for t, p in sorted(self.parents.items())], "term string, parents array<string>, ancestors array<string>")

    def crosswalk_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, r, f, list(t)) for (c, r, f), t in sorted(self.crosswalk.items())], "is_class boolean, relation string, foreign string, ctdl array<string>")
