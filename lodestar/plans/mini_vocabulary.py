"""A small vocabulary for tests and for the queries over the provided tables.

Fixed values: facts of the published schema encodings, the few that the queries
and tests need. It is no substitute for the encodings; load those with
``Vocabulary.read``.
"""

from __future__ import annotations

from functools import cache

from ..sources.vocabulary import Vocabulary

PREFIXES = {
    "ceterms": "https://purl.org/ctdl/terms/",
    "ceasn": "https://purl.org/ctdlasn/terms/",
    "schema": "https://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}

CLASSES: dict[str, list[str]] = {
    "ceterms:Organization": [],
    "ceterms:CredentialOrganization": ["ceterms:Organization"],
    "ceterms:Credential": [],
    "ceterms:Certification": ["ceterms:Credential"],
    "ceterms:Certificate": ["ceterms:Credential"],
    "ceterms:LearningOpportunityProfile": [],
    "ceterms:Course": ["ceterms:LearningOpportunityProfile"],
    "ceterms:LearningProgram": ["ceterms:LearningOpportunityProfile", "schema:EducationalOccupationalProgram"],
    "ceterms:CredentialAlignmentObject": ["schema:AlignmentObject"],
    "ceterms:FinancialAlignmentObject": [],
    "ceterms:Place": [],
    "ceterms:PostalAddress": [],
    "ceterms:ContactPoint": [],
    "ceterms:GeoCoordinates": [],
    "ceterms:TransferValueProfile": [],
    "ceterms:Pathway": [],
    "ceterms:Collection": [],
    "ceasn:Competency": [],
    "ceasn:CompetencyFramework": [],
    "asn:Rubric": [],
    "skos:Concept": [],
}

EQUIVALENT_CLASSES = {f"ceterms:{c}": [f"schema:{c}"] for c in ("ContactPoint", "Course", "GeoCoordinates", "Organization", "Place", "PostalAddress")}

_VERSIONED = ["ceasn:Competency", "ceasn:CompetencyFramework", "asn:Rubric", "ceterms:Collection", "ceterms:Pathway", "ceterms:TransferValueProfile"]
_THINGS = ["ceterms:Credential", "ceterms:LearningOpportunityProfile"]
_NAMED = [*_THINGS, "ceterms:Organization"]

#: property: domain, range, and what else is declared
PROPERTIES: dict[str, tuple[list[str], list[str], dict]] = {
    "ceterms:ctid": ([], ["xsd:string"], {}),
    "ceterms:name": (_NAMED, ["rdf:langString"], {"map": True, "same": ["schema:name"]}),
    "ceasn:name": (["ceasn:CompetencyFramework"], ["rdf:langString"], {"map": True, "same": ["schema:name"]}),
    "ceterms:description": (_NAMED, ["rdf:langString"], {"map": True, "same": ["schema:description"]}),
    "ceasn:description": (["ceasn:CompetencyFramework"], ["rdf:langString"], {"map": True, "same": ["schema:description"]}),
    "ceasn:competencyText": (["ceasn:Competency"], ["rdf:langString"], {"map": True}),
    "ceterms:inLanguage": ([], ["xsd:language"], {}),
    "ceterms:subjectWebpage": ([], ["xsd:anyURI"], {"id": True, "same": ["schema:url"]}),
    "ceterms:ownedBy": (_THINGS, ["ceterms:Organization"], {"id": True}),
    "ceterms:offeredBy": (_THINGS, ["ceterms:Organization"], {"id": True, "same": ["schema:provider"]}),
    "ceterms:hasPart": (_THINGS, _THINGS, {"id": True, "inverse": "ceterms:isPartOf", "same": ["schema:hasPart"]}),
    "ceterms:isPartOf": (_THINGS, _THINGS, {"id": True, "inverse": "ceterms:hasPart"}),
    "ceasn:isPartOf": (["ceasn:Competency"], ["ceasn:CompetencyFramework"], {"id": True}),
    "ceasn:hasChild": (["ceasn:Competency", "ceasn:CompetencyFramework"], ["ceasn:Competency"], {"id": True, "inverse": "ceasn:isChildOf"}),
    "ceasn:isChildOf": (["ceasn:Competency"], ["ceasn:Competency"], {"id": True, "inverse": "ceasn:hasChild"}),
    "ceasn:hasTopChild": (["ceasn:CompetencyFramework"], ["ceasn:Competency"], {"id": True}),
    "ceasn:isTopChildOf": (["ceasn:Competency"], ["ceasn:CompetencyFramework"], {"id": True}),
    "ceterms:creditUnitType": ([], ["skos:Concept"], {"id": True, "scheme": ["ceterms:CreditUnit"]}),
    "ceterms:creditLevelType": ([], ["skos:Concept"], {"id": True, "scheme": ["ceterms:AudienceLevel"]}),
    "ceterms:audienceLevelType": ([], ["ceterms:CredentialAlignmentObject"], {"id": True, "scheme": ["ceterms:AudienceLevel"]}),
    "ceterms:classification": ([], ["skos:Concept"], {"id": True}),
    "ceterms:isSimilarTo": ([], ["rdfs:Resource"], {"id": True}),
    "ceterms:latestVersion": ([*_THINGS, *_VERSIONED], _THINGS, {"id": True}),
    "ceterms:nextVersion": ([*_THINGS, *_VERSIONED], _THINGS, {"id": True}),
    "ceterms:previousVersion": ([*_THINGS, *_VERSIONED], _THINGS, {"id": True}),
    "ceterms:teaches": (["ceterms:LearningOpportunityProfile"], ["ceasn:Competency", "ceterms:CredentialAlignmentObject"], {"id": True}),
    "ceterms:address": (["ceterms:Organization"], ["ceterms:Place"], {"id": True, "same": ["schema:address"]}),
    "ceterms:image": (["ceterms:Credential", "ceterms:Organization"], ["xsd:anyURI"], {"id": True, "same": ["schema:image"]}),
    "ceterms:streetAddress": (["ceterms:Place", "ceterms:PostalAddress"], ["rdf:langString"], {"map": True, "same": ["schema:streetAddress"]}),
    "ceterms:startDate": (["ceterms:Organization"], ["schema:Date"], {"same": ["schema:startDate"]}),
    "ceasn:dateValidFrom": (["ceasn:CompetencyFramework"], ["schema:Date"], {"same": ["schema:startDate"]}),
    "ceterms:keyword": ([], ["rdf:langString"], {"map": True, "under": ["schema:about"]}),
    "ceterms:subject": ([], ["ceterms:CredentialAlignmentObject"], {"id": True, "under": ["schema:about"]}),
    "ceterms:framework": (["ceterms:CredentialAlignmentObject", "ceterms:FinancialAlignmentObject"], ["xsd:anyURI"], {"id": True}),
    "ceterms:targetNode": (["ceterms:CredentialAlignmentObject", "ceterms:FinancialAlignmentObject"], ["xsd:anyURI"], {"id": True}),
    "skos:prefLabel": ([], ["rdf:langString"], {"map": True}),
    "skos:broader": ([], ["skos:Concept"], {"id": True}),
}


def files() -> tuple[dict, dict]:
    """An encoding and a context in the form of the published files."""
    graph: list[dict] = [{"@id": c, "@type": "rdfs:Class", "rdfs:subClassOf": p, **({"owl:equivalentClass": EQUIVALENT_CLASSES[c]} if c in EQUIVALENT_CLASSES else {})} for c, p in CLASSES.items()]
    context: dict = dict(PREFIXES)
    for term, (domain, range_, more) in PROPERTIES.items():
        entry = {"@id": term, "@type": "rdf:Property", "schema:domainIncludes": domain, "schema:rangeIncludes": range_}
        for key, name in (("inverse", "owl:inverseOf"), ("scheme", "meta:targetScheme"), ("same", "owl:equivalentProperty"), ("under", "rdfs:subPropertyOf")):
            if key in more:
                entry[name] = more[key]
        graph.append(entry)
        if "id" in more or "map" in more:
            context[term] = {"@type": "@id"} if "id" in more else {"@container": "@language"}
    return {"@graph": graph}, {"@context": context}


@cache
def mini() -> Vocabulary:
    encoding, context = files()
    return Vocabulary.build([encoding], [context])
