"""Queries of the engine over the provided tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import checks, findings, mapping, markup, survey
from ..operators.closure import ancestors
from ..operators.tables import kept
from . import projection
from .mini_vocabulary import PREFIXES, mini

Query = Callable[[SparkSession, str], DataFrame]
COLUMNS = ("doc_id", "code", "severity", "entity", "property", "value")

#: query: the check that runs and the codes it is asked for
FAMILIES = {
    "ctid_grammar": (checks.ctid_format, ("CTID_BARE_UUID", "CTID_UPPERCASE", "CTID_MALFORMED", "CTID_NOT_UUIDV4")),
    "ctid_uri_mismatch": (checks.ctid_format, ("CTID_URI_MISMATCH",)),
    "registry_uri": (checks.ctid_format, ("REGISTRY_URI_MALFORMED",)),
    "ref_kind": (checks.identifier_kind, ("REF_BARE_UUID", "REF_BARE_CTID", "REF_NOT_IRI")),
    "ref_resolution": (checks.references, ("REF_UNRESOLVED_BNODE", "REF_OUTSIDE_PAYLOAD", "REF_RESOLVED_SUPPLIED")),
    "unknown_terms": (checks.undeclared_terms, ("UNKNOWN_CLASS", "UNKNOWN_PROPERTY")),
    "domain": (checks.domains, ("DOMAIN_VIOLATION",)),
    "range": (checks.ranges, ("RANGE_VIOLATION",)),
    "range_dispositions": (checks.ranges, ("CONCEPT_RANGE_CONFLICT", "VERSION_RANGE_CONFLICT", "RANGE_DOCS_CONFLICT")),
    "framework_mismatch": (checks.frameworks, ("ISPARTOF_FRAMEWORK_MISMATCH",)),
    "inverse": (checks.inverses, ("INVERSE_ONE_DIRECTION", "INVERSE_MISMATCH")),
}


def _session(spark: SparkSession, sf_dir: str, beside: bool = False) -> checks.Session:
    return checks.session(projection.corpus(spark, sf_dir), mini(), projection.supplied(spark, sf_dir) if beside else None)


def _family(name: str) -> Query:
    check, codes = FAMILIES[name]
    return lambda spark, sf_dir: check(_session(spark, sf_dir)).where(F.col("code").isin(*codes)).select(*COLUMNS).distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.validate(_session(spark, sf_dir)).select(*COLUMNS, "message", "rule")


def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.validated(_session(spark, sf_dir))


def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses and frameworks in documents of hundreds of nodes."""
    s = checks.session(projection.large(spark, sf_dir), mini())
    s.keep_references()  # both checks read them
    found = checks.inverses(s).unionAll(checks.frameworks(s))
    return found.select(*COLUMNS).distinct()


def ref_resolution_supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, beside=True)
    s.keep_references()
    found = checks.references(s).unionAll(checks.ranges(s))
    return found.where("code IN ('REF_OUTSIDE_PAYLOAD', 'REF_RESOLVED_SUPPLIED', 'RANGE_VIOLATION')").select(*COLUMNS).distinct()


def finalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.per_document(projection.corpus(spark, sf_dir), checks.severities(_session(spark, sf_dir)))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return findings.exit_codes(projection.corpus(spark, sf_dir), s.nodes, checks.every(s), "warning")


# A hierarchy out of the tables: parts under types, whose beginnings are levels, and under brands; who sells and buys under nations and regions, and customers also under customers.
_TYPE = "concat('type:', p_type)"
_LEVELS = ["substr(p_type, 1, 3)", "substr(p_type, 1, 1)"]
_EDGES = [
    ("part", "concat('part:', cast(p_partkey as varchar(20)))", _TYPE),
    ("part", "concat('part:', cast(p_partkey as varchar(20)))", "concat('brand:', p_brand)"),
    ("part", "concat('brand:', p_brand)", "concat('maker:', substr(p_brand, 1, length(p_brand) - 1))"),
    ("part", _TYPE, f"concat('type:', {_LEVELS[0]})"),
    ("part", f"concat('type:', {_LEVELS[0]})", f"concat('type:', {_LEVELS[1]})"),
    ("supplier", "concat('supplier:', cast(s_suppkey as varchar(20)))", "concat('nation:', cast(s_nationkey as varchar(20)))"),
    ("customer", "concat('customer:', cast(c_custkey as varchar(20)))", "concat('nation:', cast(c_nationkey as varchar(20)))"),
    ("customer", "concat('customer:', cast(c_custkey as varchar(20)))", "concat('customer:', cast(cast(floor(c_custkey / 8) as bigint) as varchar(20)))"),
    ("nation", "concat('nation:', cast(n_nationkey as varchar(20)))", "concat('region:', cast(n_regionkey as varchar(20)))"),
]
_EDGES_SQL = " UNION ALL ".join(f"SELECT {term} AS term, {parent} AS parent FROM {table}" for table, term, parent in _EDGES)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part, type, brand, supplier, customer and nation with all that it comes under."""
    for table in {t for t, *_ in _EDGES}:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return ancestors(spark.sql(_EDGES_SQL))


_CLOSURE_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_EDGES_SQL}) WHERE term IS NOT NULL AND parent IS NOT NULL),
r(term, ancestor) AS (SELECT DISTINCT term, term FROM e UNION SELECT r.term, e.parent FROM r JOIN e ON e.term = r.ancestor) SELECT term, ancestor FROM r"""

_IRIS = "CASE k % 5 WHEN 0 THEN concat('https://purl.org/ctdl/terms/t', cast(k as varchar(20))) WHEN 1 THEN concat('https://schema.org/s', cast(k as varchar(20))) WHEN 2 THEN 'https://purl.org/ctdlasn/terms/' WHEN 3 THEN concat('https://example.org/', cast(k as varchar(20))) ELSE concat('ceterms:x', cast(k as varchar(20))) END"


def compact_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT DISTINCT iri FROM (SELECT {_IRIS} AS iri FROM (SELECT o_orderkey AS k FROM orders))").select("iri", I.compact_iri(F.col("iri"), PREFIXES).alias("term"))


_COMPACT_SQL = f"""SELECT DISTINCT iri, CASE WHEN starts_with(iri, 'https://purl.org/ctdl/terms/') THEN 'ceterms:' || substr(iri, 29)
  WHEN starts_with(iri, 'https://schema.org/') THEN 'schema:' || substr(iri, 20) ELSE iri END AS term FROM (SELECT {_IRIS} AS iri FROM (SELECT o_orderkey AS k FROM orders))"""

#: Probes of what may be shown: SQL of the text, and whether it is.
_UUID = projection.uuid("o", "k")
_PROBES = [
    (projection.ctid("o", "k"), True), (f"upper({_UUID})", True), (f"concat('CE-', {_UUID})", False), (f"concat('ce-', upper({_UUID}))", True),
    (f"concat('{projection.R}', {projection.ctid('o', 'k')}, '/x?y')", True), ("concat('http://www.credreg.net/ctdl/', k)", True), ("concat('https://credreg.net.example/', k)", False), ("concat('https://credentialengineregistry.org/a b', k)", False),
    ("concat('ceterms:owned_By-', k, '.x')", True), ("concat('ceterms2:x', k)", False), ("concat('ceterms:a/', k)", False), ("concat('$.@graph[', k, '].ceterms:ownedBy[0]')", True), ("'$'", True), ("concat('$', k)", False),
    ("concat('_:n_1.', k)", True), ("concat('_: ', k)", False), ("concat('@type=[schema:Foo-', k, ', é]')", True), ("'@type'", False), ("'-'", True), ("concat('a name ', k)", False),
]
_SHOWN = "CASE k % " + str(len(_PROBES)) + " " + " ".join(f"WHEN {i} THEN {text.replace(', k', ', cast(k as varchar(20))').replace('cast(cast(k as varchar(20)) as varchar(20))', 'cast(k as varchar(20))')}" for i, (text, _) in enumerate(_PROBES)) + " END"
_PROBED = f"SELECT k, {_SHOWN} AS v FROM (SELECT DISTINCT o_orderkey AS k FROM orders)"


def identifier_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _PROBED).select("k", I.identifier_only(F.col("v")).alias("shown"))


_ALLOW_SQL = f"SELECT k, CASE WHEN k % {len(_PROBES)} IN ({', '.join(str(i) for i, (_, ok) in enumerate(_PROBES) if not ok)}) THEN concat('<withheld: ', cast(length(v) as varchar(20)), ' characters>') ELSE v END AS shown FROM ({_PROBED})"

#: URLs and the names under which their pages are saved.
_URLS = [("https://a.b/x/y/", "a.b__x_y.html"), ("https://a.b", "a.b__index.html"), ("http://a.b:8080/?q=1", "a.b:8080__index.html"), ("https://u@a.b//x//y.htm;p#f", "u@a.b__x__y.htm.html"), ("https://a.b/" + "z" * 200, "a.b__" + "z" * 175)]


def saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.element_at(F.array(*(F.lit(u) for u, _ in _URLS)), (F.col("k") % len(_URLS) + 1).cast("int"))
    return _sql(spark, sf_dir, "SELECT DISTINCT o_orderkey AS k FROM orders").select("k", I.saved_name(urls).alias("name"))


def first_id_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nodes with one @id: references go to the first."""
    c = projection.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    kind = lambda odd: F.when(F.col("c_custkey") % 2 == odd, "ceterms:Place").otherwise("ceterms:Organization")
    raw = F.concat(F.lit('[{"@id": "_:a", "@type": "ceterms:Certification", "ceterms:ownedBy": "_:o"}, {"@id": "_:o", "@type": "'), kind(0), F.lit('"}, {"@id": "_:o", "@type": "'), kind(1), F.lit('"}]'))
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), raw.alias("raw"))
    return checks.domain_and_range(checks.session(docs, mini())).select(*COLUMNS).distinct()


def supplied_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that supply one @id: the first in order counts."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    raw = F.format_string('{"@id": "https://example.org/%d", "@type": "ceterms:Organization"}', F.col("c_custkey") % 100)
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), raw.alias("raw"), F.format_string("c%d.json", "c_custkey").alias("source"), F.col("c_custkey").alias("set_ord"))
    return checks.supplied_entities(docs, mini()).select("node_id", "source")


# Pages: one of ten kinds of markup is put before the html of each.
_CTDL = "https://credreg.net/ctdl/schema/context/json"
_LD = '<script type="application/ld+json">{}</script>'
_KINDS = [
    "",
    _LD.format('{"@context": "https://schema.org", "@type": "Course", "name": "Welding", "courseCode": "W1", "provider": {"@type": "Organization", "name": "College"}, "offers": {"@type": "Offer"}}'),
    '<div itemscope itemtype="https://schema.org/Organization" lang="en"><span itemprop="name">College</span><span itemprop="legalName"></span></div>',
    '<div vocab="https://schema.org/" typeof="EducationalOccupationalProgram" about="x"><span property="name">P</span></div>',
    '<script type="application/ld+json">{broken</script>',
    _LD.format(f'{{"@context": "{_CTDL}", "@id": "https://e.example/c", "@type": "ceterms:Certification", "ceterms:ctid": "not-a-ctid", "ceterms:ownedBy": "https://e.example/o"}}'),
    '<div itemscope itemtype="https://schema.org/Organization" itemref="z"><i itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><b itemprop="streetAddress" lang="en">S</b></i></div><div itemscope><i itemprop="nick">n</i></div>',
    '<div typeof="Bare"></div>',
    _LD.format('[{"@type": "Course"}]'),
    _LD.format('{"@context": "https://schema.org", "@type": "Course", "provider": "College", "name": {"@type": "Thing"}, "hasPart": {"@type": "CourseInstance"}, "about": "x", "startDate": "2020"}'),
]
_NOTES = {
    0: [("NO_STRUCTURED_DATA", None, "(page)")],
    1: [
        ("CLASS_NOT_MAPPED", "json-ld[0].schema:offers[0]", "schema:Offer"),
        ("LANGUAGE_UNDECLARED", "json-ld[0]", "ceterms:name"),
        ("PROPERTY_NOT_MAPPED", "json-ld[0]", "schema:courseCode"),
        ("PROPERTY_NOT_MAPPED", "json-ld[0]", "schema:offers"),
        ("LANGUAGE_UNDECLARED", "json-ld[0].schema:provider[0]", "ceterms:name"),
        ("CTID_ABSENT", "$.@graph", "ceterms:ctid"),
    ],
    2: [("EMPTY_VALUE", "microdata[0].schema:legalName[1]", "(value)"), ("CTID_ABSENT", "$.@graph", "ceterms:ctid")],
    3: [("RDFA_BEYOND_LITE", "rdfa", "about"), ("CLASS_NOT_MAPPED", "rdfa[0]", "schema:EducationalOccupationalProgram"), ("CLASS_RELATED_NOT_EQUIVALENT", "rdfa[0]", "schema:EducationalOccupationalProgram")],
    4: [("JSONLD_PARSE_ERROR", "json-ld[0]", "application/ld+json")],
    6: [("MICRODATA_ITEMREF", "microdata[0]", "z"), ("MICRODATA_NAME_UNRESOLVED", "microdata[1].itemprop[0]", "nick"), ("ITEM_UNTYPED", "microdata[1]", "(no type)"), ("CTID_ABSENT", "$.@graph", "ceterms:ctid")],
    7: [("RDFA_TERM_UNRESOLVED", "rdfa[0]", "Bare"), ("ITEM_UNTYPED", "rdfa[0]", "(no type)")],
    8: [("JSONLD_CONTEXT_UNRESOLVED", "json-ld[0]", "(absent)"), ("ITEM_UNTYPED", "json-ld[0][0]", "(no type)")],
    9: [
        ("CLASS_NOT_MAPPED", "json-ld[0].schema:name[0]", "schema:Thing"),
        ("CLASS_NOT_MAPPED", "json-ld[0].schema:hasPart[0]", "schema:CourseInstance"),
        ("VALUE_NOT_IDENTIFIER", "json-ld[0]", "ceterms:offeredBy"),
        ("VALUE_NOT_LITERAL", "json-ld[0]", "ceterms:name"),
        ("NESTED_ITEM_DROPPED", "json-ld[0]", "ceterms:hasPart"),
        ("PROPERTY_NOT_MAPPED", "json-ld[0]", "schema:about"),
        ("PROPERTY_RELATED_NOT_EQUIVALENT", "json-ld[0]", "schema:about"),
        ("PROPERTY_RELATED_NOT_EQUIVALENT", "json-ld[0]", "schema:about"),
        ("PROPERTY_AMBIGUOUS", "json-ld[0]", "schema:startDate"),
        ("CTID_ABSENT", "$.@graph", "ceterms:ctid"),
    ],
}
_BLOCKS = {1: ("json-ld", 3, "schema:Course,schema:Organization,schema:Offer"), 2: ("microdata", 1, "schema:Organization"), 3: ("rdfa", 1, "schema:EducationalOccupationalProgram"), 4: ("json-ld", 0, ""), 5: ("json-ld", 1, "ceterms:Certification"), 6: ("microdata", 3, "schema:Organization,schema:PostalAddress"), 7: ("rdfa", 1, ""), 8: ("json-ld", 1, ""), 9: ("json-ld", 3, "schema:Course,schema:Thing,schema:CourseInstance")}
_ENTITIES = {1: [("_:n0", "ceterms:Course"), ("_:n1", "ceterms:Organization")], 2: [("_:n0", "ceterms:Organization")], 5: [("https://e.example/c", "ceterms:Certification")], 6: [("_:n0", "ceterms:Organization"), ("_:n1", "ceterms:PostalAddress")], 9: [("_:n0", "ceterms:Course")]}
_VALUES = {
    1: [("json-ld[0]", "ceterms:name", "Welding", None), ("json-ld[0]", "ceterms:offeredBy", "_:n1", None), ("json-ld[0].schema:provider[0]", "ceterms:name", "College", None)],
    2: [("microdata[0]", "ceterms:name", "College", "en")],
    5: [("json-ld[0]", "ceterms:ctid", "not-a-ctid", None), ("json-ld[0]", "ceterms:ownedBy", "https://e.example/o", None)],
    6: [("microdata[0]", "ceterms:address", "_:n1", None), ("microdata[0].schema:address[0]", "ceterms:streetAddress", "S", "en")],
}
_FOUND = {
    5: [("CTID_MALFORMED", "ERROR", "https://e.example/c", "ceterms:ctid", "not-a-ctid"), ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "https://e.example/c", "ceterms:ownedBy", "https://e.example/o")],
    6: [("RANGE_VIOLATION", "ERROR", "_:n0", "ceterms:address", "_:n1")],
}


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("page_id", F.lit(len(_KINDS))) + 1).cast("int"))
    p, cores = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), spark.sparkContext.defaultParallelism
    if p.rdd.getNumPartitions() < cores:  # one small file
        p = p.repartition(cores, "page_id")
    return p.select("page_id", "url", F.concat(kind, "html").alias("html"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(markup.read_pages(_marked_up(spark, sf_dir), mini()))


def markup_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = markup.read(_marked_up(spark, sf_dir), mini()).blocks
    return b.select("page_id", "fmt", F.col("items").cast("long").alias("items"), F.array_join("types", ",").alias("types"))


def class_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mapping.extract(_pages(spark, sf_dir), mini())
    return x.entities.select("page_id", "id", F.array_join("classes", ",").alias("classes"))


def property_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.extract(_pages(spark, sf_dir), mini()).values.select("page_id", "path", "prop", "value", "language")


def extract_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.extract(_pages(spark, sf_dir), mini()).notes.select("page_id", "code", "subject", "term")


def _checked(x: mapping.Extraction) -> DataFrame:
    return checks.validate(checks.session(mapping.documents(x).withColumnRenamed("page_id", "doc_id"), mini()))


def extract_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of pages, checked in turn."""
    return _checked(mapping.extract(_pages(spark, sf_dir), mini())).select(*COLUMNS)


def markup_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all pages: what they publish, what came of it and what the checks say."""
    pages = _pages(spark, sf_dir)
    x = mapping.extract(pages, mini())
    return survey.markup_summary(pages, x.entities, x.notes, kept(_checked(x)))


def _markup_survey_sql() -> str:
    n = f"(SELECT page_id % {len(_KINDS)} AS kind, count(*) AS n FROM pages GROUP BY 1)"
    rows = [("format", f, k) for k, (f, _, _) in _BLOCKS.items()] + [("type", t, k) for k, (_, _, ts) in _BLOCKS.items() for t in ts.split(",") if t]
    rows += [("note", c, k) for k, xs in _NOTES.items() for c, *_ in xs] + [("finding", c, k) for k, xs in _FOUND.items() for c, *_ in xs]
    wrong = {k for k, xs in _FOUND.items() if any(s == "ERROR" for _, s, *_ in xs)}
    for k in range(len(_KINDS)):
        rows += [("pages", m, k) for m, holds in (("targets", True), ("read", True), ("published_structured_data", k in _BLOCKS), ("produced_ctdl_entities", k in _ENTITIES), ("extracts_with_no_validation_errors", k in _ENTITIES and k not in wrong)) if holds]
    values = ", ".join(f"('{m}', '{key}', {k})" for m, key, k in rows)
    return f"SELECT measure, key, sum(n)::BIGINT AS n FROM (VALUES {values}) v(measure, key, kind) JOIN {n} USING (kind) GROUP BY ALL UNION ALL SELECT 'pages', 'not_read', 0"


def _values_sql(rows: list[tuple], columns: str, extra: str = "") -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    names = ["kind", *columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT cast(page_id as varchar) AS page_id, {extra or columns} FROM pages JOIN (VALUES {values}) v({', '.join(names)}) ON page_id % {len(_KINDS)} = v.kind"


_SURVEY = "(SELECT DISTINCT o_orderkey AS k, o_custkey AS publisher, o_orderpriority AS type FROM orders)"
# Counts of codes in two passes: code, severity, how many in each pass, when.
_CODES = [("DOMAIN_VIOLATION", "ERROR", "alone", "k % 3 + 1", "k % 7 = 0"), ("DOMAIN_VIOLATION", "ERROR", "resolved", "k % 3 + 1", "k % 7 = 0"), ("CTID_NOT_UUIDV4", "WARNING", "alone", "1", "k % 6 = 1"), ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "alone", "k % 5 + 1", "k % 4 <> 0"), ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "resolved", "1", "k % 8 = 1"), ("REF_RESOLVED_SUPPLIED", "INFO", "resolved", "k % 5 + 1", "k % 4 <> 0 AND k % 8 <> 1")]
_CODES_SQL = " UNION ALL ".join(f"SELECT k AS doc_id, '{p}' AS pass, '{c}' AS code, '{s}' AS severity, cast({n} as bigint) AS n FROM {_SURVEY} WHERE {w}" for c, s, p, n, w in _CODES)
_DOCS_SQL = " UNION ALL ".join(f"SELECT k AS doc_id, type, '{p}' AS pass FROM {_SURVEY}" for p in ("alone", "resolved"))


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(text)


def rollup_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.roll_up(_sql(spark, sf_dir, _DOCS_SQL), _sql(spark, sf_dir, _CODES_SQL))


_ROLLUP_SQL = f"""WITH docs AS ({_DOCS_SQL}), codes AS ({_CODES_SQL}), both_ AS (SELECT type, doc_id, pass FROM docs UNION ALL SELECT '*', doc_id, pass FROM docs),
d AS (SELECT b.type, b.pass, b.doc_id, coalesce(sum(c.n), 0) AS n, coalesce(bool_or(c.severity = 'ERROR'), false) AS err FROM both_ b LEFT JOIN codes c USING (doc_id, pass) GROUP BY ALL)
SELECT type, pass, 'documents' AS measure, count(*)::BIGINT AS n FROM d GROUP BY ALL UNION ALL SELECT type, pass, 'clean', count(*) FILTER (n = 0) FROM d GROUP BY ALL
UNION ALL SELECT type, pass, 'with_error', count(*) FILTER (err) FROM d GROUP BY ALL
UNION ALL SELECT type, pass, 'severity:' || severity, sum(n)::BIGINT FROM both_ JOIN codes USING (doc_id, pass) GROUP BY ALL
UNION ALL SELECT type, pass, 'code:' || code, sum(n)::BIGINT FROM both_ JOIN codes USING (doc_id, pass) GROUP BY ALL"""


def type_table_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, f"SELECT CASE WHEN k % 1000 < 10 THEN concat('rare', cast(k % 1000 as varchar(20))) ELSE type END AS type FROM {_SURVEY}")
    return survey.type_table(rows, 1000)


def publisher_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.concentration(_sql(spark, sf_dir, _PUBLISHERS))


_PUBLISHERS = f"SELECT CASE WHEN k % 9 = 0 THEN NULL ELSE publisher END AS publisher FROM {_SURVEY}"


def publisher_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.publisher_labels(_sql(spark, sf_dir, f"SELECT k AS page, publisher FROM {_SURVEY}"))


def two_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _sql(spark, sf_dir, _CODES_SQL)
    of = lambda p: runs.where(F.col("pass") == p).select("doc_id", F.lit("x").alias("pass"), "code", "n")
    return survey.compare_runs(of("alone"), of("resolved")).select("doc_id", "code", "n_before", "n_after")


# A second run: some findings of one code have become another's; in a few documents something else changed too.
_LATER = [("RANGE_VIOLATION", "k % 3 + 1", "k % 5 = 0 AND k % 2 = 1"), ("CONCEPT_RANGE_CONFLICT", "k % 3 + 1", "k % 5 = 0 AND k % 2 = 0"), ("CTID_MALFORMED", "CASE WHEN k % 31 = 0 THEN 2 ELSE 1 END", "k % 4 = 0"), ("REF_NOT_IRI", "1", "k % 29 = 0")]
_EARLIER = [("RANGE_VIOLATION", "k % 3 + 1", "k % 5 = 0"), ("CTID_MALFORMED", "1", "k % 4 = 0")]
_RUNS_SQL = [" UNION ALL ".join(f"SELECT k AS doc_id, '{p}' AS pass, '{c}' AS code, cast({n} as bigint) AS n FROM {_SURVEY} WHERE {w}" for c, n, w in run for p in ("alone", "resolved")) for run in (_EARLIER, _LATER)]


def two_run_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.reclassified(_sql(spark, sf_dir, _RUNS_SQL[0]), _sql(spark, sf_dir, _RUNS_SQL[1]), "RANGE_VIOLATION", "CONCEPT_RANGE_CONFLICT")


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an ERROR code, its count and the first example."""
    found = checks.ctid_format(_session(spark, sf_dir)).drop("rule").distinct()  # a code of this check has one rule
    rows = survey.error_table(survey.summarize(found).withColumn("pass", F.lit("alone")))
    return rows.select("doc_id", "pass", "code", "n", F.col("example.entity").alias("entity"), F.col("example.property").alias("property"), F.col("example.value").alias("value"))


def code_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.share_report(_sql(spark, sf_dir, _CODES_SQL), _sql(spark, sf_dir, _DOCS_SQL))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.settled(_sql(spark, sf_dir, _CODES_SQL))


def only_unverifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.only_unverifiable(_sql(spark, sf_dir, _CODES_SQL))


_ENVELOPES = f"SELECT k AS page, CASE WHEN k % 22 = 0 THEN 'empty-page' WHEN k % 11 = 0 THEN 'timed out' END AS failure, k % 13 <> 0 AS is_resource, CASE WHEN k % 17 = 0 THEN NULL ELSE publisher END AS ctid, k % 19 <> 0 AS has_resource, k % 23 <> 0 AS readable FROM {_SURVEY}"


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.exclusions(_sql(spark, sf_dir, _ENVELOPES)).select("page", "reason")


_EXCLUSIONS_SQL = f"""WITH e AS ({_ENVELOPES}), p AS (SELECT *, failure IS NULL AND is_resource AND ctid IS NOT NULL AND has_resource AS ok FROM e), f AS (SELECT ctid, min(page) AS first_page FROM p WHERE ok GROUP BY 1)
SELECT page, CASE WHEN failure = 'empty-page' THEN failure WHEN failure IS NOT NULL THEN 'fetch-failed' WHEN NOT is_resource THEN 'not-resource-data' WHEN ctid IS NULL OR NOT has_resource THEN 'no-document' WHEN page > first_page THEN 'duplicate-ctid' WHEN NOT readable THEN 'unreadable' END AS reason FROM p LEFT JOIN f USING (ctid)"""

#: References that stay open: SQL of the value, and its kind.
_REST = [
    (f"concat('{projection.R}', {projection.ctid('o', 'k')})", 0), (f"concat('https://credentialengineregistry.org/graph/', {projection.ctid('o', 'k')})", 2), (f"concat('http://credentialengineregistry.org/resources/', {projection.ctid('o', 'k')})", 2), ("'https://credentialengineregistry.org:80/resources/x'", 3),
    ("'https://credreg.net/ctdl/terms/x'", 1), ("'http://www.CREDREG.net?x'", 1), ("'ceterms:x'", 3), ("'_:b'", 3), ("'https://credentialengineregistry.org.example/resources/x'", 3),
]
_OPEN = f"SELECT k AS doc_id, CASE WHEN k % 7 = 0 THEN 'REF_NOT_IRI' ELSE 'REF_OUTSIDE_PAYLOAD' END AS code, k % {len(_REST)} AS kind_no, CASE k % {len(_REST)} {' '.join(f'WHEN {i} THEN {v}' for i, (v, _) in enumerate(_REST))} END AS value FROM {_SURVEY}"
_RESIDUE_SQL = f"SELECT CASE kind_no {' '.join(f'WHEN {i} THEN {chr(39)}{survey.RESIDUE[k]}{chr(39)}' for i, (_, k) in enumerate(_REST))} END AS kind, count(*) AS n FROM ({_OPEN}) WHERE code = 'REF_OUTSIDE_PAYLOAD' GROUP BY 1"


def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.residue(_sql(spark, sf_dir, _OPEN))


def registry_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.registry_references(_sql(spark, sf_dir, _OPEN)).select("doc_id", F.array_join("iris", ",").alias("iris"))


_ANNOTATED = f"SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN '' ELSE 'a,b:c%.json' END AS file, 'CTID_MALFORMED' AS code, CASE k % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'UNVERIFIABLE' END AS severity, '_:a' AS entity, 'ceterms:ctid' AS property, concat('50%', chr(10), cast(k as varchar(20))) AS value, 'No: it is not' AS message FROM {_SURVEY}"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.as_annotations(_sql(spark, sf_dir, _ANNOTATED), "file")


_ANNOTATIONS_SQL = f"SELECT doc_id, concat('::', CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'notice' END, ' ', CASE WHEN file = '' THEN '' ELSE 'file=a%2Cb%3Ac%25.json,' END, 'title=CTID_MALFORMED (', severity, ')::_:a: ceterms:ctid = 50%25%0A', doc_id, '. No: it is not') AS line FROM ({_ANNOTATED})"


# Findings of every publisher, to be rendered.
_FOUND_BY = f"SELECT cast(publisher as varchar(20)) AS doc_id, CASE k % 3 WHEN 0 THEN 'CTID_MALFORMED' WHEN 1 THEN 'REF_NOT_IRI' ELSE 'UNKNOWN_CLASS' END AS code, CASE k % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'UNVERIFIABLE' END AS severity, concat('_:é', cast(k % 100 as varchar(20))) AS entity, 'ceterms:ctid' AS property, concat('v ', cast(k as varchar(20))) AS value, 'No: it is not' AS message FROM {_SURVEY}"
_RULE = ("A rule", "https://r.example/", "2026-08-06")
#: Characters of a chunk in these queries: small, so that a publisher's findings are several.
_CHUNK = 2000


def _to_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _FOUND_BY).withColumn("rule", F.struct(*(F.lit(x).alias(n) for x, n in zip(_RULE, ("citation", "url", "retrieved")))))


def _together(chunks: DataFrame) -> DataFrame:
    """Chunks put together, as these documents are short."""
    all_ = F.sort_array(F.collect_list(F.struct("part", "chunk", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(all_, lambda x: x["text"]), "").alias("text"))


def rendered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(findings.text_chunks(_to_render(spark, sf_dir), _CHUNK))


def rendered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(findings.json_chunks(_to_render(spark, sf_dir), "lodestar", "0.1", _CHUNK))


_IN_ORDER = "ORDER BY entity, property, code, value, severity, message"
_TEXTS_SQL = f"""SELECT doc_id, string_agg(concat(rpad(severity, 12, ' '), ' ', code, '  entity=', entity, '
    ', property, ' = ', value, '
    ', message, '
    rule: {_RULE[0]}
    source: {_RULE[1]} (retrieved {_RULE[2]})

'), '' {_IN_ORDER}) || concat(count(*), ' finding(s): ', {", ', ', ".join(f"count(*) FILTER (severity = '{x}'), ' {x}'" for x in findings.SEVERITIES)}) AS text FROM ({_FOUND_BY}) GROUP BY 1"""
_JSON_SQL = f"""SELECT doc_id, concat('{{
  "findings": [
', string_agg(concat('    {{
      "code": "', code, '",
      "entity": "', entity, '",
      "message": "', message, '",
      "property": "', property, '",
      "rule": {{
        "citation": "{_RULE[0]}",
        "retrieved": "{_RULE[2]}",
        "url": "{_RULE[1]}"
      }},
      "severity": "', severity, '",
      "value": "', value, '"
    }}'), ',
' {_IN_ORDER}), '
  ],
  "summary": {{
', {", ',' || chr(10), ".join(f"""'    "{x}": ', count(*) FILTER (severity = '{x}')""" for x in sorted(findings.SEVERITIES))}, '
  }},
  "tool": {{
    "name": "lodestar",
    "version": "0.1"
  }}
}}') AS text FROM ({_FOUND_BY}) GROUP BY 1"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _sql(spark, sf_dir, f"SELECT publisher AS iri FROM {_SURVEY}")
    return survey.neighbours(refs, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END").alias("iri"), (F.col("c_custkey") % 5 != 0).alias("ok")))


_OWN: tuple[Query, ...] = (validate_all, large_documents, ref_resolution_supplied, finalize_counts, gate, closure, compact_iri, identifier_allow_list, saved_names, first_id_wins, supplied_first_wins, markup_inventory, class_mapping, property_mapping, extract_notes, extract_and_validate, markup_survey, rollup_by_type, type_table_pooled, publisher_concentration, publisher_labels, two_run_diff, two_run_moves, error_table, code_shares, settled, only_unverifiable, exclusions, residue, registry_references, annotations, rendered_texts, rendered_json, neighbours)


_ERRORS_SQL = f"""WITH e AS ({projection.expected("CTID_BARE_UUID", "CTID_MALFORMED", "CTID_URI_MISMATCH", "REGISTRY_URI_MALFORMED")}),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, code) AS n, row_number() OVER (PARTITION BY doc_id, code ORDER BY entity, property, value) AS i FROM e)
SELECT doc_id, 'alone' AS pass, code, n, entity, property, CASE WHEN code = 'CTID_MALFORMED' OR starts_with(value, 'CE-') THEN concat('<withheld: ', length(value), ' characters>') ELSE value END AS value FROM f WHERE i = 1"""


def queries() -> dict[str, Query]:
    return {name: _family(name) for name in FAMILIES} | {f.__name__: f for f in _OWN}


def oracle_sql() -> dict[str, str]:
    every = projection.expected()
    sev = ", ".join(f"count(*) FILTER (severity = '{s}')::BIGINT AS \"{s}\"" for s in findings.SEVERITIES)
    out = {name: projection.expected(*codes) for name, (_, codes) in FAMILIES.items()}
    notes = [(k, c, s, t) for k, rows in _NOTES.items() for c, s, t in rows]
    return out | {
        "validate_all": every,
        "large_documents": projection.LARGE_EXPECTED,
        "ref_resolution_supplied": projection.expected("REF_OUTSIDE_PAYLOAD", "REF_RESOLVED_SUPPLIED", "RANGE_VIOLATION", beside=True),
        "finalize_counts": f"SELECT doc_id, {sev}, count(code)::BIGINT AS n_findings FROM (SELECT DISTINCT cast(o_orderkey as varchar) AS doc_id FROM orders) LEFT JOIN ({every}) USING (doc_id) GROUP BY 1",
        "gate": f"SELECT doc_id, max(CASE WHEN severity IN ('ERROR', 'WARNING') THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM (SELECT DISTINCT cast(o_orderkey as varchar) AS doc_id FROM orders) LEFT JOIN ({every}) USING (doc_id) GROUP BY 1",
        "closure": _CLOSURE_SQL,
        "compact_iri": _COMPACT_SQL,
        "identifier_allow_list": _ALLOW_SQL,
        "first_id_wins": "SELECT cast(c_custkey as varchar) AS doc_id, 'RANGE_VIOLATION' AS code, 'ERROR' AS severity, '_:a' AS entity, 'ceterms:ownedBy' AS property, '_:o' AS value FROM customer WHERE c_custkey % 2 = 0",
        "supplied_first_wins": "SELECT concat('https://example.org/', c_custkey % 100) AS node_id, concat('c', min(c_custkey), '.json') AS source FROM customer GROUP BY c_custkey % 100",
        "markup_inventory": _values_sql([(k, *b) for k, b in _BLOCKS.items()], "fmt, items, types", "fmt, items::BIGINT AS items, types"),
        "class_mapping": _values_sql([(k, i, c) for k, rows in _ENTITIES.items() for i, c in rows], "id, classes"),
        "property_mapping": _values_sql([(k, *r) for k, rows in _VALUES.items() for r in rows], "path, prop, value, language"),
        "extract_notes": _values_sql(notes, "code, subject, term", "code, coalesce(subject, url) AS subject, term"),
        "extract_and_validate": f"SELECT page_id AS doc_id, * EXCLUDE (page_id) FROM ({_values_sql([(k, *x) for k, xs in _FOUND.items() for x in xs], 'code, severity, entity, property, value')})",
        "markup_survey": _markup_survey_sql(),
        "saved_names": f"SELECT k, CASE k % {len(_URLS)} {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, (_, n) in enumerate(_URLS))} END AS name FROM (SELECT DISTINCT o_orderkey AS k FROM orders)",
        "registry_references": f"SELECT doc_id, value AS iris FROM ({_OPEN}) WHERE kind_no = 0 AND code = 'REF_OUTSIDE_PAYLOAD'",
        "annotations": _ANNOTATIONS_SQL,
        "rendered_texts": _TEXTS_SQL,
        "rendered_json": _JSON_SQL,
        "rollup_by_type": _ROLLUP_SQL,
        "type_table_pooled": f"WITH t AS (SELECT CASE WHEN k % 1000 < 10 THEN concat('rare', k % 1000) ELSE type END AS type FROM {_SURVEY}), n AS (SELECT type, count(*) AS c FROM t GROUP BY 1) SELECT CASE WHEN c >= 1000 THEN type ELSE 'all other types' END AS type, sum(c)::BIGINT AS documents FROM n GROUP BY 1",
        "publisher_concentration": f"WITH n AS (SELECT publisher, count(*) AS c FROM ({_PUBLISHERS}) GROUP BY 1), t AS (SELECT count(*) AS keys, sum(c)::BIGINT AS documents FROM n), f AS (SELECT c FROM n ORDER BY c DESC, publisher LIMIT 5) SELECT keys, documents, round_even(100.0 * (SELECT max(c) FROM f) / documents, 0)::BIGINT AS top1_share, round_even(100.0 * (SELECT sum(c) FROM f) / documents, 0)::BIGINT AS top5_share FROM t",
        "publisher_labels": f"SELECT publisher, printf('P%03d', row_number() OVER (ORDER BY min(k), publisher)) AS label FROM {_SURVEY} GROUP BY 1",
        "two_run_diff": f"SELECT doc_id, code, sum(CASE WHEN pass = 'alone' THEN n ELSE 0 END)::BIGINT AS n_before, sum(CASE WHEN pass = 'resolved' THEN n ELSE 0 END)::BIGINT AS n_after FROM ({_CODES_SQL}) GROUP BY doc_id, code HAVING sum(CASE WHEN pass = 'alone' THEN n ELSE -n END) <> 0",
        "two_run_moves": f"WITH c AS (SELECT doc_id, pass, code, sum(b)::BIGINT AS b, sum(a)::BIGINT AS a FROM (SELECT doc_id, pass, code, n AS b, 0 AS a FROM ({_RUNS_SQL[0]}) UNION ALL SELECT doc_id, pass, code, 0, n FROM ({_RUNS_SQL[1]})) GROUP BY ALL), d AS (SELECT doc_id, pass, sum(CASE WHEN code = 'RANGE_VIOLATION' THEN b - a ELSE 0 END)::BIGINT AS n_moved, sum(CASE WHEN code = 'CONCEPT_RANGE_CONFLICT' THEN a - b ELSE 0 END)::BIGINT AS came, count(*) FILTER (code NOT IN ('RANGE_VIOLATION', 'CONCEPT_RANGE_CONFLICT') AND a <> b) AS others FROM c GROUP BY ALL) SELECT doc_id, pass, n_moved, n_moved = came AND others = 0 AS explained FROM d WHERE n_moved <> 0 OR came <> 0 OR others > 0",
        "error_table": _ERRORS_SQL,
        "code_shares": f"WITH t AS (SELECT pass, count(DISTINCT doc_id) AS total FROM ({_DOCS_SQL}) GROUP BY 1), c AS (SELECT doc_id, pass, severity, code FROM ({_CODES_SQL}) UNION SELECT doc_id, pass, severity, '*' FROM ({_CODES_SQL})), n AS (SELECT pass, severity, code, count(*) AS documents FROM c GROUP BY ALL) SELECT code, severity, pass, documents, round_even(100.0 * documents / total, 0)::BIGINT AS share FROM n JOIN t USING (pass)",
        "settled": f"SELECT doc_id, sum(CASE WHEN severity <> 'UNVERIFIABLE' THEN 0 WHEN pass = 'alone' THEN n ELSE -n END)::BIGINT AS settled FROM ({_CODES_SQL}) GROUP BY 1 HAVING settled <> 0",
        "only_unverifiable": f"WITH d AS (SELECT doc_id, pass, bool_or(severity = 'ERROR') AS e, bool_or(severity = 'WARNING') AS w, bool_or(severity = 'INFO') AS i FROM ({_CODES_SQL}) GROUP BY ALL) SELECT pass, count(*) FILTER (NOT w AND NOT i) AS only_unverifiable, count(*) FILTER (w) AS with_warning, count(*) FILTER (i) AS with_info FROM d WHERE NOT e GROUP BY 1",
        "exclusions": _EXCLUSIONS_SQL,
        "residue": _RESIDUE_SQL,
        "neighbours": f"WITH r AS (SELECT DISTINCT publisher AS iri FROM {_SURVEY}), c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS iri, c_custkey % 5 <> 0 AS ok FROM customer) SELECT count(*) AS referenced, count(*) FILTER (ok) AS fetched, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unresolved FROM r LEFT JOIN c USING (iri)",
    }
