"""A corpus of JSON-LD documents made of the provided tables, and what must be found in it.

``FIELDS`` is SQL that Spark and DuckDB both read.  Spark writes documents from
the fields and runs the engine over them; the expected findings are written
from the fields alone, so they do not depend on the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

R = "https://credentialengineregistry.org/resources/"


def uuid(tag: str, key: str) -> str:
    h = f"md5(concat('{tag}', cast({key} as varchar(20))))"
    return f"concat(substr({h},1,8),'-',substr({h},9,4),'-4',substr({h},14,3),'-8',substr({h},18,3),'-',substr({h},21,12))"


def ctid(tag: str, key: str) -> str:
    return f"concat('ce-', {uuid(tag, key)})"


FIELDS = f"""
SELECT k, cast(k as varchar(20)) AS doc_id, c,
  CASE WHEN k % 7 = 0 THEN concat('{R}', {uuid('o', 'k')}) ELSE concat('{R}', {ctid('o', 'k')}) END AS id_a,
  {ctid('o', 'k')} AS tail_a,
  CASE k % 10 WHEN 1 THEN {uuid('o', 'k')} WHEN 2 THEN upper({ctid('o', 'k')}) WHEN 3 THEN 'not-a-ctid'
    WHEN 4 THEN concat('ce-', substr({uuid('o', 'k')}, 1, 14), '1', substr({uuid('o', 'k')}, 16, 21)) WHEN 5 THEN '12345' WHEN 6 THEN {ctid('x', 'k')} ELSE {ctid('o', 'k')} END AS ctid_a,
  concat('{R}', {ctid('g', 'k')}) AS id_org,
  CASE c % 6 WHEN 0 THEN concat('{R}', {ctid('g', 'k')}) WHEN 1 THEN '_:missing' WHEN 2 THEN {uuid('c', 'c')} WHEN 3 THEN {ctid('c', 'c')} WHEN 4 THEN concat('{R}', {ctid('c', 'c')}) ELSE 'Acme' END AS owner,
  CASE WHEN k % 3 = 0 THEN 'ceterms:Place' ELSE 'ceterms:CredentialOrganization' END AS type_org,
  concat('{R}', {ctid('d', 'k')}) AS id_course,
  concat('{R}', {ctid('f', 'k')}) AS id_fw, concat('{R}', {ctid('m', 'k')}) AS id_comp,
  concat('{R}', {ctid('z', 'k')}) AS id_other,
  concat('{R}', {ctid('t', 'k')}) AS id_t1, concat('{R}', {ctid('u', 'k')}) AS id_t2
FROM (SELECT DISTINCT o_orderkey AS k, o_custkey AS c FROM orders)"""


#: Rows that one task makes documents of.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table that may be one small file, dealt out before its rows become documents: over all cores, and in parts of TASK_ROWS."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), key)


def _hashed_once(fields: str) -> str:
    """FIELDS with each hash as a column of the inner table: written out, an identifier asks for its hash five times, and is itself asked for several times."""
    inner = fields[fields.index("(SELECT DISTINCT") :]
    outer, names = fields[: -len(inner)], {}
    for h in re.findall(r"md5\(concat\('\w+', cast\(\w+ as varchar\(20\)\)\)\)", outer):
        names.setdefault(h, f"_h{len(names)}")
    for h, name in names.items():
        outer = outer.replace(h, name)
    return f"{outer}(SELECT k, c, {', '.join(f'{h} AS {name}' for h, name in names.items())} FROM {inner})"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw of one document for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    dealt(orders, "o_orderkey").createOrReplaceTempView("orders")
    f = spark.sql(_hashed_once(FIELDS))
    q = lambda c: F.concat(F.lit('"'), F.col(c) if isinstance(c, str) else c, F.lit('"'))
    lit, when = F.lit, F.when
    k, c = F.col("k"), F.col("c")
    none = F.lit(None).cast("string")

    def node(id_: str, type_, *props) -> F.Column:
        t = lit(f'"{type_}"') if isinstance(type_, str) else type_
        return F.concat(lit("{"), F.concat_ws(", ", F.concat(lit('"@id": '), q(id_)), F.concat(lit('"@type": '), t), *props), lit("}"))

    def prop(name: str, value, cond=None):
        text = F.concat(lit(f'"{name}": '), value)
        return text if cond is None else when(cond, text)

    part_of = when(k % 4 == 0, q("id_a")).when(k % 4 == 2, q("id_course"))
    in_fw = when(k % 3 == 0, q("id_fw")).when(k % 3 == 1, q("id_other")).otherwise(q("id_comp"))
    nodes = [
        node(
            "id_a",
            when(k % 11 == 0, lit('["ceterms:Certification", "ceterms:NotAClass"]')).otherwise(lit('"ceterms:Certification"')),
            prop("ceterms:ctid", when(k % 10 == 5, lit("12345")).otherwise(q("ctid_a"))),
            prop("https://purl.org/ctdl/terms/ownedBy", q("owner")),
            prop("ceterms:hasPart", F.concat(lit("["), q("id_course"), lit(', {"@id": '), q("id_course"), lit("}]"))),
            prop("ceterms:notAProperty", lit('"x"'), k % 11 == 0),
            prop("ceterms:creditUnitType", lit('{"@type": "ceterms:CredentialAlignmentObject"}'), k % 17 == 0),
        ),
        when(c % 6 == 0, node("id_org", F.concat(lit('"'), "type_org", lit('"')), prop("ceterms:hasPart", lit("[]"), k % 13 == 0))),
        when(k % 4 != 3, node("id_course", "ceterms:Course", prop("ceterms:isPartOf", part_of))),
        when(k % 5 == 0, node("id_fw", "ceasn:CompetencyFramework")),
        when(k % 5 == 0, node("id_comp", "ceasn:Competency", prop("ceasn:isPartOf", in_fw), prop("ceasn:isChildOf", q("id_fw"), k % 2 == 0))),
        when(k % 19 == 0, node("id_t1", "ceterms:TransferValueProfile", prop("ceterms:previousVersion", q("id_t2")))),
        when(k % 19 == 0, node("id_t2", "ceterms:TransferValueProfile")),
    ]
    return f.select("doc_id", F.concat(lit('{"@graph": ['), F.concat_ws(", ", *(F.coalesce(n, none) for n in nodes)), lit("]}")).alias("raw"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw, source, set_ord: a document for every customer; those of every second one declare an id that no order names."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    f = spark.sql(f"SELECT c_custkey AS c, concat('{R}', CASE WHEN c_custkey % 2 = 0 THEN {ctid('c', 'c_custkey')} ELSE {ctid('y', 'c_custkey')} END) AS id FROM customer")
    kind = F.when(F.col("c") % 3 == 0, "ceterms:Place").otherwise("ceterms:Organization")
    raw = F.concat(F.lit('{"@id": "'), "id", F.lit('", "@type": "'), kind, F.lit('"}'))
    return f.select(F.concat(F.lit("s"), F.col("c").cast("string")).alias("doc_id"), raw.alias("raw"), F.format_string("customer-%d.json", "c").alias("source"), F.col("c").alias("set_ord"))


#: code: list of (severity, rows of entity, property, value), from the table d of FIELDS
_EXPECTED: list[tuple[str, str, str, str, str, str]] = [
    ("CTID_BARE_UUID", "ERROR", "id_a", "'ceterms:ctid'", "ctid_a", "k % 10 = 1"),
    ("CTID_UPPERCASE", "WARNING", "id_a", "'ceterms:ctid'", "ctid_a", "k % 10 = 2"),
    ("CTID_MALFORMED", "ERROR", "id_a", "'ceterms:ctid'", "ctid_a", "k % 10 IN (3, 5)"),
    ("CTID_NOT_UUIDV4", "WARNING", "id_a", "'ceterms:ctid'", "ctid_a", "k % 10 = 4"),
    ("CTID_URI_MISMATCH", "ERROR", "id_a", "'ceterms:ctid'", "ctid_a", "k % 7 <> 0 AND k % 10 IN (2, 4, 6)"),
    ("REGISTRY_URI_MALFORMED", "ERROR", "id_a", "'@id'", "id_a", "k % 7 = 0"),
    ("REGISTRY_URI_MALFORMED", "ERROR", "id_course", "'ceterms:isPartOf'", "id_a", "k % 7 = 0 AND k % 4 = 0"),
    ("REF_BARE_UUID", "ERROR", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 2"),
    ("REF_BARE_CTID", "WARNING", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 3"),
    ("REF_NOT_IRI", "WARNING", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 5"),
    ("REF_UNRESOLVED_BNODE", "ERROR", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 1"),
    ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 4"),
    ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "id_a", "'ceterms:hasPart'", "id_course", "k % 4 = 3"),
    ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "id_comp", "'ceasn:isPartOf'", "id_other", "k % 5 = 0 AND k % 3 = 1"),
    ("UNKNOWN_CLASS", "WARNING", "id_a", "'@type'", "'ceterms:NotAClass'", "k % 11 = 0"),
    ("UNKNOWN_PROPERTY", "WARNING", "id_a", "'ceterms:notAProperty'", "'-'", "k % 11 = 0"),
    ("DOMAIN_VIOLATION", "ERROR", "id_org", "'ceterms:hasPart'", "concat('@type=[', type_org, ']')", "c % 6 = 0 AND k % 13 = 0"),
    ("RANGE_VIOLATION", "ERROR", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 0 AND k % 3 = 0"),
    ("RANGE_VIOLATION", "ERROR", "id_comp", "'ceasn:isPartOf'", "id_comp", "k % 5 = 0 AND k % 3 = 2"),
    ("CONCEPT_RANGE_CONFLICT", "INFO", "id_a", "'ceterms:creditUnitType'", "'$.@graph[0].ceterms:creditUnitType[0]'", "k % 17 = 0"),
    ("VERSION_RANGE_CONFLICT", "INFO", "id_t1", "'ceterms:previousVersion'", "id_t2", "k % 19 = 0"),
    ("RANGE_DOCS_CONFLICT", "INFO", "id_comp", "'ceasn:isChildOf'", "id_fw", "k % 5 = 0 AND k % 2 = 0"),
    ("ISPARTOF_FRAMEWORK_MISMATCH", "WARNING", "id_comp", "'ceasn:isPartOf'", "id_other", "k % 5 = 0 AND k % 3 = 1"),
    ("INVERSE_ONE_DIRECTION", "INFO", "id_a", "'ceterms:hasPart'", "id_course", "k % 4 = 1"),
    ("INVERSE_ONE_DIRECTION", "INFO", "id_course", "'ceterms:isPartOf'", "id_course", "k % 4 = 2"),
    ("INVERSE_ONE_DIRECTION", "INFO", "id_comp", "'ceasn:isChildOf'", "id_fw", "k % 5 = 0 AND k % 2 = 0"),
    ("INVERSE_MISMATCH", "ERROR", "id_a", "'ceterms:hasPart'", "id_course", "k % 4 = 2"),
]
_SUPPLIED_EXPECTED = [
    ("REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 4 AND (c % 2 <> 0 OR c NOT IN (SELECT c_custkey FROM customer))"),
    ("REF_RESOLVED_SUPPLIED", "INFO", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 4 AND c % 2 = 0 AND c IN (SELECT c_custkey FROM customer)"),
    ("RANGE_VIOLATION", "ERROR", "id_a", "'ceterms:ownedBy'", "owner", "c % 6 = 4 AND c % 2 = 0 AND c % 3 = 0 AND c IN (SELECT c_custkey FROM customer)"),
]


def expected(*codes: str, beside: bool = False) -> str:
    """SQL of the findings (doc_id, code, severity, entity, property, value); ``beside``: with the supplied documents."""
    rows = [x for x in _EXPECTED if not (beside and x[:1] + x[4:5] == ("REF_OUTSIDE_PAYLOAD", "owner"))] + (_SUPPLIED_EXPECTED if beside else [])
    parts = [f"SELECT doc_id, '{code}' AS code, '{sev}' AS severity, {e} AS entity, {p} AS property, {v} AS value FROM d WHERE {cond}" for code, sev, e, p, v, cond in rows if not codes or code in codes]
    return f"WITH d AS ({FIELDS}) SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


# Large documents: one for each supplier, with a node for each of its line items.
_ITEM = "concat('https://i.example/', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))"
_OF = "concat('https://s.example/', cast(l_suppkey as varchar(20)))"
_LARGE = f"SELECT DISTINCT cast(l_suppkey as varchar(20)) AS doc_id, {_OF} AS parent, {_ITEM} AS item, l_linenumber AS i FROM lineitem"


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: a competency that names its children (but every seventh), which name it, another or none; and frameworks, of which it names none."""
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber")
    # Keys are told apart and gathered as numbers; texts, twenty times as large, are made of them where the document is.
    held = dealt(keys, "l_suppkey").groupBy("l_suppkey").agg(F.collect_set(F.struct("l_orderkey", "l_linenumber")).alias("rows"))  # a document is a row
    text = lambda c: c.cast("string")
    parent = F.concat(F.lit("https://s.example/"), text(F.col("l_suppkey")))
    item = lambda r: F.concat(F.lit("https://i.example/"), text(r["l_orderkey"]), F.lit("-"), text(r["l_linenumber"]))

    def child(r: F.Column) -> F.Column:
        i = r["l_linenumber"]
        up = F.when(i % 3 == 1, F.concat(F.lit(', "ceasn:isChildOf": "'), "parent", F.lit('"'))).when(i % 3 == 2, F.lit(', "ceasn:isChildOf": "https://s.example/other"')).otherwise("")
        return F.concat(F.lit('{"@id": "'), item(r), F.lit('", "@type": "ceasn:Competency"'), up, F.lit("}"))

    framework = lambda r: F.when(r["l_linenumber"] == 1, F.concat(F.lit('{"@id": "'), item(r), F.lit('/f", "@type": "ceasn:CompetencyFramework"}')))
    named = lambda r: F.when(r["l_linenumber"] != 7, F.concat(F.lit('"'), item(r), F.lit('"')))
    one = held.select(text(F.col("l_suppkey")).alias("doc_id"), parent.alias("parent"), "rows").select("doc_id", "parent", *(F.array_join(F.transform("rows", c), ", ").alias(n) for n, c in (("children", child), ("frameworks", framework), ("named", named))))  # nulls are left out
    first = F.concat(F.lit('{"@id": "'), "parent", F.lit('", "@type": "ceasn:Competency", "ceasn:isPartOf": "https://f.example/gone", "ceasn:hasChild": ['), "named", F.lit("]}"))
    nodes = F.concat_ws(", ", first, "children", F.when(F.col("frameworks") != "", F.col("frameworks")))
    return one.select("doc_id", F.concat(F.lit('{"@graph": ['), nodes, F.lit("]}")).alias("raw"))


LARGE_EXPECTED = f"""WITH d AS ({_LARGE})
SELECT doc_id, 'INVERSE_ONE_DIRECTION' AS code, 'INFO' AS severity, parent AS entity, 'ceasn:hasChild' AS property, item AS value FROM d WHERE i <> 7 AND i % 3 = 0
UNION ALL SELECT doc_id, 'INVERSE_MISMATCH', 'ERROR', parent, 'ceasn:hasChild', item FROM d WHERE i <> 7 AND i % 3 = 2
UNION ALL SELECT doc_id, 'INVERSE_MISMATCH', 'ERROR', item, 'ceasn:isChildOf', parent FROM d WHERE i = 7
UNION ALL SELECT DISTINCT doc_id, 'ISPARTOF_FRAMEWORK_MISMATCH', 'WARNING', parent, 'ceasn:isPartOf', 'https://f.example/gone' FROM d WHERE i = 1"""
