"""The vocabulary as tables made by Spark from its published files.

``Vocabulary`` holds what a task looks up by itself; these are the same facts as relations, for joins and
for vocabularies of any size: the ``@graph`` of every encoding is exploded, sets are united by
grouping, contexts give coercions, and what classes descend from is a fixpoint over the
table of their parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import is_checked_term
from ..operators.closure import ancestors
from ..operators.tables import kept
from .vocabulary import LITERAL_RANGES, UNIVERSAL_RANGE

# Keys of an encoding's entries, and what they are called here.
KEYS = {
    "@id": "term", "@type": "kind", "rdfs:subClassOf": "parents", "schema:domainIncludes": "domain", "schema:rangeIncludes": "range", "meta:targetScheme": "target_scheme",
    "owl:inverseOf": "inverse", "owl:equivalentClass": "same_class", "rdfs:subPropertyOf": "over", "owl:equivalentProperty": "same_property",
}


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """n, value: the files in the order given."""
    return reduce(DataFrame.unionAll, [spark.read.text(p, wholetext=True).select(F.lit(n).alias("n"), "value") for n, p in enumerate(paths)])


def _listed(c: str) -> Column:
    """A JSON value, text or list, as the list of its texts; ``from_json`` gives other values as their JSON."""
    text = F.col(c)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull())).otherwise(F.array(text))


def entries(spark: SparkSession, encodings: list[str]) -> DataFrame:
    """A row for each class and property entry of the encodings: file, place, term, kind and the lists that it declares."""
    schema = "struct<`@graph`: array<struct<" + ", ".join(f"`{k}`: string" for k in KEYS) + ">>>"
    each = _whole(spark, encodings).select("n", F.posexplode(F.from_json("value", schema)["@graph"]).alias("pos", "e"))
    named = each.select("n", "pos", *(F.col("e")[k].alias(v) for k, v in KEYS.items())).where("term IS NOT NULL AND kind IN ('rdfs:Class', 'rdf:Property')")
    lists = [v for k, v in KEYS.items() if not k.startswith("@")]
    return kept(named.select("n", "pos", "term", "kind", *(_listed(v).alias(v) for v in lists)))


def _union(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def classes(rows: DataFrame) -> DataFrame:
    """term, parents, ancestors of every declared class."""
    own = rows.where("kind = 'rdfs:Class'")
    edges = own.select("term", F.explode("parents").alias("parent"))
    up = ancestors(edges, own.select("term")).groupBy("term").agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors"))
    return own.groupBy("term").agg(_union("parents")).join(up, "term")


def properties(spark: SparkSession, rows: DataFrame, contexts: list[str]) -> DataFrame:
    """prop, domain, range, target_scheme, inverse, id_coerced, language_map, has_entities, universal of every declared property.

    Declarations add up, the last inverse wins; of contexts the first to coerce a term wins.
    """
    at = F.struct("n", "pos")
    inverse = F.get("inverse", F.lit(0))
    own = rows.where("kind = 'rdf:Property'").groupBy(F.col("term").alias("prop")).agg(_union("domain"), _union("range"), _union("target_scheme"), F.max_by(inverse, F.when(inverse.isNotNull(), at)).alias("inverse"))
    said = _whole(spark, contexts).select("n", F.explode(F.from_json(F.get_json_object("value", "$['@context']"), "map<string,string>")).alias("prop", "how")).where(F.col("how").startswith("{"))
    coerced = said.groupBy("prop").agg(F.min_by("how", "n").alias("how"))
    how = lambda key: F.coalesce(F.get_json_object("how", f"$['{key}']"), F.lit(""))
    met = own.join(coerced, "prop", "left").withColumns({"id_coerced": how("@type") == "@id", "language_map": how("@container") == "@language"})
    literal = F.array(*map(F.lit, sorted(LITERAL_RANGES)))
    return met.withColumns({"has_entities": F.size(F.array_except("range", literal)) > 0, "universal": F.array_contains("range", UNIVERSAL_RANGE)}).drop("how")


def crosswalk(rows: DataFrame) -> DataFrame:
    """is_class, relation, foreign, ctdl: the sorted terms of this vocabulary that stand to a term of another in a relation."""
    kinds = [(True, "equivalent", "rdfs:Class", "same_class"), (True, "specialized", "rdfs:Class", "parents"), (False, "equivalent", "rdf:Property", "same_property"), (False, "specialized", "rdf:Property", "over")]
    each = [rows.where(F.col("kind") == kind).select(F.lit(c).alias("is_class"), F.lit(r).alias("relation"), F.explode(name).alias("foreign"), "term") for c, r, kind, name in kinds]
    met = reduce(DataFrame.unionAll, each).where(is_checked_term(F.col("term")) & ~is_checked_term(F.col("foreign")))
    return met.groupBy("is_class", "relation", "foreign").agg(F.array_sort(F.collect_set("term")).alias("ctdl"))
