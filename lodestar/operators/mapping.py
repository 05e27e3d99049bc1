"""Items of pages to CTDL entities, by joins with the vocabulary and its crosswalk.

A term of another vocabulary is carried over only where an equivalence is
declared; everything else becomes a note.  Items are keyed by (page_id, path):
items that share a path share an entity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_absolute_iri, is_checked_term
from ..sources.vocabulary import Vocabulary
from .tables import kept

CONTEXT = "https://credreg.net/ctdl/schema/context/json"
NOTES = "page_id string, phase int, item_ord int, pos int, sub int, code string, severity string, subject string, term string, detail string"


@dataclass
class Extraction:
    entities: DataFrame  # page_id, path, first_ord, id, classes
    values: DataFrame  # page_id, path, ord, pos, prop, value, language
    notes: DataFrame  # NOTES; in the order of its first four numbers


def _note(df: DataFrame, phase: int, code: str, severity: str, term: Column, detail: Column, *, pos: Column, sub: Column | None = None) -> DataFrame:
    return df.select("page_id", F.lit(phase).alias("phase"), F.col("ord").alias("item_ord"), pos.cast("int").alias("pos"), (F.lit(0) if sub is None else sub).cast("int").alias("sub"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("path").alias("subject"), term.alias("term"), detail.alias("detail"))


def items_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")


def blocks_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode("blocks").alias("seq", "b")).select("page_id", "seq", "b.*")


def extract(pages: DataFrame, vocab: Vocabulary) -> Extraction:
    """Map read pages; ``pages`` is read several times, so write it to a table (``tables.kept``) first.

    Classes, entities and values are written to tables in turn: each is read by
    several joins and notes.
    """
    spark = pages.sparkSession
    walk = vocab.crosswalk_table(spark)
    of = lambda is_class, relation, name: F.broadcast(walk.where((F.col("is_class") == is_class) & (F.col("relation") == relation)).select(F.col("foreign").alias("term"), F.col("ctdl").alias(name)))
    none = F.array().cast("array<string>")
    items = items_of(pages)

    # Classes
    declared = F.broadcast(vocab.class_table(spark).select(F.col("term"), F.lit(True).alias("declared"), "ancestors"))
    typed = items.select("page_id", "ord", "path", F.size("props").alias("n_props"), F.posexplode("types").alias("pos", "term"))
    met = typed.join(declared, "term", "left").join(of(True, "equivalent", "same"), "term", "left").join(of(True, "specialized", "under"), "term", "left").withColumns({"same": F.coalesce("same", none), "under": F.coalesce("under", none), "declared": F.coalesce("declared", F.lit(False))})
    n = F.size("same")
    cls = F.when(is_checked_term(F.col("term")) & F.col("declared"), F.col("term")).when(n == 1, F.get("same", F.lit(0))).when((n == 0) & F.col("declared"), F.col("term"))
    met = kept(met.withColumn("cls", cls))
    lost = met.where("cls IS NULL")
    bare = lost.where(n == 0)
    related = bare.select("*", F.posexplode("under").alias("r", "rel"))
    term, pos = F.col("term"), F.col("pos")
    notes = [
        _note(items.where(F.size("types") == 0), 1, "ITEM_UNTYPED", "WARNING", F.lit("(no type)"), F.lit("No type is declared, so nothing was emitted"), pos=F.lit(0)),
        _note(lost.where(n > 1), 1, "CLASS_AMBIGUOUS", "WARNING", term, F.concat(F.lit("Several classes are equivalent: "), F.array_join("same", ", ")), pos=pos),
        _note(bare, 1, "CLASS_NOT_MAPPED", "WARNING", term, F.concat(F.lit("No class is equivalent; "), F.col("n_props").cast("string"), F.lit(" value(s) were dropped")), pos=pos),
        _note(related, 1, "CLASS_RELATED_NOT_EQUIVALENT", "INFO", term, F.concat("rel", F.lit(" is narrower than this type")), pos=pos, sub=F.col("r") + 1),
    ]
    per_item = met.where("cls IS NOT NULL").groupBy("page_id", "path", "ord").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cls"))), lambda x: x["cls"])).alias("classes"))
    own = per_item.join(items.select("page_id", "ord", "label"), ["page_id", "ord"])
    entities = kept(own.groupBy("page_id", "path").agg(F.min("ord").alias("first_ord"), F.max_by("label", "ord").alias("id"), F.max_by("classes", "ord").alias("classes")))
    labels = items.groupBy("page_id", "path").agg(F.max_by("label", "ord").alias("ref"))

    # Properties
    props = items.select("page_id", "path", "ord", F.explode("props").alias("p")).select("page_id", "path", "ord", "p.*").join(entities.select("page_id", "path", "classes"), ["page_id", "path"])
    table = vocab.property_table(spark)
    plain = F.broadcast(table.select(F.col("prop").alias("term"), F.lit(True).alias("declared")))
    known = props.join(plain, "term", "left").join(of(False, "equivalent", "same"), "term", "left").join(of(False, "specialized", "under"), "term", "left").withColumns({"same": F.coalesce("same", none), "under": F.coalesce("under", none), "declared": F.coalesce("declared", F.lit(False))})
    # Candidates whose domain takes the subject: only terms with several come here.
    unsure = known.where((F.size("same") > 1) & ~(is_checked_term(F.col("term")) & F.col("declared"))).select("page_id", "ord", "pos", "classes", F.explode("same").alias("prop"))
    anc = F.broadcast(vocab.class_table(spark).select(F.col("term").alias("c"), "ancestors"))
    fits = unsure.select("*", F.explode("classes").alias("c")).join(anc, "c", "left").join(F.broadcast(table.select("prop", "domain")), "prop").where(F.arrays_overlap(F.coalesce("ancestors", F.array("c")), "domain"))
    narrowed = fits.groupBy("page_id", "ord", "pos").agg(F.collect_set("prop").alias("fit"))
    chosen = known.join(narrowed, ["page_id", "ord", "pos"], "left")
    prop = F.when(is_checked_term(F.col("term")) & F.col("declared"), F.col("term")).when(n == 1, F.get("same", F.lit(0))).when((n == 0) & F.col("declared"), F.col("term")).when(F.size("fit") == 1, F.get("fit", F.lit(0)))
    chosen = kept(chosen.withColumn("prop", prop))
    lost = chosen.where("prop IS NULL")
    bare = lost.where(n == 0)
    notes += [
        _note(lost.where(n > 1), 2, "PROPERTY_AMBIGUOUS", "WARNING", term, F.concat(F.lit("Several properties are equivalent and the domain does not settle it: "), F.array_join("same", ", ")), pos=pos),
        _note(bare, 2, "PROPERTY_NOT_MAPPED", "WARNING", term, F.lit("No property is equivalent, so the value was dropped"), pos=pos),
        _note(bare.select("*", F.posexplode("under").alias("r", "rel")), 2, "PROPERTY_RELATED_NOT_EQUIVALENT", "INFO", term, F.concat("rel", F.lit(" is narrower than this term")), pos=pos, sub=F.col("r") + 1),
    ]

    # Values
    facts = F.broadcast(table.select("prop", "id_coerced", "language_map", "has_entities", F.lit(True).alias("defined")))
    v = chosen.where("prop IS NOT NULL").join(facts, "prop", "left")
    child = entities.select("page_id", F.col("path").alias("child"), F.lit(True).alias("built"))
    v = v.join(child, ["page_id", "child"], "left").join(labels.withColumnRenamed("path", "child"), ["page_id", "child"], "left")
    nested = F.col("child").isNotNull()
    literal = ~nested & F.col("iri").isNull()
    takes_id = F.coalesce(F.col("id_coerced") & F.col("has_entities"), F.lit(False))
    outcome = (
        F.when(nested & F.coalesce(~F.col("id_coerced"), F.lit(False)), "VALUE_NOT_LITERAL")
        .when(nested & F.col("built").isNull(), "NESTED_ITEM_DROPPED")
        .when(literal & takes_id & ~is_absolute_iri(F.col("text")), "VALUE_NOT_IDENTIFIER")
        .when(literal & ~takes_id & F.coalesce("language_map", F.lit(False)) & F.col("language").isNull(), "LANGUAGE_UNDECLARED")
    )
    v = kept(v.withColumn("outcome", outcome))
    said = {"VALUE_NOT_LITERAL": ("WARNING", "A nested item where a literal belongs, so it was dropped"), "NESTED_ITEM_DROPPED": ("WARNING", "The nested item gave no entity, so the reference was dropped"), "VALUE_NOT_IDENTIFIER": ("WARNING", "A literal where an identifier belongs, so it was dropped"), "LANGUAGE_UNDECLARED": ("INFO", "The page declares no language, so the text was left untagged")}
    notes += [_note(v.where(F.col("outcome") == code), 2, code, severity, F.col("prop"), F.lit(detail), pos=pos) for code, (severity, detail) in said.items()]
    left = v.where("outcome IS NULL OR outcome = 'LANGUAGE_UNDECLARED'")
    tagged = F.when(literal & ~takes_id & F.coalesce("language_map", F.lit(False)), F.col("language"))
    values = left.select("page_id", "path", "ord", "pos", "prop", F.coalesce(F.when(nested, F.col("ref")), "iri", "text").alias("value"), tagged.alias("language"))

    without = entities.join(values.where("prop = 'ceterms:ctid'").select("page_id").distinct(), "page_id", "left_anti").select("page_id").distinct().select("page_id", F.lit(0).alias("ord"), F.lit("$.@graph").alias("path"))
    notes.append(_note(without, 3, "CTID_ABSENT", "INFO", F.lit("ceterms:ctid"), F.lit("No entity has a CTID, and none is invented"), pos=F.lit(0)))
    read = pages.select("page_id", F.posexplode("notes").alias("pos", "n")).select("page_id", F.lit(0).alias("phase"), F.lit(0).alias("item_ord"), "pos", F.lit(0).alias("sub"), "n.code", "n.severity", "n.subject", "n.term", "n.detail")
    for x in notes:
        read = read.unionAll(x)
    return Extraction(entities, values, read)


def documents(x: Extraction) -> DataFrame:
    """page_id, raw: the document of every page that gave an entity, with sorted keys."""
    own = x.values.groupBy("page_id", "path").agg(F.sort_array(F.collect_list(F.struct("ord", "pos", "prop", "value", "language"))).alias("values"))
    graph = x.entities.join(own, ["page_id", "path"], "left").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("first_ord", "id", "classes", "values"))).alias("graph"))

    def node(e: dict) -> dict:
        out: dict = {"@id": e["id"], "@type": e["classes"] if len(e["classes"]) > 1 else e["classes"][0]}
        for v in e["values"] or []:
            new = v["value"] if v["language"] is None else {v["language"]: v["value"]}
            old = out.get(v["prop"])
            if isinstance(old, dict) and isinstance(new, dict):
                for k, text in new.items():
                    had = old.get(k)
                    old[k] = text if had is None else [*(had if isinstance(had, list) else [had]), text]
            elif v["prop"] in out:
                out[v["prop"]] = [*(old if isinstance(old, list) else [old]), new]
            else:
                out[v["prop"]] = new
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [json.dumps({"@context": CONTEXT, "@graph": [node(e) for e in g]}, indent=2, sort_keys=True, ensure_ascii=False) for g in b.column("graph").to_pylist()]
            yield pa.record_batch([b.column("page_id"), pa.array(raw, pa.string())], names=["page_id", "raw"])

    return graph.mapInArrow(run, "page_id string, raw string")


def exit_codes(pages: DataFrame, x: Extraction) -> DataFrame:
    """page_id, exit_code: 0 if entities came out, 1 if none did, 2 if the page was refused."""
    counted = x.entities.groupBy("page_id").agg(F.count("*").alias("entities"))
    return pages.select("page_id", "error").join(counted, "page_id", "left").select("page_id", F.when(F.col("error").isNotNull(), 2).when(F.col("entities") > 0, 0).otherwise(1).alias("exit_code"))
