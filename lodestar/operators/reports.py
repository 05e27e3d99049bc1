"""Renderings of what was read from pages: envelope JSON and text, one for each page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.evidence import EvidenceSink
from .checks import CTID_URL, RETRIEVED
from .mapping import CONTEXT, Extraction, documents
from .survey import REASONS

# Where the published rules stand, and when they were read.
_READ = "2026-08-14"
_POLICY = ("Policy: nothing is emitted that the page does not state", "README.md (Checks)", "-")
_MAPPING = ("Schema encoding: a term is carried over only where an equivalence is declared", "https://credreg.net/ctdl/schema/encoding/json", RETRIEVED)
_CONTEXT = ("Context: which properties are references or language maps", "https://credreg.net/ctdl/schema/context/json", RETRIEVED)
_MICRODATA = ("HTML Living Standard: microdata", "https://html.spec.whatwg.org/multipage/microdata.html", _READ)
_RDFA = ("RDFa Lite 1.1", "https://www.w3.org/TR/rdfa-lite/", _READ)
_JSON_LD = ("The context that schema.org publishes", "https://schema.org/docs/jsonldcontext.json", _READ)
_CTID = ("About the CTID: its owner assigns it", CTID_URL, RETRIEVED)
#: The rule that each kind of note cites; the others cite the policy.
NOTE_RULES = {
    **dict.fromkeys(("CLASS_AMBIGUOUS", "CLASS_NOT_MAPPED", "CLASS_RELATED_NOT_EQUIVALENT", "PROPERTY_AMBIGUOUS", "PROPERTY_NOT_MAPPED", "PROPERTY_RELATED_NOT_EQUIVALENT"), _MAPPING),
    **dict.fromkeys(("VALUE_NOT_IDENTIFIER", "VALUE_NOT_LITERAL", "LANGUAGE_UNDECLARED"), _CONTEXT),
    **dict.fromkeys(("EMPTY_VALUE", "MICRODATA_NAME_UNRESOLVED", "MICRODATA_ITEMREF"), _MICRODATA),
    **dict.fromkeys(("RDFA_TERM_UNRESOLVED", "RDFA_BEYOND_LITE"), _RDFA),
    "JSONLD_CONTEXT_UNRESOLVED": _JSON_LD,
    "CTID_ABSENT": _CTID,
}


#: What an envelope says of how a page was fetched.
FETCH = ("requested_url", "final_url", "status", "content_type", "encoding", "bytes", "redirects", "robots")


def _gathered(pages: DataFrame, x: Extraction, fetched: DataFrame | None) -> DataFrame:
    """page_id, url, blocks, notes (in order), entities, raw and fetch of every page that was read."""
    notes = x.notes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("phase", "item_ord", "pos", "sub", "code", "severity", "subject", "term", "detail"))).alias("said"))
    n = x.entities.groupBy("page_id").agg(F.count("*").alias("entities"))
    read = pages.where("error IS NULL").select("page_id", "url", "blocks")
    if fetched is None:
        read = read.withColumn("fetch", F.lit(None).cast("struct<requested_url:string>"))
    else:
        read = read.join(fetched.select("url", F.struct(F.col("url").alias("requested_url"), *FETCH[1:]).alias("fetch")), "url", "left")
    return read.join(notes, "page_id", "left").join(n, "page_id", "left").join(documents(x), "page_id", "left").fillna(0, ["entities"])


def _note(n: dict) -> dict:
    citation, url, retrieved = NOTE_RULES.get(n["code"], _POLICY)
    return {k: n[k] for k in ("code", "severity", "subject", "term", "detail")} | {"rule": {"citation": citation, "url": url, "retrieved": retrieved}}


def _summary(row: dict) -> dict:
    said = row["said"] or []
    return {"entities": row["entities"], **{s: sum(n["severity"] == s for n in said) for s in ("WARNING", "INFO")}}


def envelope(row: dict, tool: str, version: str) -> str:
    document = json.loads(row["raw"]) if row["raw"] else {"@context": CONTEXT, "@graph": []}
    out = {"tool": {"name": tool, "version": version, "command": "extract"}, "source": row["url"], "fetch": row["fetch"], "blocks": [{"format": b["fmt"], **{k: b[k] for k in ("path", "items", "types")}} for b in row["blocks"]], "document": document, "notes": [_note(n) for n in row["said"] or []], "summary": _summary(row)}
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)


def text(row: dict) -> str:
    lines = [f"{b['fmt']:9} {b['path']}  {b['items']} item(s): {', '.join(b['types']) or '(no type)'}" for b in row["blocks"]]
    for n in map(_note, row["said"] or []):
        lines += [f"{n['severity']:12} {n['code']}  {n['subject']}", f"    {n['term']}", f"    {n['detail']}", f"    rule: {n['rule']['citation']}", f"    source: {n['rule']['url']} (retrieved {n['rule']['retrieved']})"]
    s = _summary(row)
    return "\n".join([*lines, f"{s['entities']} entit{'y' if s['entities'] == 1 else 'ies'}, {s['WARNING']} WARNING, {s['INFO']} INFO"])


def rendered(pages: DataFrame, x: Extraction, tool: str = "lodestar", version: str = "0.1", fetched: DataFrame | None = None) -> DataFrame:
    """page_id, json, text; ``fetched`` (rows of the fetcher, by url) fills the fetch block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.record_batch([b.column("page_id"), pa.array([envelope(r, tool, version) for r in rows], pa.string()), pa.array([text(r) for r in rows], pa.string())], names=["page_id", "json", "text"])

    return _gathered(pages, x, fetched).mapInArrow(run, "page_id string, json string, text string")


def as_json(value: dict) -> str:
    """Indented by 2 with sorted keys, non-ASCII kept, and a line end."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _tree(rows: list, key: str) -> dict:
    return {r["key"]: r["n"] for r in rows if r["measure"] == key}


def rollup_block(rolled: DataFrame) -> dict:
    """The rows of ``survey.roll_up`` (some for each type, pass and code) by type ("*" for all) and pass."""
    out: dict = {}
    for r in rolled.collect():
        block = out.setdefault(r["type"], {}).setdefault(r["pass"], {"severities": {}, "codes": {}})
        kind, _, name = r["measure"].partition(":")
        if kind in ("severity", "code"):
            block["severities" if kind == "severity" else "codes"][name] = r["n"]
        else:
            # Names of the counts in evidence.
            block[{"documents": "documents", "clean": "documents_with_no_findings", "with_error": "documents_with_at_least_one_error"}[kind]] = r["n"]
    return out


def protocol(registry: str, community: str) -> dict:
    """How a survey draws and what it leaves out, in words."""
    return {
        "frame": f"every page of {registry}/{community}/envelopes with one envelope a page, from 1 to the X-Total header",
        "draw": "page numbers without replacement by Python's seeded generator, in order",
        "resolve": "one step, to the /resources/ URIs of the registry's host that the documents name",
        "exclusion_reasons": list(REASONS),
    }


def survey_evidence(rolled: DataFrame, documents: DataFrame, exclusions: DataFrame, access: dict, supplied: dict, *, registry: str = "", community: str = "", tool: str = "lodestar", version: str = "0.1") -> dict:
    """What a registry survey found, without the rows of ``documents`` and ``exclusions``, which only are counted.

    ``access`` is that of ``draws.access``; ``supplied`` has the counts of ``supplied_counts``.
    """
    by_type = rollup_block(rolled)
    every = by_type.pop("*", {})
    left_out = exclusions.where("reason IS NOT NULL")
    reasons = {r["reason"]: r["count"] for r in left_out.groupBy("reason").count().collect()}
    return {"tool": {"name": tool, "version": version}, "registry": registry, "community": community, "protocol": protocol(registry, community), "access": access, "sampled": documents.count(), "excluded": sum(reasons.values()), "excluded_by_reason": reasons, **supplied, "rollup_alone": every.get("alone", {}), "rollup_resolved": every.get("resolved", {}), "by_type": by_type}


def supplied_counts(readable: DataFrame, entities: DataFrame, refused: DataFrame) -> dict:
    """Neighbours that were supplied and the entities in them, and those set aside (the two results of ``checks.screened``)."""
    return {"supplied_documents": readable.count(), "supplied_entities": entities.count(), "supplied_rejected": refused.count()}


def markup_evidence(summary: DataFrame) -> dict:
    """The rows of ``survey.markup_summary`` as one object."""
    rows = summary.collect()  # formats, types and codes
    return {**_tree(rows, "pages"), "formats": _tree(rows, "format"), "declared_types": _tree(rows, "type"), "note_codes": _tree(rows, "note"), "validation_codes": _tree(rows, "finding")}


def write_evidence(path: str, summary: dict, **tables: DataFrame) -> None:
    """``path``/summary has the JSON of ``summary``; each table is a folder of JSON lines beside it, written by the executors.

    All of it is there or nothing: see ``sources.evidence``.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.dataSource.register(EvidenceSink)
    rows = [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json")) for name, df in tables.items()]
    reduce(DataFrame.unionAll, rows).write.format(EvidenceSink.name()).option("path", path).option("summary", as_json(summary)).option("tables", " ".join(tables)).mode("append").save()
