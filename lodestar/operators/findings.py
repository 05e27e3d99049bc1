"""Findings: order, counts, gates and renderings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks

SEVERITIES = ("ERROR", "WARNING", "INFO", "UNVERIFIABLE")
ORDER = ("entity", "property", "code", "value", "severity", "message")
# Severities that a fail-on level counts; UNVERIFIABLE never gates.
GATES = {"error": ("ERROR",), "warning": ("ERROR", "WARNING"), "info": ("ERROR", "WARNING", "INFO")}
LEVELS = {"ERROR": "error", "WARNING": "warning", "INFO": "notice", "UNVERIFIABLE": "notice"}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("doc_id", *ORDER)


def severity_counts(severity: Column | str = "severity") -> list[Column]:
    """All four counts, zero where there is none."""
    c = F.col(severity) if isinstance(severity, str) else severity
    return [F.count_if(c == s).alias(s) for s in SEVERITIES]


def per_document(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, a count for each severity, n_findings; documents without findings count zero."""
    counted = findings.groupBy("doc_id").agg(*severity_counts(), F.count("*").alias("n_findings"))
    return documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(counted, "doc_id", "left").fillna(0, [*SEVERITIES, "n_findings"])


def exit_codes(documents: DataFrame, nodes: DataFrame, findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """doc_id, exit_code: 2 unreadable, 1 a finding that ``fail_on`` counts, else 0."""
    if fail_on not in GATES:
        raise ValueError(f"fail_on is one of {sorted(GATES)}")
    unreadable = nodes.where("error IS NOT NULL").select("doc_id", F.lit(2).alias("broken")).distinct()
    gated = findings.where(F.col("severity").isin(*GATES[fail_on])).select("doc_id", F.lit(1).alias("failed")).distinct()
    return documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(unreadable, "doc_id", "left").join(gated, "doc_id", "left").select("doc_id", F.coalesce("broken", "failed", F.lit(0)).alias("exit_code"))


def batch_gate(documents: DataFrame, nodes: DataFrame, findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row: documents, severity totals and the exit code of the batch (2 also if there are no documents)."""
    codes = exit_codes(documents, nodes, findings, fail_on)
    totals = findings.agg(*severity_counts())
    return codes.agg(F.count("*").alias("documents"), F.count_if(F.col("exit_code") == 2).alias("unreadable"), F.max("exit_code").alias("worst")).join(F.broadcast(totals)).select("documents", "unreadable", *SEVERITIES, F.when(F.col("documents") == 0, 2).otherwise(F.col("worst")).alias("exit_code"))


def _lines() -> Column:
    return F.format_string("%-12s %s  entity=%s\n    %s = %s\n    %s\n    rule: %s\n    source: %s (retrieved %s)", "severity", "code", "entity", "property", "value", "message", "rule.citation", "rule.url", "rule.retrieved")


def _summary_line() -> Column:
    return F.concat(F.col("n").cast("string"), F.lit(" finding(s): "), F.array_join(F.array(*(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in SEVERITIES)), ", "))


def as_text(findings: DataFrame) -> DataFrame:
    """doc_id, text: five lines for each finding in order, then the summary; ``text_chunks`` is for documents of very many findings."""
    key = F.struct(*ORDER, _lines().alias("text"))
    one = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(key)).alias("all"), F.count("*").alias("n"), *severity_counts())
    return one.select("doc_id", F.concat(F.array_join(F.transform("all", lambda x: F.concat(x["text"], F.lit("\n"))), "\n"), F.lit("\n"), _summary_line()).alias("text"))


def as_json(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """doc_id, json: indented by 2 with sorted keys, as ``json.dumps`` writes it, non-ASCII kept."""
    one = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "rule"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [json.dumps({"tool": {"name": tool, "version": version}, "findings": found, "summary": {s: sum(f["severity"] == s for f in found) for s in SEVERITIES}}, indent=2, sort_keys=True, ensure_ascii=False) for found in b.column("all").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "json"])

    return one.mapInArrow(run, "doc_id string, json string")


def text_chunks(findings: DataFrame, limit: int = chunks.CHUNK_CHARS) -> DataFrame:
    """doc_id, part, chunk, text: what ``as_text`` says, in rows of about ``limit`` characters, however many findings a document has."""
    rows = findings.select(F.col("doc_id").alias("key"), *ORDER, _lines().alias("line"))
    body = chunks.in_chunks(rows, [*ORDER, "line"], lambda b: [t + "\n\n" for t in b.column("line").to_pylist()], limit=limit)
    n = findings.groupBy("doc_id").agg(F.count("*").alias("n"), *severity_counts())
    return body.withColumnRenamed("key", "doc_id").unionAll(n.select("doc_id", F.lit(chunks.TAIL), F.lit(0), _summary_line()))


def json_chunks(findings: DataFrame, tool: str, version: str, limit: int = chunks.CHUNK_CHARS) -> DataFrame:
    """doc_id, part, chunk, text: what ``as_json`` says, in such rows."""

    def render(b: pa.RecordBatch) -> list[str]:
        found = [json.dumps({k: r[k] for k in (*ORDER, "rule")}, indent=2, sort_keys=True, ensure_ascii=False) for r in b.to_pylist()]
        return ["    " + x.replace("\n", "\n    ") for x in found]

    rows = findings.select(F.col("doc_id").alias("key"), *ORDER, "rule")
    body = chunks.in_chunks(rows, [*ORDER, "rule"], render, ",\n", limit).withColumnRenamed("key", "doc_id")
    n = findings.groupBy("doc_id").agg(*severity_counts())
    counts = F.concat_ws(",\n", *(F.format_string(f'    "{s}": %d', s) for s in sorted(SEVERITIES)))
    named = json.dumps({"name": tool, "version": version}, indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n  ")
    end = F.concat(F.lit('\n  ],\n  "summary": {\n'), counts, F.lit(f'\n  }},\n  "tool": {named}\n}}'))
    edge = lambda part, text: n.select("doc_id", F.lit(part), F.lit(0), text)
    return body.unionAll(edge(chunks.HEAD, F.lit('{\n  "findings": [\n'))).unionAll(edge(chunks.TAIL, end))


def _escaped(c: Column, *more: tuple[str, str]) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *more):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_annotations(findings: DataFrame, file: Column | str = "doc_id") -> DataFrame:
    """doc_id, line: ``::level file=...,title=CODE (SEVERITY)::entity: property = value. message``; an empty file is left out."""
    of = F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p))
    prop = (":", "%3A"), (",", "%2C")
    name = F.col(file) if isinstance(file, str) else file
    title = F.concat("code", F.lit(" ("), "severity", F.lit(")"))
    said = F.concat("entity", F.lit(": "), "property", F.lit(" = "), "value", F.lit(". "), "message")
    where = F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.concat(F.lit("file="), _escaped(name, *prop), F.lit(",")))
    return findings.select("doc_id", F.concat(F.lit("::"), F.coalesce(of[F.col("severity")], F.lit("notice")), F.lit(" "), where, F.lit("title="), _escaped(title, *prop), F.lit("::"), _escaped(said)).alias("line"))


def output_lines(gate: DataFrame) -> DataFrame:
    """``name=value`` lines of the batch gate."""
    names = ["documents", "unreadable", *SEVERITIES, "exit_code"]
    return gate.select(F.explode(F.array(*(F.concat(F.lit(f"{n.lower()}="), F.col(n).cast("string")) for n in names))).alias("line"))
