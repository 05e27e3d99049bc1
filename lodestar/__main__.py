"""Command line.

    python -m lodestar validate PATH... --encoding FILE... --context FILE... [--resolve PATH...] [--fail-on error] [--format text]
    python -m lodestar extract PATH --url PREFIX --encoding FILE... --context FILE... [--format text] [--validate]

Exit codes: 0 passed, 1 a finding that ``--fail-on`` counts (extract: a page
without entities), 2 something could not be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import checks, findings, mapping, markup, reports
from .operators.tables import kept
from .sources import documents
from .sources.vocabulary import Vocabulary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "extract"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="+")
        c.add_argument("--encoding", nargs="+", required=True)
        c.add_argument("--context", nargs="+", required=True)
        c.add_argument("--format", choices=("text", "json", "annotations"), default="text")
        c.add_argument("--fail-on", choices=sorted(findings.GATES), default="error")
        c.add_argument("--out", help="write the rendering there instead of printing it")
    sub.choices["validate"].add_argument("--resolve", nargs="+", default=[])
    sub.choices["extract"].add_argument("--url", default="")
    sub.choices["extract"].add_argument("--validate", action="store_true")
    return p


def show(df: DataFrame, out: str | None) -> None:
    """Write one text column, or print it row by row."""
    if out:
        df.write.mode("overwrite").text(out)
    else:
        for row in df.toLocalIterator():
            print(row[0])


def gated(docs: DataFrame, vocab: Vocabulary, args: argparse.Namespace, beside: DataFrame | None = None) -> int:
    s = checks.session(docs, vocab, beside)
    found = kept(checks.validate(s))
    kinds = {"text": lambda: findings.as_text(found).select("text"), "json": lambda: findings.as_json(found, "lodestar", "0.1").select("json"), "annotations": lambda: findings.as_annotations(findings.ordered(found)).select("line")}
    show(kinds[args.format](), args.out)
    gate = findings.batch_gate(docs, s.nodes, found, args.fail_on)
    for (line,) in findings.output_lines(gate).collect():
        print(line, file=sys.stderr)
    return gate.collect()[0]["exit_code"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    vocab = Vocabulary.read(spark, args.encoding, args.context)
    if args.command == "validate":
        try:
            beside = documents.json_documents(spark, *args.resolve) if args.resolve else None
            return gated(documents.json_documents(spark, *args.path, recursive=True), vocab, args, beside)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    pages = kept(markup.read_pages(documents.saved_pages(spark, args.path[0], args.url), vocab))
    x = mapping.extract(pages, vocab)
    shown = reports.rendered(pages, x)
    show(shown.select("text" if args.format == "text" else "json"), args.out)
    worst = mapping.exit_codes(pages, x).agg({"exit_code": "max"}).collect()[0][0]
    code = 2 if worst is None else int(worst)
    if args.validate:
        code = max(code, gated(mapping.documents(x).withColumnRenamed("page_id", "doc_id"), vocab, args))
    return code


if __name__ == "__main__":
    sys.exit(main())
