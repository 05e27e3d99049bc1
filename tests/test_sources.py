"""Readers, polite fetching from a local server, streaming, surveys and the driver contract."""

import json
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import duckdb
import pytest

from lodestar.functions import identifiers as I
from lodestar.operators import survey
from lodestar.plans import registry
from lodestar.plans.mini_vocabulary import files, mini
from lodestar.sources import documents, draws, fetch
from lodestar.sources.vocabulary import Vocabulary
from lodestar.streaming.validate import stream_documents, validate_stream

REPO = Path(__file__).resolve().parent.parent


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.json", "a.json", "x.txt", "sub/c.json"):
        (tmp_path / name).write_text("{}")
    names = lambda df: sorted(r["doc_id"].rpartition("/")[2] for r in df.collect())
    assert names(documents.json_documents(spark, str(tmp_path))) == ["a.json", "b.json"]
    assert names(documents.json_documents(spark, str(tmp_path), recursive=True)) == ["a.json", "b.json", "c.json"]
    assert names(documents.json_documents(spark, str(tmp_path / "sub"), str(tmp_path / "a.json"))) == ["a.json", "c.json"]
    (tmp_path / "list").write_text("# no\n\ncollege\thttps://a.example/\n")
    assert [tuple(r) for r in documents.targets(spark, str(tmp_path / "list")).collect()] == [("college", "https://a.example/")]
    (tmp_path / "env").mkdir()
    (tmp_path / "env/7.json").write_text(json.dumps({"envelope_ceterms_ctid": "ce-1", "decoded_resource": {"@id": "x"}}))
    (r,) = documents.envelopes(spark, str(tmp_path / "env")).collect()
    assert (r["page"], r["ctid"], json.loads(r["resource"])) == (7, "ce-1", {"@id": "x"})
    encoding, context = files()
    for n, d in (("e.json", encoding), ("c.json", context)):
        (tmp_path / n).write_text(json.dumps(d))
    v = Vocabulary.read(spark, [str(tmp_path / "e.json")], [str(tmp_path / "c.json")])
    assert v.parents == mini().parents and v.crosswalk == mini().crosswalk


@pytest.fixture(scope="module")
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/robots.txt":
                return self.answer(200, "text/plain", b"User-agent: *\nDisallow: /no\n")
            if self.path.startswith("/loop"):
                return self.answer(302, "text/html", b"", "/loop2" if self.path == "/loop" else "/loop")
            if self.path == "/moved":
                return self.answer(301, "text/html", b"", "/page")
            kinds = {"/page": (200, "text/html; charset=latin-1", "caf\xe9".encode("latin-1")), "/no/x": (200, "text/html", b"x"), "/pdf": (200, "application/pdf", b"x"), "/big": (200, "text/html", b"x" * (fetch.PAGE_BYTES + 1)), "/json": (200, "application/json", b"{}")}
            self.answer(*kinds.get(self.path, (404, "text/html", b"")))

        def answer(self, status, kind, body, location=None):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            if location:
                self.send_header("Location", location)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_polite_fetch(spark, site):
    spark.dataSource.register(fetch.PoliteFetch)
    urls = " ".join(site + p for p in ("/page", "/moved", "/no/x", "/pdf", "/big", "/loop", "/gone")) + " ftp://h/x"
    rows = {r["url"].removeprefix(site): r for r in spark.read.format("polite_fetch").option("urls", urls).option("interval", "0").load().collect()}
    assert rows["/page"]["text"] == "café" and rows["/page"]["robots"] == "read" and rows["/page"]["requests"] == 2
    assert rows["/moved"]["final_url"] == site + "/page" and rows["/moved"]["redirects"] == [site + "/page"]
    for path, said in (("/no/x", "forbids"), ("/pdf", "content type"), ("/big", "bytes"), ("/loop", "redirects"), ("/gone", "404"), ("ftp://h/x", "http")):
        assert said in rows[path]["error"] and rows[path]["text"] is None
    (r,) = spark.read.format("polite_fetch").option("urls", site + "/json").option("accept", "json").option("interval", "0").load().collect()
    assert r["text"] == "{}"
    assert fetch.decode(b'<meta charset="utf-8">\xc3\xa9', "text/html")[0].endswith("é") and fetch.decode(b"\xff", "x; charset=nope") == ("�", "nope (undecodable, replaced)")


def test_fetching_a_table_of_urls(spark, site):
    urls = spark.createDataFrame([(site + p,) for p in ("/page", "/gone", "/page", "/moved")] + [(None,)], "url string")
    rows = {r["url"].removeprefix(site): r for r in fetch.fetched(urls, interval=0.0).collect()}
    assert set(rows) == {"/page", "/gone", "/moved"} and rows["/page"]["text"] == "café" and rows["/moved"]["redirects"] == [site + "/page"]
    # One task asked for all: the robots file once, then four pages.
    assert max(r["requests"] for r in rows.values()) == sum(r["taken"] for r in rows.values()) == 5


def test_draws_resume(spark, tmp_path):
    at = str(tmp_path / "draw")
    pages = draws.start(spark, at, corpus=50, size=6, seed=3)
    drawn = sorted(r["page"] for r in pages.collect())
    assert drawn == survey.draw_pages(50, 6, 3) and draws.remaining(spark, at, pages).count() == 6
    assert sorted(r["page"] for r in draws.start(spark, at, corpus=99, size=6, seed=3).collect()) == drawn
    with pytest.raises(ValueError, match="seed 3"):
        draws.start(spark, at, corpus=50, size=6, seed=4)
    urls = draws.page_urls(pages, "https://r.example", "c").persist()
    assert urls.where(f"page = {drawn[0]}").collect()[0]["url"] == f"https://r.example/c/envelopes?page={drawn[0]}&per_page=1"
    body = json.dumps([{"envelope_type": "resource_data", "envelope_ceterms_ctid": "ce-1", "decoded_resource": {"@id": "x"}, "published_by": "p"}])
    answer = lambda page, text, error: (urls.where(f"page = {page}").collect()[0]["url"], text, error, 1)
    kind = "url string, text string, error string, taken int"
    draws.record(at, urls, spark.createDataFrame([answer(drawn[0], body, None), answer(drawn[1], "[]", None)], kind))
    draws.record(at, urls, spark.createDataFrame([answer(drawn[2], None, "timed out")], kind))
    assert sorted(r["page"] for r in draws.remaining(spark, at, pages).collect()) == drawn[3:]
    assert draws.tally(spark, at, 2, 1) == {"recorded": 3, "pages_failed": 2, "implied": 7}
    rows = {r["page"]: r for r in draws.envelopes(spark, at, pages).collect()}
    assert (rows[drawn[0]]["ctid"], rows[drawn[0]]["publisher"], json.loads(rows[drawn[0]]["resource"])) == ("ce-1", "p", {"@id": "x"})
    assert [rows[p]["failure"] for p in drawn[:4]] == [None, "empty-page", "timed out", "neither an envelope nor a failure was kept"]


def test_earlier_evidence_must_agree(spark, tmp_path):
    access = {"corpus_envelopes": 50, "pages_drawn": 6, "seed": 3, "robots": "read", "failed": 0}
    cached = spark.createDataFrame([(p,) for p in survey.draw_pages(50, 6, 3)], "page int")
    assert draws.carried_over(spark, str(tmp_path / "a"), access, cached, "e.json").count() == 6
    with pytest.raises(ValueError, match="not the draw"):
        draws.carried_over(spark, str(tmp_path / "b"), access, cached.limit(5), "e.json")
    with pytest.raises(ValueError, match="does not name"):
        draws.carried_over(spark, str(tmp_path / "c"), {**access, "failed": 2}, cached, "e.json")


def test_evidence(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestar.operators import reports

    docs = spark.createDataFrame([("a", "alone", "T"), ("b", "alone", None), ("a", "resolved", "T"), ("b", "resolved", None)], "doc_id string, pass string, type string")
    found = spark.createDataFrame([("a", "CTID_MALFORMED", "ERROR", "_:a", "ceterms:ctid", "é x", "m")], "doc_id string, code string, severity string, entity string, property string, value string, message string")
    rows = survey.summarize(found)
    (r,) = rows.collect()
    assert r["example"].asDict() == {"severity": "ERROR", "entity": "_:a", "property": "ceterms:ctid", "value": "<withheld: 3 characters>"}
    rolled = survey.roll_up(docs, rows.withColumn("pass", F.lit("alone")))
    left_out = spark.createDataFrame([(1, "no-document"), (2, None)], "page int, reason string")
    out = reports.survey_evidence(rolled, docs.where("pass = 'alone'"), left_out, {"seed": 1}, {"supplied_documents": 0})
    assert out["rollup_alone"] == {"documents": 2, "documents_with_no_findings": 1, "documents_with_at_least_one_error": 1, "severities": {"ERROR": 1}, "codes": {"CTID_MALFORMED": 1}}
    assert out["by_type"]["None"]["alone"]["documents"] == 1 and (out["sampled"], out["excluded"], out["excluded_by_reason"]) == (2, 1, {"no-document": 1})
    reports.write_evidence(str(tmp_path / "e"), out, documents=rows, exclusions=left_out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "e/summary").glob("part-*")))
    assert text == json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    (line,) = [x for p in (tmp_path / "e/documents").glob("part-*") for x in p.read_text().splitlines()]
    assert list(json.loads(line)) == sorted(json.loads(line)) and json.loads(line)["n"] == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ceterms:ctid": "x"}')
    for _ in range(2):
        q = validate_stream(stream_documents(spark, str(tmp_path / "in")), mini(), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        (tmp_path / "in/b.json").write_text('{"ceterms:ctid": "y"}')
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["value"], r["batch"]) for r in found) == [("x", 0), ("y", 1)]


def test_command_line(spark, tmp_path, capsys):
    from lodestar.__main__ import main

    encoding, context = files()
    for n, d in (("v/e.json", encoding), ("v/c.json", context), ("in/a.json", {"ceterms:ctid": "x"}), ("ok/a.json", {"@type": "ceterms:Course"})):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(json.dumps(d))
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.html").write_text('<div itemscope itemtype="https://schema.org/Course"><b itemprop="name">N</b></div>')
    vocab = ["--encoding", str(tmp_path / "v/e.json"), "--context", str(tmp_path / "v/c.json")]
    assert main(["validate", str(tmp_path / "in"), *vocab]) == 1 and "CTID_MALFORMED" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "ok"), *vocab, "--format", "json"]) == 0
    (tmp_path / "ok/b.json").write_text("{")
    assert main(["validate", str(tmp_path / "ok"), *vocab]) == 2
    assert main(["validate", str(tmp_path / "in"), *vocab, "--resolve", str(tmp_path / "ok")]) == 2
    capsys.readouterr()
    assert main(["extract", str(tmp_path / "p"), *vocab, "--url", "https://e.example/", "--validate"]) == 0
    assert "1 entity" in capsys.readouterr().out


def test_screened_neighbours(spark):
    from lodestar.operators.checks import screened

    docs = spark.createDataFrame([("a", "{}"), ("b", "{")], "doc_id string, raw string")
    kept, refused = screened(docs, mini())
    assert [r["doc_id"] for r in kept.collect()] == ["a"] and [r["doc_id"] for r in refused.collect()] == ["b"]


def test_identifier_functions(spark):
    u = "0f6d1c1e-52a3-4c7b-9a01-aa00bb11cc01"
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in (f"ce-{u}", u, "ce-x", "https://credentialengineregistry.org/resources/a", "https://credentialengineregistry.org:80/resources/a", "a+b:x", "_:x", "https://a.b/c d?e")], "v string")
    v = F.col("v")
    got = [tuple(r) for r in rows.select(I.is_ctid_strict(v), I.is_bare_uuid(v), I.registry_tail(v), I.is_registry_resource(v), I.is_absolute_iri(v), I.origin_of(v)).collect()]
    assert got[0][:2] == (True, False) and got[1][:2] == (False, True) and got[3][2:4] == ("a", True) and got[4][2:4] == (None, False)
    assert [g[4] for g in got[5:]] == [False, False, True] and got[7][5] == "https://a.b"
    assert rows.where("v LIKE 'https://a.b%'").select(I.saved_name(v)).collect()[0][0] == "a.b__c d.html"
    six = spark.range(1).select(I.abbreviate(F.array(*(F.lit(x) for x in "gfedcba"))).alias("x")).collect()[0][0]
    assert six == "a, b, c, d, e, f, ... (7 classes total)"
    assert spark.range(1).select(I.cache_name(F.lit("https://h/resources/ce-1"))).collect()[0][0] == "ce-1.json"


def test_survey_edges(spark):
    rows = spark.createDataFrame([(3, None, True, "a", True, True), (1, None, True, "a", True, False), (2, "timed out", True, "a", True, True), (4, "empty-page", False, None, False, False), (5, None, False, "b", True, True), (6, None, True, "b", False, True), (7, None, True, "c", True, True)], "page int, failure string, is_resource boolean, ctid string, has_resource boolean, readable boolean")
    got = {r["page"]: r["reason"] for r in survey.exclusions(rows).collect()}
    assert got == {3: "duplicate-ctid", 1: "unreadable", 2: "fetch-failed", 4: "empty-page", 5: "not-resource-data", 6: "no-document", 7: None}
    assert survey.draw_pages(100, 5, 1) == survey.draw_pages(100, 5, 1) and len(survey.draw_pages(3, 5, 1)) == 3
    labels = spark.createDataFrame([(2, "x"), (1, "y"), (3, None), (4, "y")], "page int, publisher string")
    assert {r["publisher"]: r["label"] for r in survey.publisher_labels(labels).collect()} == {"y": "P001", "x": "P002"}
    many = spark.createDataFrame([(7 * i % 101, f"p{i}") for i in range(101)], "page int, publisher string")
    assert sorted(r["label"] for r in survey.publisher_labels(many, 10).collect()) == [f"P{i:03d}" for i in range(1, 102)]
    assert [r["publisher"] for r in survey.publisher_labels(many, 10).orderBy("label").limit(3).collect()] == ["p0", "p29", "p58"]
    refs = spark.createDataFrame([("b",), ("a",), ("a",)], "iri string")
    assert [r[0] for r in survey.wanted_neighbours(refs, 1).collect()] == ["a"]
    assert survey.requests(10, 5, 1, 17) == {"implied": 17, "recorded": 17}


@pytest.mark.parametrize("name", ["validate_all", "large_documents", "closure", "two_run_diff", "two_run_moves", "error_table", "code_shares", "rendered_texts", "rendered_json", "ref_resolution_supplied", "extract_notes", "extract_and_validate", "markup_survey", "rollup_by_type", "identifier_allow_list", "saved_names", "residue", "only_unverifiable", "publisher_concentration", "exclusions", "annotations"])
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "pages", "lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((key(r) for r in got.select(*cols).collect())) == sorted(map(key, want))


def test_contract_without_the_training_data_part(tmp_path):
    """The entry module, the other queries and their SQL need neither the pipeline nor its subpackage."""
    for p in ("__spark_entry__.py", "lodestar"):
        subprocess.run(["cp", "-r", str(REPO / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lodestar/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
