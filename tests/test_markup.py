"""Readers and mapping on small pages."""

import json

import pytest

from lodestar.operators import checks, mapping, markup, reports, survey
from lodestar.plans.mini_vocabulary import mini

URL = "https://example.edu/dir/p"


def ld(x, context="https://schema.org"):
    body = x if isinstance(x, str) else json.dumps({"@context": context, **x})
    return f'<script type="application/ld+json; charset=utf-8">{body}</script>'


PAGES = {
    "prose": "<p>Nothing</p>",
    "course": ld({"@type": "Course", "@id": "courses/1", "name": {"@value": "Weld", "@language": "en"}, "provider": {"@type": "Organization", "@id": "#org"}, "about": "x", "startDate": "2020"}),
    "literal": ld({"@type": "Course", "provider": "College", "name": {"@type": "Thing"}, "hasPart": {"@type": "CourseInstance"}}),
    "maps": ld({"@graph": [{"@type": "ceterms:Course", "ceterms:name": {"en": "A", "fr": ["B", "C"]}, "ceterms:ctid": "x"}]}, "https://credreg.net/ctdl/schema/context/json"),
    "array": ld('[{"@type": "Course"}]'),
    "broken": ld("{oops"),
    "micro": '<base href="/b/"><div itemscope itemtype="http://schema.org/Organization" lang="en" itemid="me"><b itemprop="name"> A  B </b><a itemprop="url" href="x">l</a><meta itemprop="legalName"><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><i itemprop="streetAddress">S</i></div></div><div itemscope><i itemprop="nick" itemref="z">n</i></div>',
    "rdfa": '<div vocab="https://schema.org/" prefix="s: https://schema.org/"><div typeof="s:Organization" resource="#o" rel="x"><span property="name description" lang="fr">N</span><a property="url" href="u">t</a><p property="address" typeof="PostalAddress"><i property="streetAddress" content="">z</i></p></div><div vocab=""><div typeof="Bare"></div></div></div>',
    "deep": "<div>" * 300,
    "implied": '<ul itemscope itemtype="https://schema.org/Organization"><li itemprop="name">a<li itemprop="description">b</ul>',
    "empty": None,
}


@pytest.fixture(scope="module")
def read(spark):
    return markup.read_pages(spark.createDataFrame([(k, URL, v) for k, v in PAGES.items()], "page_id string, url string, html string"), mini()).persist()


@pytest.fixture(scope="module")
def made(read):
    return mapping.extract(read, mini())


@pytest.fixture(scope="module")
def notes(made):
    out = {}
    for r in made.notes.orderBy("page_id", "phase", "item_ord", "pos", "sub").collect():
        out.setdefault(r["page_id"], []).append((r["code"], r["subject"], r["term"]))
    return out


@pytest.fixture(scope="module")
def graphs(made):
    return {r["page_id"]: json.loads(r["raw"])["@graph"] for r in mapping.documents(made).collect()}


def test_blocks(read):
    got = {}
    for r in mapping.blocks_of(read).collect():
        got.setdefault(r["page_id"], []).append((r["path"], r["items"], r["types"]))
    assert got["course"] == [("json-ld[0]", 2, ["schema:Course", "schema:Organization"])]
    assert got["micro"] == [("microdata", 3, ["schema:Organization", "schema:PostalAddress"])]
    assert got["rdfa"] == [("rdfa", 3, ["schema:Organization", "schema:PostalAddress"])] and got["broken"] == [("json-ld[0]", 0, [])]
    assert "prose" not in got and "deep" not in got


def test_notes(notes):
    codes = {k: [c for c, *_ in v] for k, v in notes.items()}
    assert notes["prose"] == notes["empty"] == [("NO_STRUCTURED_DATA", URL, "(page)")]
    assert codes["course"] == ["PROPERTY_NOT_MAPPED", "PROPERTY_RELATED_NOT_EQUIVALENT", "PROPERTY_RELATED_NOT_EQUIVALENT", "PROPERTY_AMBIGUOUS", "CTID_ABSENT"]
    assert codes["literal"] == ["CLASS_NOT_MAPPED", "CLASS_NOT_MAPPED", "VALUE_NOT_IDENTIFIER", "VALUE_NOT_LITERAL", "NESTED_ITEM_DROPPED", "CTID_ABSENT"]
    assert codes["broken"] == ["JSONLD_PARSE_ERROR"] and "maps" not in codes
    assert notes["array"][0] == ("JSONLD_CONTEXT_UNRESOLVED", "json-ld[0]", "(absent)")
    assert ("EMPTY_VALUE", "microdata[0].schema:legalName[2]", "(value)") in notes["micro"] and "MICRODATA_NAME_UNRESOLVED" in codes["micro"] and "MICRODATA_ITEMREF" in codes["micro"] and "ITEM_UNTYPED" in codes["micro"]
    assert ("RDFA_BEYOND_LITE", "rdfa", "rel") in notes["rdfa"] and ("RDFA_TERM_UNRESOLVED", "rdfa[1]", "Bare") in notes["rdfa"]


def test_documents(graphs):
    assert graphs["course"] == [{"@id": "https://example.edu/dir/courses/1", "@type": "ceterms:Course", "ceterms:name": {"en": "Weld"}, "ceterms:offeredBy": f"{URL}#org"}, {"@id": f"{URL}#org", "@type": "ceterms:Organization"}]
    assert graphs["maps"][0]["ceterms:name"] == {"en": "A", "fr": ["B", "C"]}
    micro = graphs["micro"]
    assert micro[0]["@id"] == "https://example.edu/b/me" and micro[0]["ceterms:name"] == {"en": "A B"} and micro[0]["ceterms:subjectWebpage"] == "https://example.edu/b/x" and micro[0]["ceterms:address"] == micro[1]["@id"] == "_:n1"
    assert graphs["rdfa"][0]["ceterms:name"] == {"fr": "N"} and graphs["rdfa"][0]["ceterms:description"] == {"fr": "N"} and graphs["rdfa"][1] == {"@id": "_:n1", "@type": "ceterms:PostalAddress"}
    assert graphs["implied"][0]["ceterms:name"] == "a" and graphs["implied"][0]["ceterms:description"] == "b"
    assert graphs["literal"] == [{"@id": "_:n0", "@type": "ceterms:Course"}]


def test_exit_codes(read, made):
    got = {r["page_id"]: r["exit_code"] for r in mapping.exit_codes(read, made).collect()}
    assert got["course"] == 0 and got["prose"] == 1 and got["deep"] == 2


def test_extracts_can_fail_checks(spark, made):
    raw = mapping.documents(made).where("page_id = 'micro'").withColumnRenamed("page_id", "doc_id")
    found = checks.validate(checks.session(raw, mini())).collect()
    assert [(r["code"], r["property"]) for r in found if r["severity"] == "ERROR"] == [("RANGE_VIOLATION", "ceterms:address")]


def test_summaries(read, made):
    raw = mapping.documents(made).withColumnRenamed("page_id", "doc_id")
    found = checks.validate(checks.session(raw, mini()))
    summary = survey.markup_summary(read, made.entities, made.notes, found)
    s = {(r["measure"], r["key"]): r["n"] for r in summary.collect()}
    assert s[("format", "json-ld")] == 5 and s[("pages", "targets")] == len(PAGES) and s[("pages", "read")] == len(PAGES) - 1 and s[("pages", "not_read")] == 1
    assert s[("pages", "published_structured_data")] == 8 and s[("pages", "produced_ctdl_entities")] == 6
    wrong = {r["doc_id"] for r in found.collect() if r["severity"] == "ERROR"}
    assert s[("pages", "extracts_with_no_validation_errors")] == 6 - len(wrong) and s[("finding", "RANGE_VIOLATION")] >= 1 and "micro" in wrong
    evidence = reports.markup_evidence(summary)
    assert evidence["targets"] == len(PAGES) and evidence["formats"]["json-ld"] == 5 and evidence["validation_codes"]["RANGE_VIOLATION"] >= 1
    p = {r["page_id"]: r for r in survey.page_summary(read, made.entities, made.notes).collect()}
    assert p["course"]["classes"] == ["ceterms:Course", "ceterms:Organization"] and p["course"]["dropped"] == ["schema:about", "schema:startDate"] and p["deep"]["warnings"] == 0


def test_reports(read, made):
    rows = {r["page_id"]: r for r in reports.rendered(read, made).collect()}
    assert "deep" not in rows and len(rows) == len(PAGES) - 1
    fetched = read.sparkSession.createDataFrame([(URL, URL, 200, "text/html", "utf-8", 9, [], "read", "x")], "url string, final_url string, status int, content_type string, encoding string, bytes long, redirects array<string>, robots string, text string")
    one = json.loads(reports.rendered(read.where("page_id = 'course'"), made, fetched=fetched).collect()[0]["json"])
    assert one["fetch"] == {"requested_url": URL, "final_url": URL, "status": 200, "content_type": "text/html", "encoding": "utf-8", "bytes": 9, "redirects": [], "robots": "read"}
    assert all(n["rule"]["url"] != "-" for n in one["notes"])
    course = json.loads(rows["course"]["json"])
    assert course["fetch"] is None and course["tool"]["command"] == "extract"
    assert course["summary"] == {"entities": 2, "WARNING": 2, "INFO": 3} and course["source"] == URL and course["notes"][0]["rule"]["citation"]
    assert rows["course"]["text"].endswith("2 entities, 2 WARNING, 3 INFO") and json.loads(rows["prose"]["json"])["document"]["@graph"] == []


def pages(spark, **htmls):
    return {r["page_id"]: r.asDict(True) for r in markup.read_pages(spark.createDataFrame([(k, URL, v) for k, v in htmls.items()], "page_id string, url string, html string"), mini()).collect()}


def test_deep_items_need_no_recursion(spark):
    """Items inside items, as deep as elements may nest, and text below many elements."""
    depth = 190
    html = "".join(f'<i itemscope itemtype="https://schema.org/T{i}" {"itemprop=about" if i else ""}>' for i in range(depth)) + "x"
    got = pages(spark, deep=html, wide='<p itemscope itemtype="https://schema.org/T"><b itemprop="name">' + "<br>a" * 50_000 + "</b></p>")
    page = got["deep"]
    assert len(page["items"]) == depth and [i["ord"] for i in page["items"]] == list(range(depth)) and page["items"][-1]["path"].count(".schema:about[0]") == depth - 1
    assert got["wide"]["items"][0]["props"][0]["text"].count("a") == 50_000


def test_positions_count_values_of_the_element_around(spark):
    html = '<p itemscope itemtype="https://schema.org/T"><b itemprop="a c">1</b><i><u itemprop="d"></u><u itemprop="e">2</u></i><b itemprop="f"></b></p>'
    notes = pages(spark, p=html)["p"]["notes"]
    assert [n["subject"] for n in notes] == ["microdata[0].schema:d[0]", "microdata[0].schema:f[3]"]


def test_an_item_given_to_two_terms_is_met_twice(spark):
    html = '<p itemscope itemtype="https://schema.org/T"><b itemprop="a c" itemscope><i itemprop="https://schema.org/x" itemscope></i></b><b itemprop="https://schema.org/d">t</b></p>'
    items = pages(spark, p=html)["p"]["items"]
    assert [(i["path"], i["label"]) for i in items] == [("microdata[0]", "_:n0")] + [(f"microdata[0].schema:a[0]{more}", f"_:n{n}") for n, more in enumerate(["", ".schema:x[0]"] * 2, 1)]
    assert [(v["pos"], v["term"], v["child"], v["text"]) for v in items[0]["props"]] == [(0, "schema:a", "microdata[0].schema:a[0]", None), (1, "schema:c", "microdata[0].schema:a[0]", None), (2, "schema:d", None, "t")]
    many = '<b itemprop="https://a.b/1 https://a.b/2" itemscope>' * 20
    assert "met more than" in pages(spark, p="<p itemscope>" + many)["p"]["error"]


def test_contexts_are_joined(spark):
    """The last entry of a key counts; names that no context explains are not read, nor what hangs from them."""
    context = ["https://schema.org", {"p": "http://a.b/"}, {"p": "http://c.d/", "t": {"@id": "schema:description"}, "@language": "en"}, {"@vocab": "http://e.f/"}]
    page = pages(
        spark,
        known=ld({"@type": ["p:X", "Y"], "p:q": "1", "t": ["2", {"@value": "3", "@language": "fr"}], "z": {"@type": "Z"}}, context),
        unknown=ld({"name": "n", "about": {"@id": "u", "schema:name": "m"}, "schema:about": [{"x": {"schema:name": "l"}}, {"schema:name": 4}]}, {"@vocab": None}),
    )
    known = page["known"]["items"]
    assert [(i["path"], i["types"]) for i in known] == [("json-ld[0]", ["http://c.d/X", "http://e.f/Y"]), ("json-ld[0].http://e.f/z[0]", ["http://e.f/Z"])]
    assert [(v["term"], v["text"], v["language"]) for v in known[0]["props"]] == [("http://c.d/q", "1", "en"), ("schema:description", "2", "en"), ("schema:description", "3", "fr"), ("http://e.f/z", None, None)]
    assert [i["path"] for i in page["unknown"]["items"]] == ["json-ld[0]", "json-ld[0].schema:about[0]", "json-ld[0].schema:about[1]"] and page["unknown"]["items"][2]["props"][0]["text"] == "4"
    assert [(n["code"], n["term"]) for n in page["unknown"]["notes"]] == [("JSONLD_CONTEXT_UNRESOLVED", '{"@vocab": null}')]


def test_a_page_of_many_items(spark):
    html = '<div itemscope itemtype="https://schema.org/T">' + "".join(f'<b itemprop="name">{i}</b>' for i in range(3000)) + "</div>"
    (item,) = pages(spark, p=html, q=None)["p"]["items"]
    assert [v["text"] for v in item["props"]] == [str(i) for i in range(3000)] and [v["pos"] for v in item["props"]] == list(range(3000))


def test_paragraphs_left_open_are_no_depth(spark):
    """As in the pages at hand: `<p><b>` that is never closed, hundreds of times in a long page."""
    open_ = "<p><b>a<br>" * 300 + "</i>"
    item = '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">College</span></div>'
    got = pages(spark, before=open_ + item, around=item.replace("College", open_), within=open_ + "<div>" * 300, items=item[:-6] + '<b itemprop="about" itemscope>' * 300)
    assert [(i["path"], [(v["term"], v["text"]) for v in i["props"]]) for i in got["before"]["items"]] == [("microdata[0]", [("schema:name", "College")])]
    assert got["around"]["items"][0]["props"][0]["text"] == "a" * 300
    assert all(got[k]["error"].startswith("MarkupError") and not got[k]["items"] for k in ("within", "items"))
