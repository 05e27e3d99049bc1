"""A draw from a local registry: read, killed and resumed, with its neighbours and its evidence."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_frontier import Site

from lodestar.operators import checks, reports, survey
from lodestar.plans.mini_vocabulary import mini
from lodestar.sources import draws, registry_pages

R = "https://credentialengineregistry.org/resources/"
CORPUS, SIZE, SEED = 40, 12, 4


@pytest.fixture
def site():
    s = Site()
    s.robots = (404, "")
    s.pages["/c/envelopes?page=1&per_page=1&metadata_only=true"] = (200, "application/json", "[]", {"X-Total": str(CORPUS)})
    for page in range(1, CORPUS + 1):
        body = [{"envelope_type": "resource_data", "envelope_ceterms_ctid": f"ce-{page}", "published_by": "p", "decoded_resource": {"@id": f"{R}{page}", "@type": "ceterms:Certification", "ceterms:ownedBy": f"{s.url}/n/{page % 4}"}}]
        s.pages[f"/c/envelopes?page={page}&per_page=1"] = (200, "application/json", json.dumps([] if page % 7 == 0 else body))
    s.pages["/n/0"] = s.pages["/n/1"] = (200, "application/json", "{}")
    yield s
    s.server.shutdown()


def source(reader, site, path, **more):
    options = {"path": str(path), "registry": site.url, "community": "c", "seed": SEED, "size": SIZE, "interval": 0, **more}
    return reader.format("registry_pages").options(**{k: str(v) for k, v in options.items()}).load()


def pages_asked(site):
    return Counter(p for _, p in site.asked if "metadata" not in p and "page=" in p)


def test_batch_read_asks_for_each_page_once(spark, site, tmp_path):
    spark.dataSource.register(registry_pages.RegistryPages)
    for _ in range(2):
        rows = {r["page"]: r for r in source(spark.read, site, tmp_path / "d").collect()}
    want = survey.draw_pages(CORPUS, SIZE, SEED)
    assert sorted(rows) == want and set(pages_asked(site).values()) == {1} and len(pages_asked(site)) == SIZE
    assert all((r["failure"] == "empty-page") == (p % 7 == 0) and (r["envelope"] is None) == (p % 7 == 0) for p, r in rows.items())
    draw = draws.draw_of(spark, str(tmp_path / "d"))
    assert (draw["corpus"], draw["pages"], draw["robots"]) == (CORPUS, want, "absent")
    tallied = draws.access(spark, str(tmp_path / "d"), spark.createDataFrame([], "iri string"), from_cache=True)["requests"]
    assert tallied == {"recorded": len(site.asked), "implied_by_the_cache": SIZE + 1}
    with pytest.raises(Exception, match=f"holds a draw of seed {SEED}"):
        source(spark.read, site, tmp_path / "d", seed=SEED + 1).collect()
    assert sorted(r["page"] for r in draws.start(spark, str(tmp_path / "d"), corpus=999, size=SIZE, seed=SEED).collect()) == want
    assert draws.remaining(spark, str(tmp_path / "d"), draws.drawn_pages(spark, str(tmp_path / "d"))).count() == 0
    site.pages["/c/envelopes?page=1&per_page=1&metadata_only=true"] = (200, "application/json", "[]")
    with pytest.raises(Exception, match="X-Total"):
        source(spark.read, site, tmp_path / "other").collect()


def test_stream_that_is_killed_and_started_again(spark, site, tmp_path):
    spark.dataSource.register(registry_pages.RegistryPages)
    seen = []

    def run(fail_at):
        def each(batch, number):
            pages = [r["page"] for r in batch.collect()]
            if number == fail_at:
                raise RuntimeError("killed")
            seen.append((number, pages))

        q = source(spark.readStream, site, tmp_path / "d", batch=5).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run(1)
    assert [n for n, _ in seen] == [0]
    asked = pages_asked(site)
    assert set(asked.values()) == {1} and len(asked) == 10
    run(None)
    assert pages_asked(site) == Counter({f"/c/envelopes?page={p}&per_page=1": 1 for p in survey.draw_pages(CORPUS, SIZE, SEED)})
    assert [(n, len(p)) for n, p in seen] == [(0, 5), (1, 5), (2, 2)] and sorted(p for _, ps in seen for p in ps) == survey.draw_pages(CORPUS, SIZE, SEED)
    tallied = draws.access(spark, str(tmp_path / "d"), spark.createDataFrame([], "iri string"), from_cache=False)["requests"]["recorded"]
    robots = sum(p == "/robots.txt" for _, p in site.asked)
    assert tallied == len(site.asked) == SIZE + 1 + robots


def test_neighbours_and_evidence_of_a_draw(spark, site, tmp_path):
    spark.dataSource.register(registry_pages.RegistryPages)
    at = str(tmp_path / "d")
    source(spark.read, site, at).write.format("noop").mode("overwrite").save()
    pages = draws.drawn_pages(spark, at)
    got = draws.envelopes(spark, at, pages).persist()
    kept = survey.exclusions(got.select("page", "failure", (F.col("envelope_type") == "resource_data").alias("is_resource"), "ctid", F.col("resource").isNotNull().alias("has_resource"), F.lit(True).alias("readable")))
    docs = got.join(kept.where("reason IS NULL").select("page"), "page").select(F.col("page").cast("string").alias("doc_id"), F.col("resource").alias("raw"), F.lit("T").alias("type")).persist()
    alone = checks.validate(checks.session(docs, mini())).persist()
    refs = alone.where("code = 'REF_OUTSIDE_PAYLOAD'").select(F.col("value").alias("iri")).distinct()
    n = len(site.asked)
    for batch in (2, 100):
        came = {r["iri"].removeprefix(site.url): r["failure"] for r in draws.fetch_neighbours(spark, at, refs, 3, batch=batch, interval=0.0).collect()}
    assert set(came) == {"/n/0", "/n/1", "/n/2"} and came["/n/0"] is None and "404" in came["/n/2"]
    assert Counter(p for _, p in site.asked[n:] if p != "/robots.txt") == Counter(list(came))
    beside, refused = checks.screened(draws.supplied_documents(spark, at), mini())
    access = draws.access(spark, at, refs, from_cache=False)
    assert access["neighbours"] == {"referenced": 4, "cap": 3, "fetched": 2, "failed": 1, "unresolved": 1} and access["requests"]["recorded"] == len(site.asked) and access["pages_failed"] == sum(p % 7 == 0 for p in survey.draw_pages(CORPUS, SIZE, SEED))
    s = checks.session(docs, mini(), beside)
    both = survey.summarize(alone).withColumn("pass", F.lit("alone")).unionAll(survey.summarize(checks.validate(s)).withColumn("pass", F.lit("resolved")))
    rolled = survey.roll_up(docs.select("doc_id", "type", F.explode(F.array(F.lit("alone"), F.lit("resolved"))).alias("pass")), both)
    out = reports.survey_evidence(rolled, docs, kept, access, reports.supplied_counts(beside, s.supplied, refused), registry=site.url, community="c")
    assert set(out) == {"tool", "registry", "community", "protocol", "access", "sampled", "excluded", "excluded_by_reason", "supplied_documents", "supplied_entities", "supplied_rejected", "rollup_alone", "rollup_resolved", "by_type"}
    assert out["sampled"] + out["excluded"] == SIZE and out["excluded_by_reason"] == {"empty-page": access["pages_failed"]} and (out["supplied_documents"], out["supplied_rejected"]) == (2, 0)
    assert set(out["protocol"]) == {"frame", "draw", "resolve", "exclusion_reasons"} and len(out["protocol"]["exclusion_reasons"]) == 6
    where = tmp_path / "e"
    reports.write_evidence(str(where), out, documents=docs.repartition(3), exclusions=kept.where("reason IS NOT NULL"))
    assert json.loads((where / "summary/part-00000.json").read_text()) == out
    assert spark.read.json(str(where / "documents")).count() == out["sampled"] and spark.read.json(str(where / "exclusions")).count() == out["excluded"]
    assert sorted(p.name for p in where.iterdir()) == ["documents", "exclusions", "summary"]
    with pytest.raises(Exception, match="holds evidence already"):
        reports.write_evidence(str(where), out, documents=docs)
    assert spark.read.json(str(where / "documents")).count() == out["sampled"] and sorted(p.name for p in where.iterdir()) == ["documents", "exclusions", "summary"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    where = tmp_path / "e"
    rows = spark.range(2000).select("id", F.when(F.col("id") == 1999, F.raise_error(F.lit("broken"))).otherwise("x").alias("x"))
    with pytest.raises(Exception, match="broken"):
        reports.write_evidence(str(where), {"a": 1}, documents=rows.repartition(3), others=spark.range(5))
    assert not [p for p in where.rglob("*") if p.is_file()] and not [p for p in where.rglob("_drafts*")]
