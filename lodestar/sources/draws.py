"""Draws of registry pages, and of what they refer to, that can be resumed.

A draw is a folder with two tables: ``draw`` (one row) and ``attempts``, to which
each run appends what it fetched or failed to fetch, with the requests that this
took.  A page that was tried is not tried again, whether or not it failed, and no
run loses the count of an earlier one.  The data source of ``registry_pages`` keeps its draw and
its answers as files in such a folder; they are read as these tables are.

The second phase asks for the registry resources that the pages name, up to a cap:
``wanted`` (each IRI, with the cap) and ``neighbours`` (each attempt) lie beside the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.identifiers import cache_name
from ..operators import survey
from ..operators.survey import draw_pages
from . import registry_pages
from .fetch import fetched

DRAW = "seed long, size int, corpus long, robots string, carried_from string, pages array<int>"
ATTEMPTS = registry_pages.PAGE
WANTED = "iri string, cap int"
NEIGHBOURS = "iri string, failure string, document string, requests int"
#: Neighbours that are asked for before what came is written.
NEIGHBOUR_BATCH = 100


def _saved(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def start(spark: SparkSession, path: str, *, corpus: int, size: int, seed: int, robots: str = "read", carried_from: str | None = None) -> DataFrame:
    """page of every page drawn; an earlier draw in the folder stands, and is refused if its seed or size is another."""
    earlier = _earlier(spark, path)
    if earlier is None:
        earlier = {"seed": seed, "size": size, "pages": draw_pages(corpus, size, seed)}
        row = (seed, size, corpus, robots, carried_from, earlier["pages"])
        spark.createDataFrame([row], DRAW).coalesce(1).write.parquet(f"{path}/draw")
    elif (earlier["seed"], earlier["size"]) != (seed, size):
        raise ValueError(f"{path} holds a draw of seed {earlier['seed']} and size {earlier['size']}")
    return spark.createDataFrame([(p,) for p in earlier["pages"]], "page int")


def _earlier(spark: SparkSession, path: str) -> dict | None:
    """The draw that a folder holds, as a table or as the data source keeps it."""
    rows = _saved(spark, f"{path}/draw", DRAW).collect()
    return rows[0].asDict() if rows else registry_pages.draw_of(spark, path)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    return _saved(spark, f"{path}/attempts", ATTEMPTS).unionAll(_saved(spark, f"{path}/pages", ATTEMPTS, "json"))


def draw_of(spark: SparkSession, path: str) -> dict:
    """The draw of a folder as one object, with the requests that sizing the corpus took (one, where that was not counted)."""
    found = _earlier(spark, path)
    if found is None:
        raise ValueError(f"{path} holds no draw")
    return {"requests": 1} | found


def drawn_pages(spark: SparkSession, path: str) -> DataFrame:
    """page of every page drawn."""
    return spark.createDataFrame([(p,) for p in draw_of(spark, path)["pages"]], "page int")


def remaining(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """The pages of a draw that no run has tried."""
    return pages.join(attempts(spark, path).select("page"), "page", "left_anti")


def page_urls(pages: DataFrame, registry: str, community: str) -> DataFrame:
    """page, url of the request for the one envelope on each page."""
    return pages.select("page", F.concat(F.lit(f"{registry}/{community}/envelopes?page="), F.col("page").cast("string"), F.lit("&per_page=1")).alias("url"))


def record(path: str, urls: DataFrame, answers: DataFrame) -> None:
    """Append what fetching ``urls`` (page, url) gave (rows of the fetcher); a page without an envelope fails as ``empty-page``."""
    first = F.get_json_object("text", "$[0]")
    rows = answers.join(urls, "url").select("page", F.coalesce("error", F.when(first.isNull() | ~first.startswith("{"), "empty-page")).alias("failure"), first.alias("envelope"), "taken")
    rows.select("page", "failure", F.when(F.col("failure").isNull(), F.col("envelope")).alias("envelope"), F.col("taken").alias("requests")).write.mode("append").parquet(f"{path}/attempts")


def envelopes(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """page, failure, envelope_type, ctid, type, publisher, resource of every page drawn; a page never tried has a failure too."""
    get = lambda key: F.get_json_object("envelope", f"$.{key}")
    met = pages.join(attempts(spark, path).withColumn("tried", F.lit(True)), "page", "left")
    failure = F.when(F.col("tried").isNull(), "neither an envelope nor a failure was kept").otherwise(F.col("failure"))
    return met.select("page", failure.alias("failure"), get("envelope_type").alias("envelope_type"), get("envelope_ceterms_ctid").alias("ctid"), get("envelope_ctdl_type").alias("type"), get("published_by").alias("publisher"), get("decoded_resource").alias("resource"))


def tally(spark: SparkSession, path: str, neighbours_fetched: int = 0, neighbours_failed: int = 0) -> dict[str, int]:
    """Requests recorded by all runs, and those that what they left behind implies at least."""
    row = attempts(spark, path).agg(F.sum("requests").alias("recorded"), F.count("*").alias("pages"), F.count("failure").alias("failed")).collect()[0]
    return {"recorded": int(row["recorded"] or 0), "pages_failed": row["failed"], "implied": row["pages"] + neighbours_fetched + neighbours_failed + 1}


def carried_over(spark: SparkSession, path: str, access: dict, cached: DataFrame, name: str) -> DataFrame:
    """A draw for pages (page) that were cached before draws were recorded, from the ``access`` block of earlier evidence.

    Refused if the pages are not those that its seed draws, or if it counts
    neighbours that failed without naming them.
    """
    drawn = spark.createDataFrame([(p,) for p in draw_pages(access["corpus_envelopes"], access["pages_drawn"], access["seed"])], "page int")
    if cached.exceptAll(drawn).limit(1).count() or drawn.exceptAll(cached.select(F.col("page").cast("int"))).limit(1).count():
        raise ValueError(f"the cached pages are not the draw that {name} describes")
    if access.get("failed"):
        raise ValueError(f"{name} counts {access['failed']} neighbours that failed and does not name them")
    return start(spark, path, corpus=access["corpus_envelopes"], size=access["pages_drawn"], seed=access["seed"], robots=access.get("robots", "read"), carried_from=name)


def want_neighbours(spark: SparkSession, path: str, references: DataFrame, cap: int) -> DataFrame:
    """iri, cap: the first ``cap`` of the IRIs (iri) in order, noted in the folder; a later call with another cap replaces them."""
    survey.wanted_neighbours(references, cap).select("iri", F.lit(cap).alias("cap")).coalesce(1).write.mode("overwrite").parquet(f"{path}/wanted")
    return _saved(spark, f"{path}/wanted", WANTED)


def neighbour_attempts(spark: SparkSession, path: str) -> DataFrame:
    return _saved(spark, f"{path}/neighbours", NEIGHBOURS)


def fetch_neighbours(spark: SparkSession, path: str, references: DataFrame, cap: int, *, batch: int = NEIGHBOUR_BATCH, **polite) -> DataFrame:
    """Ask for the wanted IRIs that no run has asked for, some at a time, and append what came; failures are kept by IRI and not tried again."""
    wanted = want_neighbours(spark, path, references, cap).select("iri")
    while True:
        some = wanted.join(neighbour_attempts(spark, path).select("iri"), "iri", "left_anti").orderBy("iri").limit(batch).select(F.col("iri").alias("url"))
        came = fetched(some, accept="json", **polite)
        if not came.limit(1).count():
            return neighbour_attempts(spark, path)
        came.select(F.col("url").alias("iri"), F.col("error").alias("failure"), F.col("text").alias("document"), F.col("taken").alias("requests")).write.mode("append").parquet(f"{path}/neighbours")


def supplied_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, raw, source, set_ord of the neighbours that came, in the order of their names; what ``checks.screened`` takes."""
    came = neighbour_attempts(spark, path).where("failure IS NULL")
    return came.select(F.col("iri").alias("doc_id"), F.col("document").alias("raw"), cache_name(F.col("iri")).alias("source"), F.struct(cache_name(F.col("iri")), "iri").alias("set_ord"))


def access(spark: SparkSession, path: str, references: DataFrame, *, from_cache: bool) -> dict:
    """How a survey came by its documents: the draw, its failures, its neighbours among ``references`` (iri), and its requests.

    ``recorded`` requests are those that were counted; ``implied_by_the_cache`` is what
    the folder cannot have cost less than: one for each document and each failure, and one for the size of the corpus.
    """
    draw, tried = draw_of(spark, path), neighbour_attempts(spark, path)
    pages = attempts(spark, path).agg(F.sum("requests").alias("requests"), F.count("*").alias("pages"), F.count("failure").alias("failed")).first()
    cap = _saved(spark, f"{path}/wanted", WANTED).agg(F.max("cap")).first()[0]
    near = survey.neighbours(references, tried.select("iri", F.col("failure").isNull().alias("ok"))).first()
    spent = tried.agg(F.sum("requests")).first()[0] or 0
    return {
        "from_cache": from_cache, "corpus_envelopes": draw["corpus"], "robots": draw["robots"], "seed": draw["seed"], "pages_drawn": len(draw["pages"]), "pages_failed": pages["failed"],
        "requests": {"recorded": draw["requests"] + (pages["requests"] or 0) + spent, "implied_by_the_cache": pages["pages"] + near["fetched"] + near["failed"] + 1},
        "neighbours": {"referenced": near["referenced"], "cap": cap, "fetched": near["fetched"], "failed": near["failed"], "unresolved": near["unresolved"]},
        "carried_from": draw["carried_from"],
    }
