"""Readers of documents, pages, target lists and survey caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """doc_id (the file's path), raw, source, set_ord of JSON files.

    A directory gives its ``*.json`` one level deep, or all below it with
    ``recursive``; globs and single files are taken as they are.  ``set_ord``
    follows the order of ``paths``, and within one path the file names.
    """
    out = None
    for i, path in enumerate(paths):
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive)
        if not path.endswith(".json"):
            reader = reader.option("pathGlobFilter", "*.json")
        found = reader.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source"), F.struct(F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file")).alias("set_ord"))
        out = found if out is None else out.unionAll(found)
    if out is None:
        raise ValueError("no paths")
    return out


def saved_pages(spark: SparkSession, path: str, url_prefix: str = "") -> DataFrame:
    """page_id, url, html of saved pages."""
    p = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return p.select(name.alias("page_id"), F.concat(F.lit(url_prefix), name).alias("url"), F.col("value").alias("html"))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """category, url of a list with a tab between them; blank lines and lines that begin with # do not count."""
    lines = spark.read.text(path).select(F.btrim("value").alias("v")).where("v != '' AND NOT startswith(v, '#')")
    parts = F.split("v", "\t", 2)
    return lines.select(F.btrim(F.get(parts, F.lit(0))).alias("category"), F.btrim(F.get(parts, F.lit(1))).alias("url"))


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """page, envelope_type, ctid, type, publisher, resource (JSON or null) of cached registry pages, one envelope in each file."""
    files = spark.read.option("wholetext", True).text(path)
    get = lambda key: F.get_json_object("value", f"$.{key}")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("int").alias("page"), get("envelope_type").alias("envelope_type"), get("envelope_ceterms_ctid").alias("ctid"), get("envelope_ctdl_type").alias("type"), get("published_by").alias("publisher"), get("decoded_resource").alias("resource"))
