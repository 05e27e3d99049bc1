"""Sharding by vector bin packing (operator 13); its law is ``bytes``.

Documents of one text are a group and stay together.  A group's vector is its share
of all bytes, tokens and rows, measured in shards; groups are placed by
decreasing largest component, each where the dot product with the residual capacity is
highest among the shards whose bytes have room for it (the one with most bytes left, if
none has).  Bytes come first because they are the law: a shard of one giant text
would else be filled up with short ones for the sake of its rows.

What is placed one by one is bounded, whatever the input: groups that hold a
``LARGE``-th of a shard or more in some component (at most 3 * LARGE * shards), and
the rest in at most ``BUNDLES`` bundles by the hash of the text, each a group of
groups that together weigh little.  With fewer texts than bundles nearly every text is
placed by itself.  A group that no shard can hold (a third of all rows may share a
text) is dealt into ``PARTS`` parts by doc_id, at most 3 * shards groups; these parts are placed
like others, by their measured sizes.

Slots number a shard's rows: rows are numbered in cells of bounded size by doc_id,
and cells start where the counts of those before them end, so no task holds a shard
and a hot text is in many cells.

Defined results: a null text has no bytes (size 1) and is in the group of the empty
text; a null doc_id is an id of its own and numbers first; repeated rows have a slot each;
a very long text is one group, however much more it holds than others, as texts are not
cut; ties of the dot product go to the lowest shard, and rows that tie in doc_id and
text share their slots in any order; columns of ``docs`` other than doc_id and text are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

SHARDS = 16
#: Groups of a LARGE-th of a shard are placed by themselves; bundles of the others; parts of a group that exceeds a shard.
LARGE, BUNDLES, PARTS = 256, 1 << 16, 1024
#: How much more bytes than its share a shard may take while others have room.
SLACK = 0.001
#: Rows that are numbered in one cell, about.
CELL_ROWS = 20_000
MEASURES = ("size", "tokens", "rows")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and text_key of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A mark for each word, then what is left beside the marks is dropped: no array of words.
    tokens = F.length(F.regexp_replace(F.regexp_replace("text", WORD, "x"), r"[\x20\x09-\x0D]+", ""))
    return slim.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("text_key"))


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (shares of a shard in bytes, tokens and rows); vectors come in the order of placing."""
    left, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i, v in enumerate(vectors):
        room = left[:, 0] + SLACK >= v[0]
        at = int(np.argmax(np.where(room, left @ v, -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        left[at] -= v
        out[i] = at
    return out


def _sums() -> list[Column]:
    return [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def _bundle() -> Column:
    return F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES)).cast("int")


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(PARTS)).cast("int")


def assignment(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` of ``measured``, written, with their shard."""
    spark = rows.sparkSession
    total = rows.agg(*_sums()).first()
    if not total["rows"]:
        return rows.withColumn("shard", F.lit(0))
    capacity = {m: max(1.0, total[m] / shards) for m in MEASURES}
    weight = F.greatest(*(F.col(m) / F.lit(capacity[m]) for m in MEASURES))
    groups = rows.groupBy("text_key").agg(*_sums()).withColumn("weight", weight)
    large = groups.where(F.col("weight") >= 1 / LARGE).collect()  # at most 3 * LARGE * shards
    whole, split = [r for r in large if r["weight"] <= 1 or r["rows"] == 1], [r for r in large if r["weight"] > 1 and r["rows"] > 1]
    listed = lambda xs, more="": F.broadcast(spark.createDataFrame(xs, f"text_key binary{more}"))  # noqa: E731  of the size of ``large``
    rest = rows.join(listed([(bytes(r["text_key"]),) for r in large]), "text_key", "left_anti").groupBy(_bundle().alias("unit")).agg(*_sums()).collect()  # at most BUNDLES
    parts = rows.join(listed([(bytes(r["text_key"]),) for r in split]), "text_key").groupBy("text_key", _part().alias("unit")).agg(*_sums()).collect() if split else []

    units = [(bytes(r["text_key"]), -1, r) for r in whole] + [(bytes(r["text_key"]), r["unit"], r) for r in parts] + [(None, r["unit"], r) for r in rest]
    vectors = np.array([[r[m] / capacity[m] for m in MEASURES] for _, _, r in units])
    order = sorted(range(len(units)), key=lambda i: (-vectors[i].max(), units[i][0] or b"", units[i][1]))
    shard = np.zeros(len(units), np.int64)
    shard[order] = place(vectors[order], shards)
    placed = [(key, unit, int(s)) for (key, unit, _), s in zip(units, shard)]

    of_large = listed([x for x in placed if x[0] is not None], ", large_unit int, large_shard int")
    of_rest = F.broadcast(spark.createDataFrame([x[1:] for x in placed if x[0] is None], "unit int, rest_shard int"))
    dealt = listed([(bytes(r["text_key"]), r["weight"] > 1 and r["rows"] > 1) for r in large], ", is_split boolean")
    kinds = rows.join(dealt, "text_key", "left").withColumns({"large_unit": F.when(F.col("is_split"), _part()).when(~F.col("is_split"), -1), "unit": F.when(F.col("is_split").isNull(), _bundle())})
    found = kinds.join(of_large, ["text_key", "large_unit"], "left").join(of_rest, "unit", "left")
    return found.select(*rows.columns, F.coalesce("large_shard", "rest_shard").alias("shard"))


def numbered(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard."""
    cells = max(1, assigned.count() // (SHARDS * CELL_ROWS))
    rows = assigned.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")  # a row for each cell
    starts = counts.select("shard", "cell", before.alias("start"))
    place_in_cell = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_key")) - 1
    return rows.withColumn("at", place_in_cell).join(starts, ["shard", "cell"]).withColumn("slot", F.col("start") + F.col("at")).drop("cell", "start", "at")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: shards do not grow under this law) and tokens."""
    out = numbered(assignment(cut(measured(docs)), shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
