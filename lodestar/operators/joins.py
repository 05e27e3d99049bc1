"""Joins whose left side may have keys that hold a large part of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets in which rows are counted before keys are.
BUCKETS = 1 << 16
#: Rows of one key that a task takes in any case.
LEAST = 50_000


def hot_keys(rows: DataFrame, on: list[str], least: int = LEAST) -> tuple[DataFrame | None, int]:
    """The keys of more than a quarter of a partition's rows each (so at most four a partition), with ``salts``, and that bound.

    Rows are counted in buckets first: a bucket without many rows has no such key, so that
    keys are only counted where there may be one.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    counts = rows.groupBy(bucket.alias("b")).count().collect()  # at most BUCKETS
    bound = max(least, sum(r["count"] for r in counts) // (4 * partitions))
    full = [r["b"] for r in counts if r["count"] > bound]
    if not full:
        return None, bound
    keys = rows.where(bucket.isin(full)).groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > bound)
    return keys.select(*on, F.ceil(F.col("n") / bound).cast("int").alias("salts")), bound


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", least: int = LEAST) -> DataFrame:
    """``left.join(right, on, how)`` where no key brings more than a quarter of a partition's rows of ``left`` to one task.

    The hottest keys are counted; their rows on the left are dealt out by a number, and the
    row or rows of such a key on the right are copied for each.  ``left`` is read two or
    three times, so it should be a table.  ``how`` is inner, left, left_semi or left_anti.
    """
    hot, _ = hot_keys(left, on, least)
    if hot is None:
        return left.join(right, on, how)
    few = F.broadcast(hot)
    salted = left.join(few, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(0))).drop("salts")
    copies = right.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
