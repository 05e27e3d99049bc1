"""Filter interaction audit (operator 12).

Five filters run over every document in each of the 120 orders in which they
may stand.  What a filter removes depends on what runs before it, so each
document's flags are replayed: they meet the 120 orders (a broadcast table), the
order in which they fail first is one expression, the five steps are exploded
and sums under conditions count what happened at each.

Copies are counted before they are replayed: filter E fails all documents of a
text but its smallest doc_id, so documents of one text, part and label are one
row with a count, and a text that a third of all documents share is a few rows.
The replayed rows are dealt out by text, each meets 120 orders and is summed where
it stands; only sums (parts x 600 rows a task) are shuffled.  Texts never are.

Defined results: a null text is the empty text; a null source is the part of the
empty string, together with sources that are empty; a document without a label, or with
null in it, is neither good nor toxic; of several labels of a document any that
holds counts; rows that repeat a doc_id and its text are documents each, none of
which E removes for the other; a null doc_id has no label, is not larger or smaller
than any and never fails E; a very long text is judged whole; of the columns
of ``docs`` and ``labels`` only those named here are read; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Fixed values of the contract.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def flags(docs: DataFrame) -> DataFrame:
    """part, doc_id, text_key and whether filters A to D fail, of each document."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("text"))
    words = F.array_remove(F.split("text", SPACES), "")
    seen = slim.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), F.length("text").alias("n_chars"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_capitals"), F.col("text").rlike(SYMBOLS).alias("D"), F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0].alias("w"))
    return seen.select("doc_id", "part", "text_key", (F.col("w.n") < MIN_WORDS).alias("A"), (100 * F.col("w.distinct") < MIN_DISTINCT_PERCENT * F.col("w.n")).alias("B"), (100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_chars")).alias("C"), "D")


def _labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic; a null doc_id gets a key of its own, so that many of them spread."""
    holds = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    of = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"), F.lit("").cast("binary").alias("no_id")).agg(holds("quality").alias("good"), holds("toxic").alias("toxic"))
    keyed = counted.withColumns({"label_id": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.when(F.col("doc_id").isNull(), F.col("text_key")).otherwise(F.lit("").cast("binary"))})
    return keyed.join(of, ["label_id", "no_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic and n: how many documents of one text, part and label fail these filters."""
    counted = flags(docs).groupBy("doc_id", "part", "text_key", "A", "B", "C", "D").agg(F.count("*").alias("m"))
    first = F.min_by(F.struct("doc_id", "m"), "doc_id")
    same = _labelled(counted, labels).groupBy("text_key", "part", "A", "B", "C", "D", "good", "toxic").agg(F.sum("m").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("n_without_id"))
    # As many partitions as shuffles have, as the rows are small and each becomes 600.
    dealt = same.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_key")
    least = F.min("first.doc_id").over(W.partitionBy("text_key"))
    stays = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.m")).otherwise(0) + F.col("n_without_id")
    both = F.array(F.struct(F.lit(False).alias("E"), stays.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - stays).alias("n")))
    return dealt.withColumn("least", least).select("part", "A", "B", "C", "D", "good", "toxic", F.explode(both).alias("e")).select("part", "A", "B", "C", "D", "e.E", "good", "toxic", "e.n").where("n > 0")


def replay(found: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the rows of ``patterns``."""
    spark = found.sparkSession
    orders = F.broadcast(spark.createDataFrame([(o, *(o.index(f) + 1 for f in FILTERS)) for o in ORDERS], "filter_order string, " + ", ".join(f"at_{f} int" for f in FILTERS)))  # 120 rows
    fails = {f: F.col(f) for f in FILTERS}
    n_fails = sum((c.cast("int") for c in fails.values()), F.lit(0))
    met = found.withColumn("n_fails", n_fails).crossJoin(orders)
    met = met.withColumn("first_failure", F.least(*(F.when(c, F.col(f"at_{f}")).otherwise(6) for f, c in fails.items())))
    steps = F.array(*(F.lit(i) for i in range(1, 6)))
    each = met.select("part", "filter_order", "n", "n_fails", "good", "toxic", "first_failure", *FILTERS, F.explode(steps).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    fails_here = F.coalesce(*(F.when(letter == f, c) for f, c in fails.items()))
    removed_here = F.col("first_failure") == F.col("step")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = each.groupBy("part", "filter_order", "step").agg(
        total(F.col("first_failure") > F.col("step")).alias("kept"), total(removed_here).alias("removed"), total(fails_here & (F.col("first_failure") < F.col("step"))).alias("redundant"),
        total(fails_here & (F.col("n_fails") == 1)).alias("unique_fails"), total(removed_here & F.col("good")).alias("good_lost"), total(removed_here & F.col("toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))  # 120 rows each


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of the contract, zeros included."""
    return replay(patterns(docs, labels))


def audit_sql() -> str:
    """The same in SQL over the provided tables, document by document."""
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, len(words) < {MIN_WORDS} AS A, 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS B,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(text) AS C, regexp_matches(text, '{SYMBOLS}') AS D,
  coalesce(doc_id > least, false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, A, B, C, D, E, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT * FROM (VALUES {orders}) v(filter_order)), s AS (SELECT unnest(range(1, 6)) AS step),
r AS (SELECT *, CASE substr(filter_order, step::INT, 1) WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS here,
  list_min([CASE WHEN x.fails THEN strpos(filter_order, x.letter) ELSE 6 END FOR x IN [{{'letter': 'A', 'fails': A}}, {{'letter': 'B', 'fails': B}}, {{'letter': 'C', 'fails': C}}, {{'letter': 'D', 'fails': D}}, {{'letter': 'E', 'fails': E}}]]) AS first,
  A::INT + B::INT + C::INT + D::INT + E::INT AS fails FROM g, o, s),
c AS (SELECT part, filter_order, step::INT AS step, sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN here AND first < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN first = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM c"""
