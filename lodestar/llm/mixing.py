"""Mixing sources to target weights (operator 7).

Every source is one stream of words, packed into blocks of a hundredth of it (at
least one word, at most ``block_words``), so that a small source meets its target too.
Targets come from water-filling; the driver draws, for each output shard,
multinomial counts of blocks per source, with probabilities that follow what
each source still lacks, so that the totals land on the targets.  The j-th slot
of a source names the block at position j of a pseudorandom permutation of that
source's blocks (a Feistel network with cycle walking, one key per pass), and
blocks are joined to slots by index.  Only the table of sources and the shard
counts pass through the driver; words never do.

Defined results: a null or empty text has size 0 and nothing is taken of it; a
null source is a source of its own, last in order; a very long text is many
pieces, of which the mix may take some; repeated rows are separate documents, and
those that tie in doc_id and text share one place in the order; other columns are
not read, whatever their names; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, map_batches, mix

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS = 128
#: A source has at least as many blocks as this, if it has as many words.
LEAST_BLOCKS = 100
#: Blocks of a shard where there are few shards, shards at most, and counts (shard, source) that the driver draws (with more sources, one each): then shards are larger, and tasks take no more than SHARD_BLOCKS of one.
SHARD_BLOCKS, MAX_SHARDS, MAX_COUNTS = 4096, 4096, 1 << 20
#: Documents in a bucket of a source's stream; a bucket is what one task sums up in order.
BUCKET_DOCS = 256
#: Buckets whose sums are added up in one task before the groups of buckets are.
GROUP_BUCKETS = 4096
SEED = 7


@dataclass
class Mix:
    docs: DataFrame  # doc_id, text_hash, source_ix, size, start
    sources: DataFrame  # source, source_ix, source_size, target, n_blocks, block_words
    pieces: DataFrame  # source_ix, block, doc_id, text_hash, start, first_word, n_words
    slots: DataFrame  # shard, source_ix, slot, block


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def draw_shards(slots: np.ndarray, seed: int, shard_blocks: int = SHARD_BLOCKS) -> np.ndarray:
    """Counts per shard and source that add up to ``slots``: multinomial draws from what is still lacking."""
    total = int(slots.sum())
    n = max(1, min(MAX_SHARDS, MAX_COUNTS // max(1, len(slots)), -(-total // shard_blocks)))
    rng, left, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), []
    for i in range(n):
        want = total * (i + 1) // n - total * i // n
        got = np.zeros_like(left)
        while want and left.sum():
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left, want = got + more, left - more, want - int(more.sum())
        out.append(got)
    return np.array(out)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position ``index`` of a pseudorandom permutation of range(n), chosen by ``key``; all arrays of one length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit = n.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _slot_blocks(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, n, slot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("source_ix", "n_blocks", "slot"))
            key = mix(mix(src.astype(np.uint64) + np.uint64(seed)) + (slot // np.maximum(n, 1)).astype(np.uint64))
            block = permuted(slot % np.maximum(n, 1), n, key)
            yield pa.record_batch([b.column("shard"), b.column("source_ix"), b.column("slot"), pa.array(block)], names=["shard", "source_ix", "slot", "block"])

    return run


def bucket_starts(totals: DataFrame, group: int = GROUP_BUCKETS) -> DataFrame:
    """source_ix, bucket, base: words of the source in the buckets before, from (source_ix, bucket, in_bucket).

    Sums are taken over groups of buckets first, so no task holds all buckets of
    a source, only those of a group, or one sum for each group.
    """
    grouped = totals.withColumn("group", F.floor(F.col("bucket") / group))
    before = lambda value, *of: F.sum(value).over(W.partitionBy(*of[:-1]).orderBy(of[-1])) - F.col(value)
    groups = grouped.groupBy("source_ix", "group").agg(F.sum("in_bucket").alias("in_group")).select("source_ix", "group", before("in_group", "source_ix", "group").alias("group_base"))
    within = grouped.select("source_ix", "bucket", "group", before("in_bucket", "source_ix", "group", "bucket").alias("inner_base"))
    return within.join(groups, ["source_ix", "group"]).select("source_ix", "bucket", (F.col("group_base") + F.col("inner_base")).alias("base"))


def mix_sources(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source).

    ``sources`` is collected: one row per source, as targets depend on all of
    them.  Every other table stays distributed; a source of any size is spread
    over its buckets.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash")))
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), cap)
    widths = [max(1, min(block_words, s // LEAST_BLOCKS)) for s in sizes]
    n_blocks = np.array([-(-s // w) for s, w in zip(sizes, widths)], np.int64)
    n_slots = np.array([min(round(t * n / s), int(cap * n)) if s else 0 for t, n, s in zip(targets, n_blocks.tolist(), sizes)], np.int64)
    sources = spark.createDataFrame([(r["source"], i, sizes[i], float(targets[i]), int(n_blocks[i]), widths[i]) for i, r in enumerate(rows)], "source string, source_ix int, source_size long, target double, n_blocks long, block_words long")

    # Each source's stream: buckets one after the other, documents in order within a bucket.
    n_buckets = max(1, sum(r["n"] for r in rows) // BUCKET_DOCS)
    placed = sized.join(sources.select(F.col("source").alias("s"), "source_ix", "block_words"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_buckets)))
    base = bucket_starts(placed.groupBy("source_ix", "bucket").agg(F.sum("size").alias("in_bucket")))
    within = W.partitionBy("source_ix", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = placed.withColumn("upto", F.sum("size").over(within)).join(base, ["source_ix", "bucket"]).select("doc_id", "text_hash", "source_ix", "block_words", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))

    last = F.col("start") + F.col("size") - 1
    b = F.col("block_words")
    pieces = (
        laid.where("size > 0")
        .select("*", F.explode(F.sequence(F.expr("start DIV block_words"), F.expr("(start + size - 1) DIV block_words"))).alias("block"))
        .select("source_ix", "block", "doc_id", "text_hash", "start", (F.greatest("start", F.col("block") * b) - F.col("start")).alias("first_word"), (F.least(last, F.col("block") * b + b - 1) - F.greatest("start", F.col("block") * b) + 1).alias("n_words"))
    )

    drawn = draw_shards(n_slots, seed)
    before = np.cumsum(drawn, axis=0) - drawn
    shard, source = np.nonzero(drawn)
    columns = {"shard": shard, "source_ix": source, "n_blocks": n_blocks[source], "first": before[shard, source], "n": drawn[shard, source]}
    counts = spark.createDataFrame(pa.table(columns), "shard long, source_ix long, n_blocks long, first long, n long").withColumns({c: F.col(c).cast("int") for c in ("shard", "source_ix")})
    upto = F.col("first") + F.col("n") - 1
    runs = counts.select("shard", "source_ix", "n_blocks", upto.alias("upto"), F.explode(F.sequence(F.col("first"), upto, F.lit(SHARD_BLOCKS))).alias("from"))
    each = F.sequence(F.col("from"), F.least(F.col("from") + SHARD_BLOCKS - 1, "upto"))
    slots = map_batches(runs.repartition("shard", "source_ix", "from").select("shard", "source_ix", "n_blocks", F.explode(each).alias("slot")), _slot_blocks(seed), "shard int, source_ix int, slot long, block long")
    return Mix(laid.drop("block_words"), sources, pieces, slots)


def taken_pieces(mixed: Mix) -> DataFrame:
    """The pieces of documents that the mix takes, with ``times``: blocks joined to slots by index."""
    times = mixed.slots.groupBy("source_ix", "block").agg(F.count("*").alias("times"))
    # Blocks grow with the input, though Spark sees that they come from the short table of counts: not to be broadcast.
    return mixed.pieces.join(times.hint("merge"), ["source_ix", "block"])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    mixed = mix_sources(docs, **options)
    taken = taken_pieces(mixed).groupBy("source_ix", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"), F.lit(True).alias("sized"))
    return (
        mixed.docs.withColumn("sized", F.col("size") > 0)
        .join(taken, ["source_ix", "start", "sized"], "left")
        .join(mixed.sources, "source_ix")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(r"[^ \t-\r]+")
    for b in batches:
        out = {k: [] for k in ("doc_id", "text", "lang", "source", "n_chars")}
        for r in b.to_pylist():
            spans = [m.span() for m in word.finditer(r["text"])]
            for times in (1, 2):
                parts: list[list[int]] = []
                for p in sorted((p for p in r["pieces"] if p["times"] >= times), key=lambda p: p["first_word"]):
                    if parts and parts[-1][1] == p["first_word"]:
                        parts[-1][1] += p["n_words"]
                    else:
                        parts.append([p["first_word"], p["first_word"] + p["n_words"]])
                if parts:
                    text = "\n".join(r["text"][spans[i][0] : spans[j - 1][1]] for i, j in parts)
                    for k, v in (("doc_id", r["doc_id"]), ("text", text), ("lang", r["lang"]), ("source", r["source"]), ("n_chars", len(text))):
                        out[k].append(v)
        yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["lang"], pa.string()), pa.array(out["source"], pa.string()), pa.array(out["n_chars"], pa.int64())], names=list(out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars).

    A document comes once with the words taken at least once and, if words are
    taken twice, once more with these; runs that do not touch are put on lines
    of their own.  A document of which nothing is taken does not appear.
    """
    mixed = mix_sources(docs, **options)
    per_row = taken_pieces(mixed).groupBy("source_ix", "start", "doc_id", "text_hash").agg(F.collect_list(F.struct("first_word", "n_words", "times")).alias("pieces"))
    # Rows that repeat share doc_id and text: n of them are told apart by an ordinal on both sides.
    nth = F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("source_ix", "start"))
    laid = mixed.docs.select("doc_id", "text_hash", "source_ix", "start", nth.alias("nth")).where("size > 0")
    wanted = per_row.join(laid.drop("doc_id"), ["source_ix", "start", "text_hash"]).select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("doc_id").isNull().alias("no_id"), "text_hash", "nth", "pieces")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    again = mixed.docs.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if again:
        # The hash orders the window, not the text: texts of one key are equal.
        plain = plain.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy(F.col("source").asc_nulls_last())))
    else:
        plain = plain.withColumn("nth", F.lit(1))
    plain = plain.withColumns({"k": F.coalesce("doc_id", F.lit(-1)), "no_id": F.col("doc_id").isNull()})
    return map_batches(plain.join(wanted, ["k", "no_id", "text_hash", "nth"]).select("doc_id", "text", "lang", "source", "pieces"), _cut_words, "doc_id long, text string, lang string, source string, n_chars long")
