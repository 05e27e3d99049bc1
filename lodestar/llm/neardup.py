"""Near-duplicate documents by b-bit MinHash (operator 9).

A document's set holds the distinct shingles of ``k`` lower-cased words (A-Z),
or its whole sequence if it has fewer.  Documents of equal sets form a class
with one representative.  Of HASHES minima, groups of ROWS give the band keys,
and the low BITS of each, packed, the signature: counting equal fields and
correcting for chance, (m - 2**-BITS) / (1 - 2**-BITS), estimates similarity.

Candidates come from band buckets.  First every class is compared with the most
similar of its buckets' smallest members, and links found so far are joined to
components.  Then only pairs within a bucket that are still in different
components matter: all of them, where they are at most PAIRS_PER_MEMBER times
the bucket's members.  Classes of other buckets go through an exact join on the
rarest shingles of each set (sets that are similar enough share one of these),
so no bucket is capped and none is compared all with all; members of one
component, however many, never meet each other there.  An estimate far
below the bound, or sizes too far apart, rule a pair out; every other pair is
confirmed on the full sets of words.

A pair at exactly 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7.

Defined results: a text without words, or null, has an empty set and links
with nothing; rows of one doc_id count as one document; a row without doc_id
links with nothing and is kept; a very long text is sketched whole, in numpy; of
several equally near candidates the smallest doc_id is compared first, and of a
component the smallest doc_id is kept; other columns are not read, whatever their
names, and ``deduplicated`` returns them as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, chunks, cut, doc_text, map_batches, mix
from .components import components, joined

WORDS, PERCENT = 4, 80
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
#: Six standard errors of the estimate at 0.8.
MARGIN = 0.25
PAIRS_PER_MEMBER = 2
#: Ids that a broadcast may hold; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(9)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_hashes(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct shingles of each row, in order of both."""
    words = t.word_hashes()[t.codes] if len(t.codes) else np.zeros(0, np.uint64)
    n = t.counts()
    rows, hashes = [], []
    ends = t.offsets[t.rows + 1]
    at = np.arange(len(words))
    for size in range(1, k + 1):
        first = at[at + k <= ends] if size == k else t.offsets[:-1][n == size]
        h = mix(words[first] + np.uint64(size))
        for i in range(1, size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[first + i])
        rows.append(t.rows[first])
        hashes.append(h)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                t = Tokens(b.column("text"), lower=True)
                row, h = shingle_hashes(t, k)
                has, starts = np.unique(row, return_index=True)
                n = np.bincount(row, minlength=t.n_rows)
                d = np.zeros((2, t.n_rows), np.uint64)
                minima = np.zeros((HASHES, len(has)), np.uint64)
                if len(has):
                    d[0, has] = np.add.reduceat(mix(h), starts)
                    d[1, has] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    for i in range(HASHES):
                        minima[i] = np.minimum.reduceat(h * _MUL[i] + _ADD[i], starts)
                low = mix(minima) & np.uint64((1 << BITS) - 1)
                per = 64 // BITS
                packed = np.zeros((len(has), HASHES // per), np.uint64)
                for i in range(HASHES):
                    packed[:, i // per] |= low[i] << np.uint64(BITS * (i % per))
                keys = np.zeros((len(has), BANDS), np.uint64)
                for i in range(HASHES):
                    keys[:, i // ROWS] = mix(keys[:, i // ROWS] * np.uint64(31) + minima[i])
                full = np.zeros(t.n_rows, np.int64)
                full[has] = 1
                upto = np.concatenate([[0], np.cumsum(full)])
                lists = lambda v: pa.ListArray.from_arrays(pa.array(upto * v.shape[1], pa.int32()), pa.array(v.ravel().view(np.int64)))
                yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists(packed), lists(keys)], names=[x.split()[0] for x in SKETCH.split(", ")])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    odd = int("01" * 32, 2)
    assert BITS == 2, "the fields are folded by one shift"

    def unequal(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))

    same = 1 - sum((unequal(i) for i in range(HASHES * BITS // 64)), F.lit(0)) / HASHES
    return (same - 2.0**-BITS) / (1 - 2.0**-BITS)


def shingle_set(text: str, k: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            a, x, ok = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            ta, tb = b.column("text_a"), b.column("text_b")
            for i in range(len(a)):
                if last[0] != a[i]:
                    last = (a[i], shingle_set(ta[i].as_py(), k))
                other = shingle_set(tb[i].as_py(), k)
                both = len(last[1] & other)
                ok.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (doc_id), one row each; the ids are broadcast if few enough."""
    few = ids.count() <= BROADCAST_IDS
    found = doc_text(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"))


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = cut(pairs.select("a", "b"))
    texts = cut(texts_of(docs, cut(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())))
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(map_batches(with_both.select("a", "b", "text_a", "text_b"), _confirm(k, percent), "a long, b long"))


def _prefixes(docs: DataFrame, ids: DataFrame, k: int, percent: int) -> DataFrame:
    """The rarest shingles of each document of ``ids``, as many as must meet in a similar pair: doc_id, h, rank, n."""
    from pyspark.sql import Window as W

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                row, h = shingle_hashes(Tokens(b.column("text"), lower=True), k)
                yield pa.record_batch([b.column("doc_id").take(pa.array(row)), pa.array(h.view(np.int64))], names=["doc_id", "h"])

    held = cut(map_batches(texts_of(docs, ids), run, "doc_id long, h long"))
    often = held.groupBy("h").agg(F.count("*").alias("often"))
    one = W.partitionBy("doc_id")
    ranked = held.join(often, "h").select("doc_id", "h", F.row_number().over(one.orderBy("often", "h")).alias("rank"), F.count("*").over(one).alias("n"))
    # Sharing ceil(p * n) of n shingles leaves a pair one of the first n - ceil(p * n) + 1.
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)


def _across(members: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Pairs (a < b) of rows with one key and different labels, and the columns ``more`` of both.

    ``top`` is the label that most rows of a key have.  Rows of other labels are
    compared with all rows of the key, those of the top label never with each
    other, so the rows that meet are about as many as the pairs that come out.
    """
    side = lambda x, rows: rows.select(*key, F.col("class_id").alias(x), F.col("label").alias(f"label_{x}"), F.col("top").alias(f"top_{x}"), *(F.col(m).alias(f"{m}_{x}") for m in more))
    met = side("x", members.where("label != top")).join(side("y", members), key).where("label_x != label_y AND (label_y = top_y OR x < y)")
    swap = F.col("x") > F.col("y")
    pick = lambda c, first: F.when(swap == F.lit(first), F.col(f"{c}_y" if c else "y")).otherwise(F.col(f"{c}_x" if c else "x"))
    return met.select(*key, pick("", True).alias("a"), pick("", False).alias("b"), *(pick(m, first).alias(f"{m}_{x}") for m in more for x, first in (("a", True), ("b", False))))


def link(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, pairs_per_member: int = PAIRS_PER_MEMBER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    sketch = cut(map_batches(doc_text(docs), _sketch(k), SKETCH))
    own = ["n_shingles", "d1", "d2"]
    classes = cut(sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*own).agg(F.min("doc_id").alias("class_id")))
    head = classes.withColumnRenamed("class_id", "doc_id")
    reps = cut(sketch.join(head, [*own, "doc_id"]).groupBy(F.col("doc_id").alias("class_id")).agg(F.min(F.struct("n_shingles", "sig", "bands")).alias("r")).select("class_id", "r.n_shingles", "r.sig", "r.bands"))
    members = reps.select("class_id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("class_id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = cut(members.join(buckets, ["band", "key"]))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) not ruled out by size or signature, with their estimate."""
        side = lambda x: reps.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("estimate", estimate(F.col("sig_a"), F.col("sig_b")))
        fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return met.where(fits & (F.col("estimate") >= percent / 100 - MARGIN)).select("a", "b", "estimate")

    stars = likely(shared.where("class_id != pivot").select(F.col("pivot").alias("a"), F.col("class_id").alias("b")).distinct())
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    first = confirmed(docs, nearest, k, percent)
    label = cut(components(first))

    # What is left: members of one bucket in different components.
    placed = cut(shared.select("band", "key", "class_id").join(label.withColumnRenamed("node", "class_id"), "class_id", "left").select("band", "key", "class_id", F.coalesce("label", "class_id").alias("label")))
    per_label = placed.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    open_ = cut(per_label.groupBy("band", "key").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("top"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where("pairs > 0"))
    few = F.col("pairs") <= F.col("size") * pairs_per_member
    rest = _across(placed.join(open_.where(few), ["band", "key"]), ["band", "key"]).select("a", "b")
    wide = open_.where(~few)
    if wide.limit(1).count():
        crowd = cut(placed.join(wide.select("band", "key"), ["band", "key"]).select(F.col("class_id").alias("doc_id"), "label").distinct())
        rare = _prefixes(docs, crowd.select("doc_id"), k, percent).join(crowd, "doc_id")
        # Similar sets have sizes in a ratio of percent / 100 at least: the same step of that ratio, or the next.
        step = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
        rare = cut(rare.select("h", F.col("doc_id").alias("class_id"), "rank", "n", "label", F.explode(F.array(step, step + 1)).alias("step"), step.alias("own_step")))
        tops = cut(rare.groupBy("h", "step", "label").agg(F.count("*").alias("m")).groupBy("h", "step").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
        met = _across(rare.join(tops, ["h", "step"]), ["h", "step"], "rank", "n", "own_step")
        left_of = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + 1
        enough = left_of * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
        # Two of one step meet in both of its keys: the second time does not count.
        once = (F.col("own_step_a") != F.col("own_step_b")) | (F.col("step") == F.col("own_step_a"))
        rest = rest.unionAll(met.where(enough & once).select("a", "b"))
    second = confirmed(docs, likely(rest.distinct()), k, percent)
    label = joined(label, second)

    named = sketch.drop("sig", "bands").join(classes, own, "left").join(label.withColumnRenamed("node", "class_id"), "class_id", "left")
    top = F.when(F.col("n_shingles") > 0, F.coalesce("label", "class_id", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), top).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not kept; of rows with one doc_id one stays, the same in every run (the one whose text hashes least)."""
    linked = cut(link(docs, **options))
    gone = cut(linked.where("NOT kept").select("doc_id").distinct())
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    repeated = cut(linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = repeated.count()
    if not n:
        return left
    few = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    rank = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant")))
    several = left.join(few, "doc_id", "left_semi").withColumn("_rank", rank)
    first = several.groupBy("doc_id").agg(F.min("_rank").alias("_first"))  # hashes only, combined before they move
    one = several.join(first, "doc_id").where("_rank = _first").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(few, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
