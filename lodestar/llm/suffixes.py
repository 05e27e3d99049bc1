"""Exact removal of repeated byte strings by blockwise suffix ordering (operator 10).

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
too.  That asks, of every suffix, whether its first ``length`` bytes are those
of another: suffixes that share them are neighbours, and tie up to that depth,
in the suffix array.  The array is never held.  It is built a bucket at a time,
and long ties are settled by ranks of a sample of positions:

* The cover sample.  Any string of ``length`` bytes holds a sampled position,
  and equal strings hold it at the same place; this is what a difference cover
  is for.  Here the sample is drawn from content (of the ``length - GRAM + 1``
  grams in the string, the one with the least hash), which samples
  2 / (length - GRAM + 2) of all positions, where a cyclic difference cover of
  period 133 samples 12 / 133.
* Buckets.  Suffixes whose next sample has the same gram form a bucket, at each
  distance from the sample.  Neighbouring suffixes with one sample make a run.
  A run whose context (all bytes that its strings cover) occurs twice is
  settled at once, by counting: no neighbour can tell more.  Runs that share a
  bucket but not a context remain, with one run of each settled context as a
  witness.
* Order.  A bucket of at most BUCKET_RUNS such runs is sorted in one task.  First
  the sampled suffixes are put in the order of their bytes, which gives each
  sample a rank.  Then the suffixes are sorted by the bytes before their sample,
  and those that tie there by the sample's rank: the order is that of all their
  bytes, and no comparison goes past the sample.  Neighbours are compared byte
  by byte over ``length``.  A larger bucket is never gathered: its runs are cut
  into blocks of BLOCK distances, named by 128 bits of hash and counted, and
  what is still alone is counted suffix by suffix.

A text may also be taken as its words (``words=True``): an element is then the
64-bit hash of a word instead of a byte, ``length`` and ``gram`` count words, and
a span goes from the start of its first word to the end of its last.
``without_repeats_and_passages`` does both, each on the whole input: passages of
over 50 words are often under 400 bytes.

Contexts are named by two 64-bit hashes.  A passage that a third of all
documents share is counted, with sums in every task before the shuffle.  Python
takes texts in pieces of PIECE bytes, however long they are.

Defined results: a null text is the empty text; texts shorter than ``length``
lose nothing; equal rows are copies of each other; a very long text is cut into
pieces that overlap by ``length``, with the same result; what is left of a text is
decoded with U+FFFD where a cut falls inside a character (the hash of the
query is of the bytes themselves); equal strings tie, and all of them go; columns of
any name beside those read are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASHES, chunks, cut, map_batches, mix, passing, powers

LENGTH = 400
GRAM = 128
BLOCK = 16
BUCKET_RUNS = 1000
#: Bytes of text that are read at a time; the part of them that is hashed at a time, whose hashes stay in a core's cache; and suffixes that are sorted at a time.
PIECE = 1 << 19
HASHED = 4
SORTED = 1 << 14
#: A passage of over 50 words holds a string of so many; grams of so many.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 16
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_LOW = np.uint64((1 << 24) - 1)
#: Bytes of an element: a byte of text, or the hash of a word.
_KINDS = {1: np.uint8, 8: np.uint64}


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _slices(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about PIECE / HASHED bytes that end at a space, and where they start."""
    at = 0
    while at < len(text):
        end = at + PIECE // HASHED
        while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
            end += 1
        yield at, text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> list[bytes]:
    """Of each text, the 64-bit hashes of its words."""
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, part in _slices(b"\n".join(texts)):
        starts, ends = word_places(part)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_HASHES[np.frombuffer(part, np.uint8)] * powers(_BASE, len(part))[:-1], out=prefix[1:])
        hashes.append(mix((prefix[ends] - prefix[starts]) * powers(_BASE_INVERSE, len(part))[starts] + (ends - starts).astype(np.uint64)))
        found.append(starts + at)
    of = np.concatenate(hashes)
    edges = np.searchsorted(np.concatenate(found), np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return [of[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _elements(batch: pa.RecordBatch, width: int) -> list[bytes]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return word_hashes(texts) if width == 8 else texts


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two, in this order."""
    x = a * _FOLD
    x ^= x >> _SHIFT
    x += b
    return x


class Hashes:
    """Hashes of all substrings of the given lengths of some elements.

    A string is hashed from its halves; of a length that is no power of two, from
    the longest such string at its start and at its end, which overlap.
    """

    def __init__(self, raw: np.ndarray, *lengths: int) -> None:
        held = {1 << (n.bit_length() - 1) for n in lengths}
        self.of: dict[int, np.ndarray] = {}
        x, n = BYTE_HASHES[raw] if raw.dtype == np.uint8 else raw, 1
        while True:
            if n in held:
                self.of[n] = x
            if n == max(held):
                return
            y = np.zeros_like(x)
            if len(x) > n:
                y[:-n] = _fold(x[:-n], x[n:])
            x, n = y, n * 2

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        s = 1 << (n.bit_length() - 1)
        return mix(_fold(self.of[s][at], self.of[s][at + n - s]))

    def cover(self, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Of the elements from ``first`` to ``last + n``, where last - first < n."""
        return mix(self(first, n) + self(last, n) * np.uint64(31) + (last - first).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while s * 2 <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one sample: text, first and last suffix, sample, gram hash, context hash."""
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    h = Hashes(raw, length, gram)
    g = h(np.arange(len(raw) - gram + 1), gram)
    least = sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    step = np.zeros(len(raw) + 1, np.int32)
    long_ = ends - starts >= length
    np.add.at(step, starts[long_], 1)
    np.add.at(step, ends[long_] - length + 1, -1)
    i = np.flatnonzero(np.cumsum(step)[: len(least)] > 0)
    sample = (least[i] & _LOW).astype(np.int64)
    owner = np.searchsorted(starts, i, side="right") - 1
    new = np.ones(len(i), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (i[1:] != i[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i))[: len(first)] - 1
    a, b, s = i[first], i[last], sample[first]
    return owner[first], a, b, s, g[s], mix(h.cover(a, b, length) + (s - a).astype(np.uint64))


def _pieces(texts: list[bytes], length: int, width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts (index, offset in elements, bytes) in groups of about PIECE / HASHED bytes; longer texts are cut by the suffixes that start in a piece."""
    group, size, room = [], 0, PIECE // HASHED
    step = max(1, room // width)
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) // width - length + 1), step):
            part = t[at * width : (at + step + length - 1) * width]
            if group and size + len(part) > room:
                yield group
                group, size = [], 0
            group.append((k, at, part))
            size += len(part)
    if group:
        yield group


RUN = "doc long, hash long, first int, last int, sample int, gram long, context long"


def _runs(length: int, gram: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in chunks(whole, limit=PIECE)):
            docs, hashes = b.column("doc").to_numpy(), b.column("hash").to_numpy()
            for group in _pieces(_elements(b, width), length, width):
                lengths = np.array([len(p[2]) // width for p in group])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                owner, a, z, s, g, c = runs(np.frombuffer(b"".join(p[2] for p in group), _KINDS[width]), starts, ends, length, gram)
                text = np.array([p[0] for p in group])[owner] if len(owner) else owner
                shift = (np.array([p[1] for p in group]) - starts)[owner] if len(owner) else owner
                cols = [docs[text], hashes[text], *((x + shift).astype(np.int32) for x in (a, z, s)), g.view(np.int64), c.view(np.int64)]
                yield pa.record_batch([pa.array(x) for x in cols], names=[x.split()[0] for x in RUN.split(", ")])

    return run


FRAGMENT = "doc long, hash long, first int, last int, sample int, gram long, witness boolean, bytes binary"


def _fragments(length: int, width: int):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in FRAGMENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in (b for whole in batches for b in chunks(whole, limit=PIECE)):
            for doc, h, text, own in zip(b.column("doc").to_pylist(), b.column("hash").to_pylist(), _elements(b, width), b.column("runs").to_pylist()):
                for r in own:
                    first, last, sample, gram, witness = (r[k] for k in ("first", "last", "sample", "gram", "witness"))
                    part = text[first * width : (last + length) * width]
                    out.append((doc, h, first, last, sample, gram, witness, part))
                    size += len(part)
                    if size > PIECE:
                        yield batch(out)
                        out, size = [], 0
        yield batch(out)

    return run


RANKED = "doc long, hash long, gram long, sample int, at int, distance int, n int, witness boolean, context long"


def _ranked(length: int, block: int, only: bool, width: int):
    """Blocks of suffixes of fragments with a name for their bytes. ``only``: of the wanted blocks, each suffix by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in chunks(whole, "bytes", PIECE)):
            frag = [x or b"" for x in b.column("bytes").to_pylist()]
            sizes = np.array([len(x) // width for x in frag], np.int64)
            base = np.cumsum(sizes) - sizes
            h = Hashes(np.frombuffer(b"".join(frag), _KINDS[width]), length)
            first, last, sample = (b.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "sample"))
            low, high = sample - last, sample - first  # distances to the sample
            if only:
                lists = b.column("blocks").to_pylist()
                row = np.repeat(np.arange(len(frag)), [len(x) for x in lists])
                j = np.array([y for x in lists for y in x], np.int64)
                row, off = np.repeat(row, block), np.tile(np.arange(block), len(j))
                d = np.repeat(j, block) * block + off
                ok = (d >= low[row]) & (d <= high[row])
                row, d0, d1 = row[ok], d[ok], d[ok]
                key = d0
            else:
                n = high // block - low // block + 1
                row = np.repeat(np.arange(len(frag)), n)
                key = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low // block, n)
                d0, d1 = np.maximum(key * block, low[row]), np.minimum(key * block + block - 1, high[row])
            at, upto = sample[row] - d1, sample[row] - d0
            place = base[row] - first[row]
            c = h.cover(place + at, place + upto, length) if len(row) else np.zeros(0, np.uint64)
            take = pa.array(row)
            cols = [b.column("doc").take(take), b.column("hash").take(take), b.column("gram").take(take), b.column("sample").take(take), pa.array(at.astype(np.int32)), pa.array(key.astype(np.int32)), pa.array((upto - at + 1).astype(np.int32)), b.column("witness").take(take), pa.array(c.view(np.int64))]
            yield pa.record_batch(cols, names=[x.split()[0] for x in RANKED.split(", ")])

    return run


def _joined(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc", "hash"], "left_semi")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc, hash (together a row's key; equal rows have one key), text, and the columns ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"), *more)


SPAN = "doc long, hash long, start int, stop int"
Keep = Callable[[DataFrame], DataFrame]


def _rows_of(windows: np.ndarray) -> np.ndarray:
    """A matrix of bytes as one fixed-size string for each row, which compare by their bytes."""
    return np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel()


class Bucket:
    """Fragments of one or more whole buckets, and the order of their suffixes.

    ``raw`` holds the fragments' bytes one after the other, ``base`` where each
    begins; ``first``, ``last`` and ``sample`` are element numbers in the text.
    """

    def __init__(self, fragments: list[bytes], first: np.ndarray, last: np.ndarray, sample: np.ndarray, gram: np.ndarray, length: int, width: int) -> None:
        self.first, self.last, self.sample, self.length, self.width = first, last, sample, length, width
        sizes = np.array([len(x) for x in fragments], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.raw = np.frombuffer(b"".join(fragments) + bytes(length * width), np.uint8)
        self.bucket = np.unique(gram, return_inverse=True)[1]
        self.ranks = self._sample_ranks()

    def _windows(self, n: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.raw, n)

    def _sample_ranks(self) -> np.ndarray:
        """The rank of each sampled suffix among all of them, by its bytes as far as its run's strings go (zeros after that)."""
        n, size = len(self.first), self.length * self.width
        held = (self.last + self.length - self.sample) * self.width
        strings = np.empty(n, f"S{size}")
        for i in range(0, n, SORTED):
            part = slice(i, i + SORTED)
            w = self._windows(size)[self.base[part] + (self.sample - self.first)[part] * self.width].copy()
            w[np.arange(size) >= held[part, None]] = 0
            strings[part] = _rows_of(w)
        return np.unique(strings, return_inverse=True)[1].astype(np.int64)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row and distance of about SORTED suffixes at a time, whole (bucket, distance) groups together."""
        low, high = self.sample - self.last, self.sample - self.first
        # Whole buckets while they are small; a larger one some distances at a time.
        n = np.bincount(self.bucket, high - low + 1).astype(np.int64)
        order = np.argsort(self.bucket, kind="stable")
        ends = np.cumsum(np.bincount(self.bucket))
        start = done = 0
        while done < len(n):
            size, upto = n[done], done + 1
            while upto < len(n) and size + n[upto] <= SORTED:
                size, upto = size + n[upto], upto + 1
            rows = order[start : ends[upto - 1]]
            a, z = int(low[rows].min()), int(high[rows].max())
            step = max(1, (z - a + 1) * SORTED // max(SORTED, int(size)))
            for d0 in range(a, z + 1, step):
                from_, to = np.maximum(low[rows], d0), np.minimum(high[rows], d0 + step - 1)
                many = np.maximum(0, to - from_ + 1)
                row = np.repeat(rows, many)
                if len(row):
                    yield row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(from_, many)
            start, done = ends[upto - 1], upto

    def _places(self, row: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return self.base[row] + (self.sample[row] - distance - self.first[row]) * self.width

    def ordered(self, row: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The order of suffixes by bucket, distance and all their bytes: the bytes before the sample, then the sample's rank."""
        before = max(1, int(distance.max()) * self.width)
        w = self._windows(before)[self._places(row, distance)].copy()
        w[np.arange(before) >= (distance * self.width)[:, None]] = 0
        return np.lexsort((self.ranks[row], np.unique(_rows_of(w), return_inverse=True)[1], distance, self.bucket[row]))

    def repeated(self, row: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Which of some suffixes share ``length`` elements with another of their bucket and distance."""
        # Those that are alone with their first eight bytes need no place in the order.
        head = self._windows(8)[self._places(row, distance)].copy().view(np.uint64).ravel()
        _, twin, times = np.unique(mix(head + mix((self.bucket[row] * (1 << 20) + distance).astype(np.uint64))), return_inverse=True, return_counts=True)
        out = np.zeros(len(row), bool)
        some = np.flatnonzero(times[twin] > 1)
        if len(some):
            row, distance = row[some], distance[some]
            order = self.ordered(row, distance)
            r, d = row[order], distance[order]
            w = self._windows(self.length * self.width)
            at = self._places(r, d)
            near = np.flatnonzero((self.bucket[r[1:]] == self.bucket[r[:-1]]) & (d[1:] == d[:-1]))
            near = near[(w[at[near]] == w[at[near + 1]]).all(axis=1)]
            out[some[order[near]]] = True
            out[some[order[near + 1]]] = True
        return out


def _sorted_buckets(rows: list[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated suffixes of whole buckets."""
    t = pa.Table.from_batches(rows).combine_chunks()
    first, last, sample = (t.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "sample"))
    bucket = Bucket([x or b"" for x in t.column("bytes").to_pylist()], first, last, sample, t.column("gram").to_numpy(), length, width)
    seen_only = t.column("witness").to_numpy()
    for row, distance in bucket.blocks():
        found = np.flatnonzero(bucket.repeated(row, distance) & ~seen_only[row])
        at = sample[row[found]] - distance[found]
        # Neighbouring suffixes of one run make one span.
        order = np.lexsort((at, row[found]))
        r, at = row[found][order], at[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(r))[: len(head)] - 1
        of = pa.array(r[head])
        yield pa.record_batch([t.column("doc").combine_chunks().take(of), t.column("hash").combine_chunks().take(of), pa.array(at[head].astype(np.int32)), pa.array((at[tail] + length).astype(np.int32))], names=["doc", "hash", "start", "stop"])


def _buckets(length: int, width: int):
    """Over runs sorted by bucket: buckets are completed across batches and sorted a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (b for whole in batches for b in chunks(whole, "bytes", PIECE)):
            gram = b.column("gram").to_numpy()
            cut_at = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if held and held[-1].column("gram")[0].as_py() != gram[0]:
                yield from _sorted_buckets(held, length, width)
                held = []
            if cut_at:
                yield from _sorted_buckets([*held, b.slice(0, cut_at)], length, width)
                held = []
            held.append(b.slice(cut_at))
        if held:
            yield from _sorted_buckets(held, length, width)

    return run


def _bytes_of(texts: DataFrame, runs_: DataFrame, length: int, width: int, cut: Keep) -> DataFrame:
    """FRAGMENT: the bytes that each run's strings cover."""
    grouped = cut(runs_.groupBy("doc", "hash").agg(F.collect_set(F.struct("first", "last", "sample", "gram", "witness")).alias("runs")))
    own = _joined(texts, grouped.select("doc", "hash")).groupBy("doc", "hash").agg(F.first("text").alias("text"))
    return map_batches(own.join(grouped, ["doc", "hash"]).select("doc", "hash", "text", "runs"), _fragments(length, width), FRAGMENT)


def _large_buckets(fragments: DataFrame, length: int, block: int, width: int, cut: Keep) -> DataFrame:
    """Spans of repeated suffixes, by counting blocks and then suffixes."""
    fragments = cut(fragments)
    ranked = cut(map_batches(fragments, _ranked(length, block, False, width), RANKED))
    named = ["gram", "distance", "n", "context"]
    place = F.struct("doc", "hash", "at")
    twins = ranked.groupBy(*named).agg(F.count("*").alias("times"), F.min(place).alias("head"))
    full = (F.col("n") == block) & (F.col("times") > 1)
    blocks = cut(ranked.join(twins, named).withColumn("full", full).where(~full | (place == F.col("head")) | ~F.col("witness")).select("doc", "hash", "gram", "sample", "at", "distance", "n", "witness", "full", (place == F.col("head")).alias("is_head")))
    by_block = blocks.where("full AND NOT witness").select("doc", "hash", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("stop"))
    alone = blocks.where(~F.col("full") | F.col("is_head"))
    crowded = alone.groupBy("gram", "distance").agg(F.count("*").alias("rows"), F.count_if(~F.col("full")).alias("open")).where("rows > 1 AND open > 0")
    wanted = alone.join(crowded, ["gram", "distance"]).groupBy("doc", "hash", "gram", "sample").agg(F.collect_set("distance").alias("blocks"))
    single = cut(map_batches(fragments.join(wanted, ["doc", "hash", "gram", "sample"]), _ranked(length, block, True, width), RANKED))
    again = single.groupBy("gram", "distance", "context").agg(F.count("*").alias("times")).where("times > 1")
    by_suffix = single.where("NOT witness").join(again, ["gram", "distance", "context"]).select("doc", "hash", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
    return by_block.unionAll(by_suffix)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, bucket_runs: int = BUCKET_RUNS, words: bool = False, cut: Keep = cut) -> DataFrame:
    """doc, hash, spans: sorted spans of bytes (or words) to remove (start, stop), for texts that have any; they may overlap."""
    width = 8 if words else 1
    texts = keyed(docs)
    found = cut(map_batches(texts, _runs(length, gram, width), RUN))
    place = F.struct("doc", "hash", "first")
    classes = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("head"))
    buckets = classes.groupBy("gram").agg(F.sum("n").alias("n_gram"), F.count("*").alias("contexts")).where("n_gram > 1")
    shared = cut(classes.join(buckets, "gram").select("gram", "context", "n", "contexts", "head"))
    met = cut(found.join(shared, ["gram", "context"]).withColumn("witness", F.col("n") > 1).withColumn("open", (F.col("contexts") > 1) & ((F.col("n") == 1) | (place == F.col("head")))).select("doc", "hash", "first", "last", "sample", "gram", "contexts", "witness", "open"))
    # A bucket's open runs are one for each of its contexts.
    open_ = met.where("open")
    light = _bytes_of(texts, open_.where(F.col("contexts") <= bucket_runs), length, width, cut)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = map_batches(light.repartition(partitions, "gram").sortWithinPartitions("gram"), _buckets(length, width), SPAN)
    heavy = open_.where(F.col("contexts") > bucket_runs)
    if heavy.limit(1).count():
        spans = spans.unionAll(_large_buckets(_bytes_of(texts, heavy, length, width, cut), length, block, width, cut))
    settled = met.where("witness").select("doc", "hash", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    return settled.unionAll(spans).groupBy("doc", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def _spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _word_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes."""
    if not spans:
        return []
    first, last = word_places(text)
    return [(int(first[s]), int(last[e - 1])) for s, e in spans]


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:int,stop:int>>"
PASSAGES = "n_passages long, n_passage_words long, text_without_passages string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.int64(), pa.int64(), pa.string())


def _cut_texts(rows: DataFrame, more: tuple[str, ...], words: bool, passages: bool) -> DataFrame:
    """CUT, PASSAGES where asked for, and ``more``, of doc_id, text, spans and their words' ``passages``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([CUT, *[PASSAGES] * passages, *(f"{m} {kinds[m]}" for m in more)])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in chunks(whole)):
            out = []
            long_ = b.column("passages").to_pylist() if passages else [None] * b.num_rows
            for text, own, over in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), long_):
                own = _word_spans(text, _spans(own)) if words else _spans(own)
                kept = kept_bytes(text, own)
                row = (len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"start": s, "stop": e} for s, e in own])
                if passages:
                    over = _spans(over)
                    row += (len(over), sum(e - s for s, e in over), kept_bytes(text, _word_spans(text, over)).decode())
                out.append(row)
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES[: 6 + 3 * passages])]
            yield pa.record_batch([b.column("doc_id"), *cols, *(b.column(m) for m in more)], names=names)

    return map_batches(rows, run, schema)


def without_repeats(docs: DataFrame, *more: str, words: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans and the columns ``more``, for every row."""
    spans = repeated_spans(docs, words=words, **options)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *more)
    return _cut_texts(rows.join(spans, ["doc", "hash"], "left").select("doc_id", "text", "spans", *more), more, words, False)


def without_repeats_and_passages(docs: DataFrame, *more: str, passage_words: int = PASSAGE_WORDS, passage_gram: int = PASSAGE_GRAM, **options) -> DataFrame:
    """The columns of ``without_repeats`` by bytes, and then, of the same texts, those of passages by words.

    A word goes with a string of ``passage_words`` words that starts anywhere else too, whatever its
    bytes and the space between its words: n_passages maximal runs of such words with
    n_passage_words words in all, and text_without_passages, which is the text without these alone.
    """

    def settled(**how) -> DataFrame:
        # Of one search only its spans are left when the next one begins.
        with passing(docs.sparkSession) as keep:
            return cut(repeated_spans(docs, cut=keep, **how))

    spans, passages = settled(**options), settled(words=True, length=passage_words, gram=passage_gram)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *more)
    found = spans.join(passages.withColumnRenamed("spans", "passages"), ["doc", "hash"], "full")
    return _cut_texts(rows.join(found, ["doc", "hash"], "left").select("doc_id", "text", "spans", "passages", *more), more, False, True)
