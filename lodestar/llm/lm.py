"""Language-model scoring with a log-frequency Bloom filter (operator 4).

All words and all bigrams of the training texts are counted; the tables grow with
the input and none has a bound or a least count.  A bigram of quantised count
q = 1 + floor(log2 c) enters the filter as (bigram, 1) ... (bigram, q).  To look
one up, (bigram, 1), (bigram, 2), ... are probed until one is missing; the last
found gives back 2 ** (q - 1), at most the counts of the two words.  Smoothing is
Witten and Bell's: with T(a) different words seen after a,
P(b | a) = (found(a, b) + T(a) * P1(b)) / (count(a) + T(a)), and
P1(b) = (count(b) + 1) / (N + V + 1); of an unseen word a, P(b | a) = P1(b).

The filter is a table of segments, as many as the tokens ask for.  A segment holds
the counts of the words whose 64-bit hash falls to it (the table tells them apart by 48 bits) and the bits of the bigrams
that begin with them, by 32 bits of hash (a segment holds about a million, so this
adds less than the filter's own false answers).  The bigrams of a hot word are
spread over several segments by the word after it.  Tables of at most
``max_bytes`` are broadcast.  A larger one has no bound by which it could be sent
to every task, so each piece of text asks the segments for its different words
and bigrams, a task answers all that came to a segment in one reading, and the
answers go back.  Both ways ask the same bits and give the same scores.

Words are told apart by their segment and 48 bits of hash, some of which choose the
segment: of 100 million words about 18 pairs are expected to share the bits, and such a
pair counts as one word where it shares the segment, as it always does if the number of segments
is a power of two up to 65,536.

Defined results: a null text is the empty text, scored as its end alone;
without training documents every count is 0; repeated rows score alike; a very
long text is scored whole; equal counts have equal levels, so there are no ties
to settle; other columns are not read, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, chunks, cut, doc_text, hash_strings, map_batches, mix

#: Bytes of a filter's table that may be broadcast, and tokens for each of its segments.
MAX_BYTES, SEGMENT_TOKENS = 32 << 20, 1 << 20
BITS_PER_ITEM, HASHES = 12, 6
END_WORD = "\n"  # no word holds a line end
#: Bytes of text whose words are counted or scored together.
PIECE = 4 << 20
#: Words of at least this share of all tokens are looked at for spreading: at most 65,536.
HOT_SHARE = 2.0**-16
#: A spread word has about this part of a segment's tokens in each.
HOT_PART = 16
#: Bytes that a segment answers in a row; more are shared out over copies of it.
PROBE_BYTES = 64 << 20
#: Bytes of a word's hash within its segment.
WORD_BYTES = 6
WORD_BITS = np.uint64((1 << 8 * WORD_BYTES) - 1)
#: Bytes of answers in a batch.
ANSWER_BYTES = 4 << 20
#: Bigrams of a segment that are held before equal ones are summed.
HELD = 1 << 20


def places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    first = mix(keys.astype(np.uint64) + mix(np.uint64(level) * np.ones(1, np.uint64))[0])
    step = mix(first) | np.uint64(1)
    for i in range(HASHES):
        yield ((first + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)


def segment_bits(keys: np.ndarray, q: np.ndarray, bits_per_item: int = BITS_PER_ITEM) -> np.ndarray:
    """The bits of a segment that holds ``keys`` at the levels 1 to ``q``."""
    bits = np.zeros(max(64, -(-int(q.sum()) * bits_per_item // 8) * 8), bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(keys[q >= level], level, len(bits)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def levels(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The highest level of each bigram such that it and all below are found."""
    out = np.zeros(len(keys), np.uint8)
    todo, level = np.arange(len(keys)), 1
    while len(todo) and level < 64:
        ok = np.ones(len(todo), bool)
        for at in places(keys[todo], level, len(bits) * 8):
            ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        todo = todo[ok]
        out[todo] = level
        level += 1
    return out


@dataclass
class Segments:
    """Where words and bigrams go."""

    n: int
    hot: np.ndarray  # sorted hashes of spread words
    spread: np.ndarray  # over how many segments

    def spread_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, hashes), max(0, len(self.hot) - 1))
        return np.where(self.hot[at] == hashes, self.spread[at], 1).astype(np.int32) if len(self.hot) else np.ones(len(hashes), np.int32)


@dataclass
class Piece:
    """Tokens of some texts, an end after each; codes of words are in the order of their segments."""

    tokens: np.ndarray
    n_tokens: np.ndarray  # by text
    hashes: np.ndarray  # by code
    home: np.ndarray  # by code: segment
    spread: np.ndarray  # by code

    @staticmethod
    def of(texts: pa.Array, segments: Segments) -> Piece:
        t = Tokens(texts, lower=True)
        hashes = np.append(t.word_hashes(), hash_strings(pa.array([END_WORD])))
        n = t.counts() + 1
        tokens = np.full(int(n.sum()), len(t.words), np.int64)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(n) - 1] = False
        tokens[inner] = t.codes
        home = ((hashes >> np.uint64(32)) % np.uint64(segments.n)).astype(np.int32)
        hashes &= WORD_BITS
        order = np.argsort(home, kind="stable")
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        return Piece(code[tokens], n, hashes[order], home[order], segments.spread_of(hashes[order]))


@dataclass
class Bigrams:
    """The different bigrams of a piece by segment, then word, and that of each token; a text begins after an end."""

    a: np.ndarray
    b: np.ndarray
    segment: np.ndarray
    counts: np.ndarray
    of: np.ndarray  # by token

    @staticmethod
    def in_piece(tokens: np.ndarray, home: np.ndarray, spread: np.ndarray, segments: int) -> Bigrams:
        before = np.concatenate([tokens[-1:], tokens[:-1]])  # the last token is an end
        pairs, of, counts = np.unique(before * len(home) + tokens, return_inverse=True, return_counts=True)
        a, b = np.divmod(pairs, len(home))
        segment = (home[a].astype(np.int64) + home[b] % spread[a]) % segments
        order = np.argsort(segment, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Bigrams(a[order], b[order], segment[order], counts[order], rank[of])

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes[self.a] * np.uint64(3) + mix(hashes[self.b])) >> np.uint64(32)).astype(np.uint32)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _pack(x: np.ndarray, n: int = 8) -> bytes:
    """The lowest ``n`` bytes of 64-bit integers, all first bytes before all second ones, as high bytes are mostly 0 and compress well."""
    return _blob(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T[:n])


def _unpack(raw: bytes, n: int = 8) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view(np.int64).ravel()


def _words(raw: bytes) -> np.ndarray:
    return _unpack(raw, WORD_BYTES).view(np.uint64)


@dataclass
class Model:
    total: int  # N
    distinct: int  # V
    segments: Segments
    hot: dict[int, tuple[int, int]]  # of spread words, by hash: count, and different words seen after it
    table: DataFrame  # segment, bits, words (hashes), c, t
    sent: dict[int, tuple[np.ndarray, ...]] | None  # the table, if its size allows to send it


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that are frequent in a piece, and as null its tokens.  What is frequent in all texts is so in some piece."""
    end = hash_strings(pa.array([END_WORD]))
    for whole in batches:
        for b in chunks(whole, limit=PIECE):
            t = Tokens(b.column("text"), lower=True)
            n = np.append(np.bincount(t.codes, minlength=len(t.words)), t.n_rows)
            found = n >= max(2, HOT_SHARE * n.sum())
            hashes = (np.append(t.word_hashes(), end) & WORD_BITS).astype(np.int64)[found]
            yield pa.record_batch([pa.array([None, *hashes.tolist()], pa.int64()), pa.array([int(n.sum()), *n[found].tolist()], pa.int64())], names=["h", "c"])


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal (word, key) in one."""
    words, keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((keys, words))
    words, keys, counts = words[order], keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (keys[1:] != keys[:-1])]))
    return words[first], keys[first], np.add.reduceat(counts, first)


def train(docs: DataFrame, *, max_bytes: int = MAX_BYTES, segment_tokens: int = SEGMENT_TOKENS, bits_per_item: int = BITS_PER_ITEM) -> Model:
    """Learn from all of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    frequent = cut(map_batches(texts, _frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    total = (frequent.where("h IS NULL").first() or {"c": 0})["c"]
    n = max(1, -(-total // segment_tokens))
    least = max(HOT_SHARE * total, segment_tokens / HOT_PART)
    found = frequent.where("h IS NOT NULL").where(F.col("c") > least).collect() if n > 1 else []  # at most 1 / HOT_SHARE
    hot = sorted((r["h"], min(n, -(-r["c"] * HOT_PART // segment_tokens))) for r in found)
    segments = Segments(n, np.array([h for h, _ in hot], np.uint64), np.array([f for _, f in hot], np.int64))
    shared = spark.sparkContext.broadcast(segments)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, limit=PIECE):
                p = Piece.of(b.column("text"), shared.value)
                g = Bigrams.in_piece(p.tokens, p.home, p.spread, n)
                keys, own = g.keys(p.hashes), np.flatnonzero(np.concatenate([[True], (g.a[1:] != g.a[:-1]) | (g.segment[1:] != g.segment[:-1])]))
                size = np.diff(np.append(own, len(keys)))
                at, first = np.unique(g.segment, return_index=True)
                run = np.append(np.searchsorted(own, first), len(own))
                first = np.append(first, len(keys))
                cols = {"words": [], "sizes": [], "keys": [], "counts": []}
                for i in range(len(at)):
                    r, k = slice(run[i], run[i + 1]), slice(first[i], first[i + 1])
                    cols["words"].append(_pack(p.hashes[g.a[own[r]]], WORD_BYTES))
                    cols["sizes"].append(_pack(size[r], 4))
                    cols["keys"].append(_blob(keys[k]))
                    cols["counts"].append(_blob(g.counts[k].astype(np.uint32)))
                yield pa.record_batch([pa.array(at, pa.int64()), *(pa.array(x, pa.binary()) for x in cols.values())], names=["segment", *cols])

    def built(segment: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """A row of the table, and one for each spread word met."""
        words, keys, counts = _summed(parts)
        bits = segment_bits(keys, np.frexp(counts.astype(float))[1], bits_per_item)
        word, first = np.unique(words, return_index=True)
        c, t = np.add.reduceat(counts, first), np.diff(np.append(first, len(words)))
        is_hot = shared.value.spread_of(word) > 1
        m, rest = int(is_hot.sum()), ~is_hot
        row = [pa.array([segment] + [None] * m, pa.int64())]
        row += [pa.array([x] + [None] * m, pa.binary()) for x in (bits.tobytes(), _pack(word[rest], WORD_BYTES), _pack(c[rest]), _pack(t[rest]))]
        row += [pa.array([None, *x.tolist()], pa.int64()) for x in (word.view(np.int64)[is_hot], c[is_hot], t[is_hot])]
        return pa.record_batch(row, names=["segment", "bits", "words", "c", "t", "hot", "hot_c", "hot_t"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments come one after another; equal bigrams are summed as they come."""
        segment, parts, held, limit = None, [], 0, HELD
        for b in batches:
            for at, words, sizes, keys, counts in _rows(b, "segment", "words", "sizes", "keys", "counts"):
                if at != segment and parts:
                    yield built(segment, parts)
                    parts, held, limit = [], 0, HELD
                segment = at
                words = np.repeat(_words(words), _unpack(sizes, 4))
                parts.append((words, np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64)))
                held += len(words)
                if held > limit:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    limit = max(HELD, 2 * held)
        if parts:
            yield built(segment, parts)

    asked = map_batches(texts, bigrams, "segment long, words binary, sizes binary, keys binary, counts binary")
    schema = "segment long, bits binary, words binary, c binary, t binary, hot long, hot_c long, hot_t long"
    out = cut(map_batches(asked.repartition("segment").sortWithinPartitions("segment"), build, schema))
    table = out.where("segment IS NOT NULL").select("segment", "bits", "words", "c", "t")
    spread = {r["hot"]: (r["c"], r["t"]) for r in out.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("hot_c").alias("c"), F.sum("hot_t").alias("t")).collect()}
    size = table.agg(F.sum(F.octet_length("words")).alias("words"), F.sum(F.octet_length("bits")).alias("bits")).first()
    sent = None
    if (size["bits"] or 0) + 4 * (size["words"] or 0) <= max_bytes:
        sent = {r["segment"]: _held(r["bits"], r["words"], r["c"], r["t"]) for r in table.collect()}
    return Model(total, (size["words"] or 0) // WORD_BYTES + len(spread), segments, spread, table, sent)


def _held(bits: bytes, words: bytes, c: bytes, t: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(bits, np.uint8), _words(words), _unpack(c), _unpack(t)


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Row by row, so that a batch is not copied whole."""
    columns = [b.column(x) for x in names]
    return (tuple(c[i].as_py() for c in columns) for i in range(b.num_rows))


def _answer(held: tuple[np.ndarray, ...] | None, words: bytes, keys: bytes) -> tuple[bytes, bytes, bytes]:
    """Levels of bigrams, counts of words and of what follows them (0 if unseen)."""
    words, keys = _words(words), np.frombuffer(keys, np.uint32)
    c, t = np.zeros((2, len(words)), np.int64)
    if held is None:
        return _blob(np.zeros(len(keys), np.uint8)), _pack(c), _pack(t)
    bits, known, known_c, known_t = held
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        same = known[at] == words
        c, t = np.where(same, known_c[at], 0), np.where(same, known_t[at], 0)
    return _blob(levels(bits, keys)), _pack(c), _pack(t)


def _batches(answers: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in answers:
        held.append(row)
        size += sum(map(len, row[2:]))
        if size > ANSWER_BYTES:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _answers(asked: DataFrame, model: Model, tokens: int) -> DataFrame:
    """piece, at (segment), levels, c and t of what pieces ask (piece, at, words, keys); ``tokens`` bounds how much that is."""
    schema = "piece long, at long, levels binary, c binary, t binary"
    fields = pa.schema([("piece", pa.int64()), ("at", pa.int64()), ("levels", pa.binary()), ("c", pa.binary()), ("t", pa.binary())])
    if model.sent is not None:
        sent = asked.sparkSession.sparkContext.broadcast(model.sent)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for row in _rows(b, "piece", "at", "words", "keys"))
            yield from _batches(((piece, at, *_answer(sent.value.get(at), words, keys)) for piece, at, words, keys in rows), fields)

        return map_batches(asked, look, schema)
    copies = max(1, -(-tokens * 12 // (model.segments.n * PROBE_BYTES)))
    none = F.lit(None).cast("binary")
    asked = asked.select("piece", "at", F.pmod(F.hash("piece"), F.lit(copies)).alias("copy"), F.lit(1).alias("turn"), "words", "keys", none.alias("c"), none.alias("t"))
    held = model.table.select(F.lit(None).cast("long").alias("piece"), F.col("segment").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("turn"), "words", F.col("bits").alias("keys"), "c", "t")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        segment, held = None, None
        for b in batches:
            for piece, at, turn, words, keys, c, t in _rows(b, "piece", "at", "turn", "words", "keys", "c", "t"):
                if turn == 0:
                    segment, held = at, _held(keys, words, c, t)
                else:
                    yield piece, at, *_answer(held if segment == at else None, words, keys)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(answered(batches), fields)

    return map_batches(asked.unionByName(held).repartition("at", "copy").sortWithinPartitions("at", "copy", "turn"), probe, schema)


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row, and the columns ``more``."""
    n, total, all_mass = model.segments.n, model.total, float(model.total + model.distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast((model.segments, model.hot))
    named = doc_text(docs, *more).withColumn("piece", F.monotonically_increasing_id())
    kinds = dict(named.dtypes)
    head = "array<struct<doc_id:bigint,n_tokens:bigint" + "".join(f",`{c}`:{kinds[c]}" for c in more) + ">>"
    blobs = ["tokens", "home", "spread", "hashes", "hot"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, limit=PIECE):
                segments, hot = shared.value
                p = Piece.of(b.column("text"), segments)
                stats = np.array([hot.get(h, (0, 0)) for h in p.hashes[p.spread > 1].tolist()], np.int64)
                texts = pa.StructArray.from_arrays([b.column("doc_id"), pa.array(p.n_tokens, pa.int64()), *(b.column(c) for c in more)], names=["doc_id", "n_tokens", *more])
                parts = [_pack(p.tokens, 4), _blob(p.home), _blob(p.spread), _pack(p.hashes, WORD_BYTES), _blob(stats)]
                yield pa.record_batch([b.column("piece").slice(0, 1), *(pa.array([x], pa.binary()) for x in parts), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)], names=["piece", *blobs, "heads"])

    def read(tokens: bytes, home: bytes, spread: bytes) -> tuple[np.ndarray, Bigrams, np.ndarray, np.ndarray]:
        tokens = _unpack(tokens, 4)
        home, spread = np.frombuffer(home, np.int32), np.frombuffer(spread, np.int32)
        return tokens, Bigrams.in_piece(tokens, home, spread, n), home, spread

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, tokens, home, spread, hashes in _rows(b, "piece", *blobs[:4]):
                _, g, home, spread = read(tokens, home, spread)
                hashes = _words(hashes)
                keys, words, at = g.keys(hashes), hashes[spread == 1], home[spread == 1]
                to = np.union1d(g.segment, at)
                k, w = ((np.searchsorted(x, to), np.searchsorted(x, to, "right")) for x in (g.segment, at))
                yield pa.record_batch(
                    [pa.array(np.full(len(to), piece), pa.int64()), pa.array(to, pa.int64()), pa.array([_pack(words[x:y], WORD_BYTES) for x, y in zip(*w)], pa.binary()), pa.array([_blob(keys[x:y]) for x, y in zip(*k)], pa.binary())],
                    names=["piece", "at", "words", "keys"],
                )

    pieces = cut(map_batches(named, spread, f"piece long, {', '.join(f'{c} binary' for c in blobs)}, heads {head}"))
    tokens = (pieces.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 4
    answers = _answers(map_batches(pieces.select("piece", *blobs[:4]), ask, "piece long, at long, words binary, keys binary"), model, tokens)
    body, answer = ["tokens", "home", "spread", "hot"], ["levels", "c", "t"]
    none = F.lit(None)
    together = pieces.select("piece", none.cast("long").alias("at"), *body, *(none.cast("binary").alias(c) for c in answer), "heads").unionByName(
        answers.select("piece", "at", *(none.cast("binary").alias(c) for c in body), *answer, none.cast(head).alias("heads"))
    )

    def finish(group: pa.Table) -> pa.Table:
        at = group.column("at").to_pylist()
        row = at.index(None)
        texts = group.slice(row, 1).column("heads").combine_chunks().flatten()
        tokens, g, _, spread = read(*(group.column(c)[row].as_py() for c in body[:3]))
        parts = sorted((i for i in range(len(at)) if i != row), key=at.__getitem__)
        q, own_c, own_t = (np.concatenate([f(group.column(c)[i].as_py()) for i in parts]) for c, f in (("levels", lambda x: np.frombuffer(x, np.uint8)), ("c", _unpack), ("t", _unpack)))
        hot = np.frombuffer(group.column("hot")[row].as_py(), np.int64).reshape(-1, 2)
        c, t = np.zeros((2, len(spread)))
        c[spread == 1], t[spread == 1] = own_c, own_t
        c[spread > 1], t[spread > 1] = hot.T
        share, after = (c + 1) / all_mass, np.maximum(t, 1)
        seen = np.minimum(np.where(q > 0, 2.0 ** (q.astype(float) - 1), 0.0), np.minimum(c[g.a], c[g.b]))
        step = np.log10((seen + after[g.a] * share[g.b]) / (c[g.a] + after[g.a]))
        n_tokens = texts.field("n_tokens").to_numpy()
        text = np.repeat(np.arange(len(n_tokens)), n_tokens)
        add = lambda w: np.bincount(text, w, len(n_tokens))
        out = {"doc_id": texts.field("doc_id"), "n_tokens": texts.field("n_tokens"), "n_known": pa.array(add(c[tokens] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(n_tokens), total), pa.int64())}
        out |= {"base_score": pa.array(add(np.log10(share)[tokens])), "score": pa.array(add(step[g.of]))}
        return pa.table(out | {x: texts.field(2 + i) for i, x in enumerate(more)})

    # A group is a piece: at most PIECE bytes of text, or one text, and its answers.
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return together.groupBy("piece").applyInArrow(finish, schema)
