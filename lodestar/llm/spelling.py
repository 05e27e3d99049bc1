"""Spelling variant grouping (operator 11).

Words that occur often enough make a sorted vocabulary, cut into shards that are
tries of bounded size.  The tries are broadcast a few at a time, and each word's
distance-one Levenshtein automaton is run against every one of them depth-first: at
each place of a word the ways with one error are followed to their ends before the
error-free way goes one letter deeper.  Words travel in batches, as rows of
arrays, so that a step is a few array operations for thousands of words.

Of each word and shard only the number of accepting neighbours and the best
one leave a task; sums and maxima over shards do the rest.  A word's form has at
least twice its count, so that chains of forms end after 63 links, and doubling
the links finds all roots in seven rounds at most.

An edit in a run of equal letters is tried at the run's end only (removing any
of them, or adding one more anywhere, gives the same word), so every neighbour is
met once and a very long word costs steps in proportion to its length.

Letters are those of the contract, A-Z, a-z and U+00C0 to U+00FF, so a word in
Latin-1 has a byte for each code point and sorts as its code points do.

Defined results: a null, empty or letterless text has no words; a null doc_id counts as
the empty text in the hash; a very long text or word is taken whole; repeated rows
count as often as they occur; of near words that tie the smallest is the form;
other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, map_batches

#: Fixed values of the contract.
RUN = re.compile("[a-zÀ-ÿ]+")
DELETE_EVERY, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Words and letters in a trie at most (one longer word is a trie by itself): about 13 bytes a letter.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 19
#: Bytes of tries that are broadcast at a time (or one trie).
ROUND_BYTES = 24 << 20
#: Words that go through a trie together, and letters of them at most.
BATCH_WORDS, BATCH_LETTERS = 4096, 1 << 16


def observed(doc_id: int | None, text: str) -> Counter:
    """Counts of a text's words, some of which lose a letter; ``text`` has its A-Z lowered."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b for whole in batches for b in chunks(whole, limit=4 << 20)):
        total: Counter = Counter()
        for doc_id, text in zip(b.column("doc_id").to_pylist(), pc.ascii_lower(b.column("text"))):
            total.update(observed(doc_id, text.as_py() or ""))
        words = [w for w in total if len(w) >= MIN_LENGTH]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, _counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Trie:
    """Nodes level by level, so that the children of one are neighbours, in the order of their letters."""

    def __init__(self, labels: np.ndarray, first_child: np.ndarray, counts: np.ndarray) -> None:
        self.labels = labels  # uint8, of nodes 1...
        self.first_child = first_child  # int32, nodes + 1: the children of i are first_child[i]:first_child[i + 1]
        self.counts = counts  # int64, 0 where no word ends
        self.keys = np.repeat(np.arange(len(first_child) - 1, dtype=np.int64), np.diff(first_child)) << 8 | labels

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray) -> Trie:
        """From distinct words in order."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        node, base = np.zeros(len(words), np.int64), 1
        keys, all_ends = [], [np.zeros(1, np.int64)]
        on = np.arange(len(words))
        for depth in range(int(lengths.max(initial=0))):
            on = on[lengths[on] > depth]
            key = node[on] << 8 | letters[starts[on] + depth]
            new = np.ones(len(on), bool)
            new[1:] = key[1:] != key[:-1]
            node[on] = base + np.cumsum(new) - 1
            keys.append(key[new])
            ends = np.zeros(int(new.sum()), np.int64)
            done = on[lengths[on] == depth + 1]
            ends[node[done] - base] = counts[done]
            all_ends.append(ends)
            base += len(ends)
        every = np.concatenate([*keys, np.zeros(0, np.int64)])
        return cls((every & 255).astype(np.uint8), (np.searchsorted(every, np.arange(base + 1, dtype=np.int64) << 8) + 1).astype(np.int32), np.concatenate(all_ends))

    def pack(self) -> bytes:
        return len(self.labels).to_bytes(8, "little") + self.labels.tobytes() + self.first_child.tobytes() + self.counts.tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        n = int.from_bytes(blob[:8], "little")
        part = lambda kind, size, at: np.frombuffer(blob, kind, size, at).copy()  # noqa: E731  aligned
        return cls(part(np.uint8, n, 8), part(np.int32, n + 2, 8 + n), part(np.int64, n + 1, 8 + n + 4 * (n + 2)))

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        key = nodes << 8 | letters
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        return np.where(hit, at + 1, -1)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of some nodes: the place in ``nodes`` of each, and the child."""
        lo, n = self.first_child[nodes].astype(np.int64), (self.first_child[nodes + 1] - self.first_child[nodes]).astype(np.int64)
        of = np.repeat(np.arange(len(nodes)), n)
        return of, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(of))


DELETED, INSERTED, REPLACED = 0, 1, 2


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """All words of the trie at distance one: index of the word, kind of edit, its place, the letter that came in, the neighbour's count."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters, starts = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
    found: list[tuple[np.ndarray, ...]] = []
    on, node = np.arange(len(words)), np.zeros(len(words), np.int64)
    for i in range(int(lengths.max(initial=0)) + 1):
        left = lengths[on] - i
        own = np.where(left > 0, letters[starts[on] + np.minimum(i, lengths[on] - 1)], -1)
        after = np.where(left > 1, letters[starts[on] + np.minimum(i + 1, lengths[on] - 1)], -1)
        cut_at = np.flatnonzero((left > 0) & (own != after))  # the last of equal letters goes
        of, child = trie.children(node)
        label = trie.labels[child - 1].astype(np.int64)
        other = label != own[of]
        more, swap = np.flatnonzero(other), np.flatnonzero(other & (left[of] > 0))
        w = np.concatenate([on[cut_at], on[of[more]], on[of[swap]]])
        at = np.concatenate([node[cut_at], child[more], child[swap]])
        kind = np.repeat([DELETED, INSERTED, REPLACED], [len(cut_at), len(more), len(swap)])
        came = np.concatenate([np.zeros(len(cut_at), np.int64), label[more], label[swap]])
        place = np.where(kind == INSERTED, i, i + 1)  # of the letter to read next
        while len(w):
            over = place == lengths[w]
            end = over & (trie.counts[at] > 0)
            if end.any():
                found.append((w[end], kind[end], np.full(int(end.sum()), i), came[end], trie.counts[at[end]]))
            go = np.flatnonzero(~over)
            at = trie.step(at[go], letters[starts[w[go]] + place[go]])
            live = at >= 0
            go, at = go[live], at[live]
            w, kind, came, place = w[go], kind[go], came[go], place[go] + 1
        go = np.flatnonzero(left > 0)
        nxt = trie.step(node[go], own[go])
        on, node = on[go][nxt >= 0], nxt[nxt >= 0]
        if not len(on):
            break
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def edited(word: bytes, kind: int, at: int, letter: int) -> bytes:
    return word[:at] + (b"" if kind == DELETED else bytes([letter])) + word[at + (kind != INSERTED) :]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[bytes] = []
    counts: list[int] = []
    size = 0

    def packed() -> pa.RecordBatch:
        order = sorted(range(len(words)), key=words.__getitem__)
        trie = Trie.of([words[i] for i in order], np.array(counts, np.int64)[order])
        return pa.record_batch([pa.array([trie.pack()], pa.binary())], names=["trie"])

    for b in batches:
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            if words and (len(words) == SHARD_WORDS or size + len(word) > SHARD_LETTERS):
                yield packed()
                words, counts, size = [], [], 0
            words.append(word.encode("latin-1"))
            counts.append(n)
            size += len(word)
    if words:
        yield packed()


NEAR = "word string, n_near long, form_n long, form string"


def _near(sent: Broadcast):
    """Number and best of the neighbours that each word has in the tries of a broadcast."""

    def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for b in rows:
            words = sorted((w.encode("latin-1") for w in b.column("word").to_pylist()), key=len)  # one long word does not hold up many short ones
            some, size = [], 0
            for w in words:
                if some and (len(some) == BATCH_WORDS or size + len(w) > BATCH_LETTERS):
                    yield some
                    some, size = [], 0
                some.append(w)
                size += len(w)
            if some:
                yield some

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Trie.unpack(t) for t in sent.value]
        for words in batches_of(rows):
            n_near, best = [0] * len(words), [(1, b"")] * len(words)  # (-count, neighbour), least first
            for shard in shards:
                for w, kind, at, letter, n in zip(*(x.tolist() for x in neighbours(shard, words))):
                    n_near[w] += 1
                    if -n <= best[w][0]:
                        best[w] = min(best[w], (-n, edited(words[w], kind, at, letter)))
            some = [i for i, n in enumerate(n_near) if n]
            text = lambda xs: pa.array([x.decode("latin-1") for x in xs], pa.string())
            yield pa.record_batch([text(words[i] for i in some), pa.array([n_near[i] for i in some], pa.int64()), pa.array([-best[i][0] for i in some], pa.int64()), text(best[i][1] for i in some)], names=["word", "n_near", "form_n", "form"])

    return run


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n_near and its best near word (best, best_n), of the words of a written table that have any."""
    spark, n = vocab.sparkSession, vocab.count()
    # A partition of the sorted words for each few tries; words are dealt out by themselves.
    spread = max(spark.sparkContext.defaultParallelism, n // (4 * BATCH_WORDS))
    shards = cut(map_batches(vocab.repartitionByRange(max(1, n // SHARD_WORDS), "word").sortWithinPartitions("word"), _tries, "trie binary"))
    words, found, some, size = cut(vocab.repartition(spread, "word")), [], [], 0

    def round_of(tries: list[bytes]) -> DataFrame:
        sent = spark.sparkContext.broadcast(tries)
        out = cut(map_batches(words, _near(sent), NEAR))
        sent.destroy()
        return out

    for row in shards.toLocalIterator():  # one partition of tries at a time
        if some and size + len(row["trie"]) > ROUND_BYTES:
            found.append(round_of(some))
            some, size = [], 0
        some.append(bytes(row["trie"]))
        size += len(row["trie"])
    if some:
        found.append(round_of(some))
    every = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("minus_n"), "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("best"), (-F.col("b.minus_n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form (word, form): links are doubled until none is left to follow."""
    links, left = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))), True
    while left:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        left = bool(links.where("moved").limit(1).count())
    return links.select("word", "root")


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = cut(vocabulary(docs))
    strong = F.col("best_n") >= RATIO * F.col("n")
    judged = vocab.join(near_words(vocab), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    judged = cut(judged)
    return judged.join(roots(judged.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
