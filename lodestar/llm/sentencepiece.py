"""SentencePiece encoding and decoding by a shared-prefix forward pass (operator 8).

A text is marked as the library marks it (a mark in front, a mark for every
space) and cut where a mark follows another character: no piece spans such a
place.  The distinct marked words are sorted, which lays them out as a trie in
depth-first order; going from one word to the next keeps the forward states of
their common prefix and extends only the rest.

The model file holds merge ranks, not log-probabilities, so a best-sum path
would not give the ids of the published tokenizer.  The Viterbi lattice is
therefore limited to steps between pieces that stand side by side under the
merges: a piece may follow another only if merging the two together's
characters gives these two again.  Every prefix then has exactly one path, its
last piece is the forward state, and the path of the whole word is what the
library returns.

Defined results: a null or empty text has no ids and decodes to the empty
text.  Characters outside the vocabulary become byte pieces.  A literal U+2581,
which the library turns into a space, is kept as its three bytes, so decoding
always gives the text back.  Repeated rows encode alike.  A very long text, also
of one word, is encoded whole, in time and memory in proportion.  Of equally
ranked merges the leftmost goes first.  Other columns are not read, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_text, map_batches

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A literal mark on its way to byte pieces: no text from Spark holds a lone surrogate.
_LITERAL = "\ud800"
CACHE_WORDS, CACHE_PAIRS = 120_000, 300_000


@dataclass(frozen=True)
class Pieces:
    """The vocabulary of a model: a table of fixed size, sent to every task."""

    texts: tuple[str, ...]
    ranks: tuple[float, ...]
    byte_ids: tuple[int, ...]  # of the 256 byte pieces
    special: frozenset[int]  # control and unknown pieces, which no text yields

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        texts = tuple(sp.id_to_piece(i) for i in ids)
        at = {int(texts[i][1:-1], 16): i for i in ids if sp.is_byte(i)}
        return cls(texts, tuple(sp.get_score(i) for i in ids), tuple(at[b] for b in range(256)), frozenset(i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))

    @cached_property
    def index(self) -> dict[str, int]:
        own = set(self.byte_ids) | self.special
        return {t: i for i, t in enumerate(self.texts) if i not in own}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.index))

    @cached_property
    def alone(self) -> bool:
        """Whether no piece joins a line end to another character."""
        return not any("\n" in t and len(t) > 1 for t in self.index)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces in one array, and where each begins."""
        raw = [b"" if i in self.special else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def merge(pieces: Pieces, text: str) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging of one text (the best-ranked pair first, the leftmost among equals), and the pair merged last."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []
    final = None

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if i >= 0 and j < len(parts):
            both = parts[i] + parts[j]
            at = pieces.index.get(both)
            if at is not None:
                heapq.heappush(heap, (-pieces.ranks[at], i, j, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        final = (parts[i], parts[j])
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None], final


@dataclass
class Encoder:
    """Encodes sorted words; remembers at most CACHE_PAIRS answers of ``fits`` and the edges of each piece."""

    pieces: Pieces
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    edges: tuple[dict[str, list | None], dict[str, list | None]] = field(default_factory=lambda: ({}, {}))

    def edge(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """What stands at an end of a piece (0: its start, 1: its end) while it is merged: (text, rank of the merge that ends it); None if its characters do not merge to it."""
        got = self.edges[side].get(piece, False)
        if got is False:
            parts, halves = merge(self.pieces, piece)
            if len(parts) > 1:
                got = None
            elif halves is None:
                got = [(piece, math.inf)]
            else:
                below = self.edge(halves[side], side)
                got = below and [*below[:-1], (below[-1][0], -self.pieces.ranks[self.pieces.index[piece]]), (piece, math.inf)]
            self.edges[side][piece] = got
        return got

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` (empty at the start): merging the characters of both gives these two.

        A merge ranks behind the merges that made its parts, so merges happen in
        order of rank.  Nothing joins the two if, at each step, what stands at the
        boundary is no piece together, or one that ranks behind the next merge on
        either side (of equal ranks, the one further left comes first).
        """
        x, y = (self.edge(left, 1) if left else []), self.edge(right, 0)
        if x is None or y is None:
            return False
        index, ranks = self.pieces.index, self.pieces.ranks
        i = j = 0
        while x:
            (a, a_ends), (b, b_ends) = x[i], y[j]
            at = index.get(a + b)
            if at is not None and -ranks[at] < a_ends and -ranks[at] <= b_ends:
                return False
            if a_ends == b_ends == math.inf:
                break
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
        return True

    def words(self, words: list[str]) -> list[bytes]:
        """The ids (four bytes each) of each of some sorted, distinct marked words."""
        index, longest, known, coded, out = self.pieces.index, self.pieces.longest, self.pairs, self.coded, []
        before = ""

        def fits(left: str, right: str) -> bool:
            got = known.get((left, right))
            if got is None:
                if len(known) >= CACHE_PAIRS:
                    known.clear()
                got = known[left, right] = self.fits(left, right)
            return got

        ends: list[str] = [""]  # forward states of the prefixes: the last piece, empty after a character without one
        for word in words:
            if word.startswith(MARK * 2):
                out.append(b"".join(map(self.ids, merge(self.pieces, word)[0])))  # runs of marks share one rank, where pairs do not settle the order
                continue
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del ends[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                char = word[j - 1]
                if char not in index:
                    ends.append("")
                    continue
                # One piece alone fits. Often it is the last one and this character.
                piece = ends[-1] + char
                i = j - len(piece)
                if piece not in index or not (known.get((ends[i], piece)) or fits(ends[i], piece)):
                    for i in range(j - longest if j > longest else 0, j):
                        piece = word[i:j]
                        if piece in index:
                            ok = known.get((ends[i], piece))
                            if ok or ok is None and fits(ends[i], piece):
                                break
                ends.append(piece)
            before = word
            path, j = [], len(word)
            while j:
                piece = ends[j]
                if piece:
                    path.append(coded[piece])
                    j -= len(piece)
                else:
                    path.append(self.ids(word[j - 1]))
                    j -= 1
            path.reverse()
            out.append(b"".join(path))
        return out

    @cached_property
    def coded(self) -> dict[str, bytes]:
        return {t: i.to_bytes(4, sys.byteorder) for t, i in self.pieces.index.items()}

    def ids(self, piece: str) -> bytes:
        """The id of a piece, or the byte pieces of a character that is none."""
        got = self.coded.get(piece)
        return got or b"".join(self.pieces.byte_ids[b].to_bytes(4, sys.byteorder) for b in (MARK if piece == _LITERAL else piece).encode())


class Cache:
    """Ids of words met lately: those of the last CACHE_WORDS new words, and those before them that came again."""

    def __init__(self, pieces: Pieces) -> None:
        self.encoder = Encoder(pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if pieces.alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.old: dict[str, bytes] = {}
        self.at: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        if len(self.at) > CACHE_WORDS:
            self.old, self.at = self.at, {}
        at, old = self.at, self.old
        units = [self.cut.findall(MARK + t.replace(MARK, _LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        fresh = []
        for w in {w for us in units for w in us if w not in at}:
            if w in old:
                at[w] = old[w]
            else:
                fresh.append(w)
        fresh.sort()
        at.update(zip(fresh, self.encoder.words(fresh)))
        joined = [b"".join([at[w] for w in us]) for us in units]
        return np.frombuffer(b"".join(joined), np.int32), np.cumsum([0, *(len(x) // 4 for x in joined)])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(starts - (upto - lengths), lengths) + np.arange(total)]


def decode_ids(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw, starts = pieces.table
    lengths = (starts[1:] - starts[:-1])[ids]
    joined = gather(raw, starts[ids], lengths).tobytes()
    at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
    return [joined[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at[:-1], at[1:])]


def encode(docs: DataFrame, *more: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding gives the text back) and the columns ``more``."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    named = doc_text(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        cache = Cache(pieces)
        for whole in batches:
            for b in chunks(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids, offsets = cache.encode(texts)
                same = [a == t for a, t in zip(decode_ids(pieces, ids, offsets), texts)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(same, pa.bool_()), *(b.column(c) for c in more)], names=["doc_id", "n_tokens", "ids", "round_trip", *more])

    return map_batches(named, run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean" + "".join(f", {c} {dict(named.dtypes)[c]}" for c in more))


def decode(encoded: DataFrame, *, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x or [] for x in b.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = decode_ids(sent.value, np.array([i for x in lists for i in x], np.int64), offsets)
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
