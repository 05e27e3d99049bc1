"""Merkle-tree fingerprints of documents (operator 6).

A text is a root over sections (split at blank lines), a section a node over
paragraphs (lines), a paragraph a node over leaves (sentences, cut further
after a word whose checksum says so, about every eight words, so that a long
sentence has several).  Leaves keep every character, and each level is hashed
apart, so equal roots mean equal texts and, from the root down, only branches
with different hashes need be followed to the leaves that were edited.

The likeness of two trees is the share of leaf characters, counted as a
multiset of leaf hashes, that both hold: 2 * common / (all of both).  An edit is
located by following, from the front and from the back, the branches that both
trees hold in the same order.

Defined results: a null text is the empty text, whose tree is a root without
sections; two empty texts have likeness 1; rows with one doc_id follow each
other by text, and equal rows are neighbours; a null doc_id comes first; in a
table of one row the next document is the row itself; a very long text is hashed
whole; of equal paragraphs each is a branch at its own place, so ties have no order to
settle; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, map_batches

LEAF_WORDS = 8
#: Documents in a block of neighbours and in a task; the bounds of blocks pass through the driver, a number each.
BLOCK_DOCS, TASK_DOCS, MAX_BLOCKS = 500, 5_000, 100_000

_SECTION = re.compile(r"(?<=\n)(?=\n)")
_SENTENCE = re.compile(r"(?<=[.!?])(?=[ \t-\r])")
_WORD = re.compile(r"[ \t-\r]*[^ \t-\r]+")


def _digest(level: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()


def leaves(paragraph: str) -> list[str]:
    """Pieces of a paragraph; together they are the paragraph."""
    out = []
    for sentence in _SENTENCE.split(paragraph):
        start = 0
        for m in _WORD.finditer(sentence):
            if m.end() < len(sentence) and zlib.crc32(m[0].encode()) % LEAF_WORDS == 0:
                out.append(sentence[start : m.end()])
                start = m.end()
        out.append(sentence[start:])
    return [x for x in out if x]


#: A paragraph's hash and its leaves' hashes and lengths.
Paragraph = tuple[bytes, list[tuple[bytes, int]]]


def _paragraph(text: str) -> Paragraph:
    own = [(_digest(b"leaf", [x.encode()]), len(x)) for x in leaves(text)]
    return _digest(b"paragraph", [h for h, _ in own]), own


@dataclass
class Tree:
    root: str
    leaf_chars: Counter[bytes]  # characters under each distinct leaf hash
    paragraphs: dict[str, Paragraph]
    sections: list[tuple[bytes, int, list[str]]]  # hash, characters, paragraphs in order

    @classmethod
    def of(cls, text: str, *near: Tree) -> Tree:
        """The tree of a text; paragraphs that trees ``near`` hold are not hashed again."""
        chars: Counter[bytes] = Counter()
        held: dict[str, Paragraph] = {}
        sections = []
        for section in _SECTION.split(text) if text else ():
            hashes, lines = [], section.split("\n")
            for line in lines:
                node = held.get(line) or next((t.paragraphs[line] for t in near if line in t.paragraphs), None) or _paragraph(line)
                held[line] = node
                hashes.append(node[0])
                for h, n in node[1]:
                    chars[h] += n
            sections.append((_digest(b"section", hashes), len(section), lines))
        return cls(_digest(b"root", [h for h, *_ in sections]).hex(), chars, held, sections)


def _alike(a: Tree, b: Tree, step: int) -> int:
    """Characters under the branches that two trees share from the front (``step`` 1) or the back (-1): equal sections, then equal paragraphs of the first that differ, then equal leaves."""
    n = i = 0
    x, y = a.sections[::step], b.sections[::step]
    while i < min(len(x), len(y)) and x[i][0] == y[i][0]:
        n, i = n + x[i][1], i + 1
    if i == min(len(x), len(y)):
        return n
    p, q = x[i][2][::step], y[i][2][::step]
    i = 0
    while i < min(len(p), len(q)) - 1 and p[i] == q[i]:  # paragraphs with something between them and the next
        n, i = n + len(p[i]) + 1, i + 1
    for (g, size), (h, _) in zip(a.paragraphs[p[i]][1][::step], b.paragraphs[q[i]][1][::step]):
        if g != h:
            break
        n += size
    return n


def located(a: Tree, b: Tree) -> tuple[int, int] | None:
    """Where in the text of ``b`` the branches are that differ from ``a``: from the first to the last, to the leaf; None if the roots are equal."""
    if a.root == b.root:
        return None
    sizes = [sum(s[1] for s in t.sections) for t in (a, b)]
    front = _alike(a, b, 1)
    back = min(_alike(a, b, -1), min(sizes) - front)
    return front, sizes[1] - back


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    total = a.leaf_chars.total() + b.leaf_chars.total()
    return 2 * (a.leaf_chars & b.leaf_chars).total() / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_end long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the one after it in its block; a row with ``guest`` only follows."""
    before: tuple | None = None
    for b in batches:
        out = []
        for block, doc_id, text, guest in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "text", "guest"))):
            text = text or ""
            tree = Tree.of(text)
            if before and before[0] == block and not before[3]:
                _, old_id, old, _, old_tree = before
                changed = edited(old, text)
                new = Tree.of(changed, old_tree, tree)
                out.append((old_id, len(old), hashlib.sha256(changed.encode()).hexdigest(), old_tree.root, new.root, likeness(old_tree, new), likeness(old_tree, tree), *(located(old_tree, new) or (None, None))))
            before = (block, doc_id, text, guest, tree)
        cols = list(zip(*out)) if out else [[]] * 9
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame, *, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The columns OUT for every document.

    Documents are dealt into blocks of neighbouring ids; the bounds come from
    approximate quantiles of the ids (one number per block on the driver).  The
    first documents of a block go a second time, as guests, to the block before
    it, so every row meets its successor in one shuffle of the texts.
    """
    spark = docs.sparkSession
    named = doc_text(docs)
    ids = named.select("doc_id")
    n = ids.count()
    blocks = max(1, min(n // block_docs, MAX_BLOCKS))
    bounds = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    cuts = [int(x) for x in bounds]
    sent = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([0 if d is None else bisect_right(sent.value, d) for d in b.column("doc_id").to_pylist()], pa.int64())], names=[*b.schema.names, "block"])

    firsts = map_batches(ids, place, "doc_id long, block long").groupBy("block").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("block").collect()
    if not firsts:
        return spark.createDataFrame([], OUT)
    order = [r["block"] for r in firsts]
    # Which earlier block takes a guest, by the id that is first in a block.
    host = {(None if r["nulls"] else r["first"]): order[i - 1] for i, r in enumerate(firsts)}
    last = max(order) + 1
    hosts = spark.sparkContext.broadcast(host)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their block, and guests. Round the end, the first document follows the last block's rows."""
        for b in place(batches):
            at = hosts.value
            doc_ids, home = b.column("doc_id").to_pylist(), b.column("block").to_pylist()
            extra = [i for i, d in enumerate(doc_ids) if d in at]
            pick = [*range(len(doc_ids)), *extra]
            block = [*home, *(at[doc_ids[i]] for i in extra)]
            # A guest from further on or from the start stands after all rows of its host block.
            guest = [False] * len(doc_ids) + [True] * len(extra)
            taken = b.select(["doc_id", "text"]).take(pa.array(pick, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(block, pa.int64()), pa.array(guest, pa.bool_())], names=["doc_id", "text", "block", "guest"])

    dealt = map_batches(named, deal, "doc_id long, text string, block long, guest boolean")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(last, n // TASK_DOCS))
    placed = dealt.repartition(partitions, "block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return map_batches(placed, _neighbours, OUT)
