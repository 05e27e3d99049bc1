"""JSON-LD documents as rows of nodes.

One row per node in pre-order, with its properties nested; a document that
cannot be read gives one row with ``error`` and no nodes.  This is the only place where
documents pass through Python: nesting has no bound, key order decides which of
two colliding keys wins, and values that are not text are shown as Python
writes them.

Nodes are visited with an explicit stack and leave in batches of bounded size.
A long document that is an array of entities, by itself or under ``@graph``, is read one
entity after another out of its bytes, first to see that all of it can be read, then to
give its nodes, so that what a task holds is the document and one entity.
Entities nested deeper than ``MAX_DEPTH`` are refused, as are lists that Python's JSON reader
finds too deep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.vocabulary import Vocabulary

VALUE = "struct<kind:string,text:string,target:string>"
NODES = f"doc_id string, ord int, path string, node_id string, types array<string>, known array<string>, props array<struct<prop:string,vals:array<{VALUE}>>>, error string"
#: Entities within entities at most.
MAX_DEPTH = 1000
#: Bytes from which a document is read entity by entity.
LONG_BYTES = 4 << 20
#: Values, nodes or characters of values that end a batch.
BATCH_VALUES, BATCH_CHARS = 1 << 15, 4 << 20

#: ord, path, node_id, types, known types, and (kind, text, target) of the values of each property
Node = tuple[int, str, str | None, list[str], list[str], dict[str, list[tuple[str, str, str | None]]]]


@dataclass(frozen=True)
class NestedRef:
    """How an inline object shows in ``repr``."""

    target_path: str
    target_id: str | None


class DocumentError(ValueError):
    pass


def _clean(text: str) -> str:
    """Lone surrogates cannot leave Python; they become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


class Walker:
    """Nodes of entities; remembers how terms and lists of types are written."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.terms, self.known = vocab, {}, {}
        self.maps = {t for t, p in vocab.properties.items() if p.language_map}

    def term(self, iri: str) -> str:
        out = self.terms.get(iri)
        if out is None:
            out = _clean(self.vocab.compact(iri))
            if len(self.terms) < 1 << 16:
                self.terms[iri] = out
        return out

    def nodes(self, entities: Iterable[tuple[str, dict]]) -> Iterator[Node]:
        n = 0
        for start, entity in entities:
            stack = [(entity, start, 1)]
            while stack:
                obj, path, depth = stack.pop()
                if depth > MAX_DEPTH:
                    raise DocumentError(f"entities are nested deeper than {MAX_DEPTH}")
                declared = obj.get("@type") or []
                types = [self.term(t) for t in (declared if isinstance(declared, list) else [declared]) if isinstance(t, str)]
                held: dict[str, list[tuple[str, str, str | None]]] = {}
                below: list[tuple[dict, str, int]] = []
                for key, value in obj.items():
                    if not key.startswith("@"):
                        prop = self.term(key)
                        held[prop] = [self._value(v, prop, path, i, depth, below) for i, v in enumerate(value if isinstance(value, list) else (value,))]
                stack.extend(reversed(below))
                own = obj.get("@id")
                yield n, path, _clean(own) if isinstance(own, str) else None, types, [t for t in types if t in self.vocab.parents], held
                n += 1

    def _value(self, v: Any, prop: str, path: str, i: int, depth: int, below: list) -> tuple[str, str, str | None]:
        if isinstance(v, dict):
            if len(v) == 1 and isinstance(v.get("@id"), str):
                v = v["@id"]
            elif "@value" in v:
                v = v["@value"]
            elif prop not in self.maps:
                at, own = f"{path}.{prop}[{i}]", v.get("@id")
                below.append((v, at, depth + 1))
                return "nested", _clean(repr(NestedRef(at, own if isinstance(own, str) else None))), at
        return ("str", _clean(v), None) if isinstance(v, str) else ("other", _clean(repr(v)), None)


def _entities(data: Any) -> list[tuple[str, dict]]:
    if isinstance(data, dict) and "@graph" in data:
        found, path = data["@graph"], "$.@graph[{}]"
        if not isinstance(found, list):
            raise DocumentError("@graph is not an array")
    elif isinstance(data, dict):
        found, path = [data], "$"
    elif isinstance(data, list):
        found, path = data, "$" if len(data) == 1 else "$[{}]"
    else:
        raise DocumentError("neither an entity, an array of entities nor an object with @graph")
    return [(path.format(i), _entity(i, e)) for i, e in enumerate(found)]


def _entity(i: int, e: Any) -> dict:
    if not isinstance(e, dict):
        raise DocumentError(f"entity {i} is not an object")
    return e


_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]', re.S)
_OPEN, _CLOSE, _COMMA, _COLON, _QUOTE = b"[{", b"]}", ord(","), ord(":"), ord('"')


def _parts(raw: memoryview, at: int) -> Iterator[tuple[int, int]]:
    """Where the members of the array or object that starts at ``at`` are; a last span, of which the start is its end, gives where it closes."""
    depth, start = 0, at + 1
    for m in _TOKEN.finditer(raw, at):
        c = raw[m.start()]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if not depth:
                if c != raw[at] + 2:  # as "]" is from "[" and "}" from "{"
                    raise ValueError("a bracket is closed by another kind")
                yield start, m.start()
                yield m.end(), m.end()
                return
        elif c == _COMMA and depth == 1:
            yield start, m.start()
            start = m.end()
    raise ValueError("the text ends within an array or object")


def _read(raw: memoryview, start: int, end: int) -> Any:
    return json.loads(str(raw[start:end], "utf-8"))


class LongDocument:
    """A document whose entities are read one by one.  ``entities`` is None if its shape does not allow that."""

    def __init__(self, raw: memoryview) -> None:
        self.raw, self.array, self.path = raw, None, "$[{}]"
        start = re.compile(rb"[ \t\n\r]*").match(raw).end()
        first = bytes(raw[start : start + 1])
        if first == b"[":
            self.array = start
        elif first == b"{":
            self._find_graph(start)

    def _blank(self, start: int, end: int) -> bool:
        return not bytes(self.raw[start : min(end, start + 1)]) or re.compile(rb"[ \t\n\r]*").fullmatch(self.raw, start, end) is not None

    def _find_graph(self, start: int) -> None:
        """The last ``@graph`` of the outermost object counts; the other members are read to see that they can be."""
        spans = list(_parts(self.raw, start))
        (end, _), members = spans[-1], spans[:-1]
        if not self._blank(end, len(self.raw)):
            raise ValueError("there is more than one value")
        if len(members) == 1 and self._blank(*members[0]):
            return
        rest: list[tuple[int, int]] = []
        for lo, hi in members:
            key = _TOKEN.search(self.raw, lo, hi)
            colon = _TOKEN.search(self.raw, key.end(), hi) if key and self.raw[key.start()] == _QUOTE else None
            if not colon or self.raw[colon.start()] != _COLON or not self._blank(lo, key.start()) or not self._blank(key.end(), colon.start()):
                raise ValueError("a member of an object needs a key")
            if _read(self.raw, key.start(), key.end()) == "@graph":
                if self.array is not None:
                    rest.append((self.array, self.end))
                self.array, self.end, self.path = colon.end(), hi, "$.@graph[{}]"
            else:
                rest.append((colon.end(), hi))
        if self.array is None:
            return
        for lo, hi in rest:
            _read(self.raw, lo, hi)
        at = re.compile(rb"[ \t\n\r]*").match(self.raw, self.array).end()
        if bytes(self.raw[at : at + 1]) != b"[":
            _read(self.raw, self.array, self.end)
            raise DocumentError("@graph is not an array")
        self.array = at

    def entities(self) -> Iterator[tuple[str, dict]]:
        i, held = 0, None  # one member is held back, as the last span says where the array ends
        end = self.end if self.path == "$.@graph[{}]" else len(self.raw)
        for lo, hi in _parts(self.raw, self.array):
            if lo == hi and held is not None and self.raw[lo - 1 : lo] in (b"]", b"}") and lo > held[1]:
                if not self._blank(lo, end):
                    raise ValueError("there is more than one value")
                if i or not self._blank(*held):
                    yield self.path.format(i), _entity(i, _read(self.raw, *held))
                return
            if held is not None:
                yield self.path.format(i), _entity(i, _read(self.raw, *held))
                i += 1
            held = lo, hi


def nodes_of_long(raw: memoryview, walker: Walker) -> Iterator[Node]:
    """As ``nodes_of_text``, of the UTF-8 bytes of a long document; all of it is read before the first node is given."""
    doc = LongDocument(raw)
    if doc.array is None:
        yield from walker.nodes(_entities(_read(raw, 0, len(raw))))
        return
    n = 0

    def counted() -> Iterator[tuple[str, dict]]:
        nonlocal n
        for x in doc.entities():
            n += 1
            yield x

    for _ in walker.nodes(counted()):
        pass
    if n == 1 and doc.path == "$[{}]":
        doc.path = "$"
    yield from walker.nodes(doc.entities())


def nodes_of_text(raw: str, walker: Walker) -> list[Node]:
    """The nodes of one document; raises ValueError or RecursionError if it cannot be read."""
    return list(walker.nodes(_entities(json.loads(raw))))


class _Batch:
    """Columns of NODES that fill up."""

    def __init__(self) -> None:
        self.plain: list[list] = [[], [], [], []]  # doc_id, ord, path, node_id
        self.lists: list[tuple[list, list]] = [([], [0]), ([], [0])]  # types, known: items and offsets
        self.props, self.prop_ends, self.val_ends = [], [0], [0]
        self.vals: tuple[list, list, list] = ([], [], [])
        self.chars = 0

    def add(self, doc_id: str | None, node: Node) -> None:
        n, path, own, types, known, held = node
        for column, x in zip(self.plain, (doc_id, n, path, own)):
            column.append(x)
        for (items, ends), xs in zip(self.lists, (types, known)):
            items.extend(xs)
            ends.append(len(items))
        kinds, texts, targets = self.vals
        for prop, vals in held.items():
            self.props.append(prop)
            for kind, text, target in vals:
                kinds.append(kind)
                texts.append(text)
                targets.append(target)
                self.chars += len(text)
            self.val_ends.append(len(kinds))
        self.prop_ends.append(len(self.props))

    @property
    def full(self) -> bool:
        return max(len(self.vals[0]), len(self.plain[0])) >= BATCH_VALUES or self.chars >= BATCH_CHARS

    def rows(self) -> pa.RecordBatch:
        text = pa.string()
        listed = lambda ends, items: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
        vals = pa.StructArray.from_arrays([pa.array(x, text) for x in self.vals], ["kind", "text", "target"])
        props = pa.StructArray.from_arrays([pa.array(self.props, text), listed(self.val_ends, vals)], ["prop", "vals"])
        plain = [pa.array(x, k) for x, k in zip(self.plain, (text, pa.int32(), text, text))]
        return pa.record_batch([*plain, *(listed(ends, pa.array(items, text)) for items, ends in self.lists), listed(self.prop_ends, props), pa.nulls(len(plain[0]), text)], names=_NAMES)


_NAMES = ["doc_id", "ord", "path", "node_id", "types", "known", "props", "error"]


def _refused(doc_id: str | None, error: Exception, like: pa.Schema) -> pa.RecordBatch:
    said = {"doc_id": doc_id, "error": _clean(f"{type(error).__name__}: {error}")}
    return pa.record_batch([pa.array([said.get(f.name)], f.type) for f in like], schema=like)


def _texts(column: pa.Array) -> Iterator[str | memoryview]:
    """The texts of a column (null: empty), the long ones as their bytes in it."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = memoryview(column.buffers()[2] or b"")
    for lo, hi, valid in zip(ends, ends[1:], column.is_valid().to_pylist()):
        whole = raw[lo:hi] if valid else raw[:0]
        yield whole if len(whole) >= LONG_BYTES else str(whole, "utf-8")


def batches_of(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Record batches of NODES from those of doc_id, raw."""
    walker = Walker(vocab)
    like = _Batch().rows().schema
    for b in batches:
        out = _Batch()
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), _texts(b.column("raw"))):
            try:
                for node in nodes_of_text(raw, walker) if isinstance(raw, str) else nodes_of_long(raw, walker):
                    out.add(doc_id, node)
                    if out.full:
                        yield out.rows()
                        out = _Batch()
            except (ValueError, RecursionError) as e:
                yield _refused(doc_id, e, like)
        if out.plain[0]:
            yield out.rows()


def flatten(documents: DataFrame, vocab: Vocabulary) -> DataFrame:
    """NODES of documents (doc_id, raw), with ``label``; write it to a table (``tables.kept``) where several checks read it."""
    sent = documents.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(batches, sent.value)

    found = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, NODES)
    return found.withColumn("label", F.coalesce("node_id", "path"))


def properties_of(nodes: DataFrame) -> DataFrame:
    """A row for each node and property, also for empty lists."""
    p = nodes.where("error IS NULL").select("doc_id", "ord", "label", "node_id", "known", F.explode("props").alias("p"))
    return p.select("doc_id", "ord", "label", "node_id", "known", "p.prop", "p.vals")


def values_of(nodes: DataFrame) -> DataFrame:
    return properties_of(nodes).select("doc_id", "ord", "label", "node_id", "known", "prop", F.explode("vals").alias("v")).select("*", "v.kind", "v.text", "v.target").drop("v")
