"""Long renderings as rows of bounded size, by a secondary sort.

Rows are dealt into ranges of (document, order), so that a document of very many rows
lies in several tasks, each of which streams its sorted rows and emits a chunk of
text whenever it has enough.  No row and no task holds a whole document.
A document's text is that of its chunks in the order of (part, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept

#: Characters that end a chunk.
CHUNK_CHARS = 1 << 20
CHUNK = "key string, part int, chunk int, first boolean, opens boolean, text string"
#: Parts of what stands before and after all chunks of a document.
HEAD, TAIL = -1, (1 << 31) - 1


def _streamed(render: Callable[[pa.RecordBatch], list[str]], sep: str, limit: int):
    """``first``: the document begins here; ``opens``: it is the partition's first, so it may have begun before."""
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key: object = run  # equals no key
        held: list[str] = []
        size = n = documents = 0

        def flushed() -> pa.RecordBatch:
            row = (key, part, n, n == 0, n == 0 and documents == 1, sep.join(held))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for b in batches:
            for k, text in zip(b.column("key").to_pylist(), render(b)):
                if held and (k != key or size >= limit):
                    yield flushed()
                    held, size, n = [], 0, n + 1
                if k != key:
                    key, n, documents = k, 0, documents + 1
                held.append(text)
                size += len(text)
        if held:
            yield flushed()

    return run


def in_chunks(rows: DataFrame, order: list[str], render: Callable[[pa.RecordBatch], list[str]], sep: str = "", limit: int = CHUNK_CHARS) -> DataFrame:
    """key, part, chunk, text from rows with ``key``, the columns of ``order`` and what ``render`` takes; ``sep`` stands between rendered rows, also where they are in two chunks.

    The only documents of which a task does not know whether they begin with it are
    those that open a partition, one each; these are looked up.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    chunks = kept(dealt.mapInArrow(_streamed(render, sep, limit), CHUNK))
    if not sep:
        return chunks.select("key", "part", "chunk", "text")
    openers = chunks.where("opens").select(F.col("key").alias("k")).distinct()
    begins = chunks.select("key", "part").join(F.broadcast(openers), F.col("key").eqNullSafe(F.col("k"))).groupBy("k").agg(F.min("part").alias("begins"))  # a row for each partition at most
    met = chunks.join(F.broadcast(begins), F.col("key").eqNullSafe(F.col("k")), "left")
    first = F.col("first") & (~F.col("opens") | (F.col("part") == F.col("begins")))
    return met.select("key", "part", "chunk", F.when(first, F.col("text")).otherwise(F.concat(F.lit(sep), "text")).alias("text"))
