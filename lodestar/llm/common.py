"""Helpers shared by the training-data operators.

Words follow one rule everywhere a contract names it: maximal runs of bytes
outside ``\\x20`` and ``\\x09-\\x0D``.  ``bytes.split()`` and Arrow's
``ascii_split_whitespace`` cut at exactly these six bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import kept as cut, passing  # noqa: F401  the operators take them from here

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch (Spark also ends one at 64 MB), and bytes of text that a function takes at a time.
BATCH_ROWS = 1000
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; documents that Spark reads in fewer pieces than it has cores are spread (larger tables are not shuffled)."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if name == "documents" and df.rdd.getNumPartitions() < cores else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more``; columns that an operator does not name never reach it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows; ``fn`` takes and yields record batches.

    The bound is a setting that Spark reads when the plan runs, so it stays with
    the session; a smaller one that is set already is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker serves one task after another: this pool gives freed memory back in between.
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def level(sizes: list[int], room: int) -> float:
    """How much each of some groups may have so that all have ``room``; groups below it are whole."""
    left = sorted(sizes)
    while left and left[0] * len(left) <= room:
        room -= left.pop(0)
    return room / len(left) if left else float("inf")


class Tokens:
    """The words of a batch of texts: codes into ``words``, and the row of each."""

    def __init__(self, texts: pa.Array, lower: bool) -> None:
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pa.compute.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        flat, rows = split.flatten(), pc.list_parent_indices(split).to_numpy()
        keep = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(keep).dictionary_encode()
        self.rows = rows[keep.to_numpy(zero_copy_only=False)].astype(np.int64)
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words: pa.Array = coded.dictionary
        #: offsets[i]:offsets[i + 1] are the words of row i.
        self.offsets = np.searchsorted(self.rows, np.arange(len(texts) + 1))
        self.n_rows = len(texts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every process."""
        return hash_strings(self.words)


_BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some non-empty strings, by their bytes."""
    if not len(values):
        return np.zeros(0, np.uint64)
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(BYTE_HASHES[raw] * powers(_BASE, int(lengths.max()))[place], starts) + lengths.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTE_HASHES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
