"""Weak supervision over quality rules (operator 2).

Each rule votes good, votes bad or abstains.  A rule votes bad beyond a bound
that published filters of web text use, good where a text keeps well within it
(half of it, for most), and abstains between; no threshold comes from a label.
Several rules look at one kind of defect in different ways, as a rule that no
other ever confirms cannot be told from noise.

Documents are counted by their pattern of votes; expectation-maximisation over
that table (at most 3 ** (number of rules) rows, however many documents)
estimates how often each rule is right about good and about bad documents, and
the posterior probability of quality replaces an all-rules-must-pass filter.  It
starts from each pattern's share of good votes, which fixes which class is which.

Defined results: a null text has no words, fails the base rules and is not
kept; an empty text likewise; a very long text is judged whole; repeated rows are
judged alike, and count as often as they occur; a posterior that equals the
threshold keeps; other columns are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, doc_text, map_batches

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_ended long, n_distinct long, n_symbol_words long, n_plain_words long"

#: Symbols as #, letters and all bytes beyond ASCII as a.
_KINDS = bytes(35 if b in SYMBOLS else 97 if b > 127 or bytes([b]).isalpha() else 32 if b in SPACES else 48 for b in range(256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a WINDOW-word window found twice or more, the first one included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = upto = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def text_stats(text: bytes) -> tuple[int, ...]:
    """The columns of STATS after doc_id, of UTF-8 bytes."""
    words = text.split()
    solid = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    drop = lambda these: len(solid) - len(solid.translate(None, these))
    chars = len(solid.decode())
    kinds = text.translate(_KINDS).split()
    return (len(words), chars, drop(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), drop(_UPPER), drop(_DIGITS), sum(x.rstrip().endswith(_ENDS) for x in lines), len(set(words)), sum(b"#" in w for w in kinds), sum(b"a" not in w for w in kinds))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b for whole in batches for b in chunks(whole)):
        rows = [text_stats(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows))
        yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in STATS.split(", ")])


def stats(docs: DataFrame) -> DataFrame:
    return map_batches(doc_text(docs), _stats, STATS)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    above = lambda part, whole, most: _vote(c(part) > most * whole, c(part) <= most / 2 * whole)
    return {
        "length": _vote(c("n_words") < 50, c("n_words") >= 100),
        "symbols": above("n_symbols", n, 0.1),
        "symbol_chars": above("n_symbols", chars, 0.05),
        "symbol_words": above("n_symbol_words", n, 0.2),
        "plain_words": above("n_plain_words", n, 0.2),
        "repeats": above("n_repeat_words", n, 0.15),
        "duplicate_lines": above("n_dup_lines", lines, 0.3),
        "word_length": _vote((chars < 3 * n) | (chars > 10 * n), (chars >= 4 * n) & (chars <= 8 * n)),
        "ended_lines": _vote(c("n_ended") < 0.12 * lines, c("n_ended") >= 0.5 * lines),
        "upper_case": above("n_upper", chars, 0.3),
        "digits": above("n_digits", chars, 0.2),
        "variety": _vote(c("n_distinct") < 0.15 * n, c("n_distinct") >= 0.3 * n),
    }


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 1000, tol: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and their counts.

    Returns the prior of good, each rule's table of outcomes (class bad or good,
    rule, outcome bad, abstain or good) and the posterior of each pattern.  One
    pseudo-count of each outcome keeps every probability inside (0, 1).
    """
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, outcome
    for_, against = (votes == 1).sum(axis=1), (votes == -1).sum(axis=1)
    post = (for_ + 1) / (for_ + against + 2)
    prior, accuracy = 0.5, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            n = np.tensordot(w, shown, axes=1) + 1
            accuracy[c] = n / n.sum(axis=1, keepdims=True)
        prior = ((counts * post).sum() + 1) / (counts.sum() + 2)
        logit = np.log(prior / (1 - prior)) + np.tensordot(shown, np.log(accuracy[1] / accuracy[0]), axes=([1, 2], [0, 1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        done, post = np.abs(new - post).max(initial=0) < tol, new
        if done:
            break
    return prior, accuracy, post


def judge(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, ``quality`` (posterior), ``base_failed`` and ``kept`` of every document."""
    spark = docs.sparkSession
    voted = cut(stats(docs).withColumns({f"v_{k}": v.cast("tinyint") for k, v in rules().items()}))
    names = [f"v_{k}" for k in rules()]
    table = voted.groupBy(*names).count().collect()
    votes = np.array([[r[k] for k in names] for r in table], np.int64).reshape(len(table), len(names))
    _, _, post = fit(votes, np.array([r["count"] for r in table], float))
    # At most 3 ** 12 patterns of twelve small numbers, and far fewer occur: small enough to send to every task.
    known = spark.createDataFrame([(*map(int, v), float(p)) for v, p in zip(votes, post)], ", ".join(f"{k} tinyint" for k in names) + ", quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted.join(F.broadcast(known), names).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
