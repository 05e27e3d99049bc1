"""Toxicity severity by cumulative-link ordinal regression (operator 1).

Grades of severity are those of a column ``severity`` (0 to 3) of the labels, if
they have one.  Labels that only tell toxic from not leave the grades open; then
a document labelled 0 has grade 0, and one labelled 1 has grade 1, 2 or 3 by the
third in which it stands among the toxic documents by distinct telling features
in a hundred words.  Which features are telling is learned on the half of the
sample that a document is not in, so that its own label has no part in its grade.
One weight vector is shared by the ordered thresholds,
P(grade > k) = logistic(w.x - t_k), and the expected severity is the sum of these
over k.

Features are a document's distinct words and word beginnings (4 to 6
characters), present or not, and whether 2, 3 or 5 different words begin so.
The model's are chosen by a z-score of their document frequencies in the labelled
sample; the sample is bounded by ``max_train`` labelled documents, half of them
for each class where there are enough, and the model by ``max_features``.

Defined results: a null or empty text has severity 0 and is kept; a table
without usable labels gives severity 0 everywhere; of several labels of one
document the highest counts; repeated rows score alike; a very long text is
taken whole, as its set of words; features of equal z-score go by their text;
documents whose severity equals the cutoff are rejected, toxic documents at a
bound between grades have the lower one; columns that are not named are not read, whatever their names, but
for those that a caller asks to keep; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_text, level, map_batches

MAX_TRAIN, MAX_FEATURES = 20_000, 20_000
MIN_DOCS, MIN_Z = 5, 5.0
GRADES = 3
#: How much more often a feature is met in toxic documents of the other half, as a z-score, for it to tell a grade.
TELLING_Z = 2.0
CACHE_WORDS = 150_000

_WORD = re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))


def counted(feature: str, n: int) -> list[str]:
    """Features that say that 2, 3 or 5 of a document's words share a beginning."""
    return [f"{feature}{k}" for k in (2, 3, 5) if n >= k and feature[-1] == "*"]


def distinct_words(text: str | None) -> tuple[set[str], int]:
    words = _WORD.findall((text or "").lower())
    return set(words), len(words)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one for each grade above 0
    cutoff: float  # documents with an expected severity of this or more are rejected

    def severity(self, found: set[int]) -> tuple[float, int]:
        x = sum(float(self.weights[i]) for i in found)
        above = 1 / (1 + np.exp(-np.clip(x - self.thresholds, -50, 50)))
        return float(above.sum()), int((above >= 0.5).sum())


class Finder:
    """Indexes of a text's features; remembers what each word holds, up to CACHE_WORDS words."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.cache = index, {}
        self.wanted = {f[:-1] if "*" in f[:-1] else f for f in index}

    def __call__(self, words: set[str]) -> set[int]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found: dict[str, int] = {}
        for w in words:
            got = self.cache.get(w)
            if got is None:
                got = self.cache[w] = tuple(f for f in features(w) if f in self.wanted)
            for f in got:
                found[f] = found.get(f, 0) + 1
        return {self.index[x] for f, n in found.items() for x in (f, *counted(f, n)) if x in self.index}


#: Documents with a feature, by class (0, 1) and half of the sample (a, b).
COUNTS = ("a0", "b0", "a1", "b1")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b for whole in batches for b in chunks(whole)):
        count: dict[str, list[int]] = {}
        for text, toxic, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half"))):
            held: dict[str, int] = {}
            for f in (f for w in distinct_words(text)[0] for f in features(w)):
                held[f] = held.get(f, 0) + 1
            for f in (x for f, n in held.items() for x in (f, *counted(f, n))):
                count.setdefault(f, [0, 0, 0, 0])[2 * toxic + half] += 1
        yield pa.record_batch([pa.array(list(count), pa.string()), *(pa.array([c[i] for c in count.values()], pa.int64()) for i in range(4))], names=["feature", *COUNTS])


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising thresholds, by Adam on the likelihood of ``P(grade > k) = logistic(w.x - t_k)``."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, t = np.zeros(n_features), np.zeros(GRADES)
    first, gaps = 2.0, np.zeros(GRADES - 1)
    above = grades[:, None] > np.arange(GRADES)[None, :]
    m, v = np.zeros(n_features + GRADES), np.zeros(n_features + GRADES)
    for step in range(1, steps + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(owner, w[flat], len(rows))
        up = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -50, 50)))  # P(grade > k)
        edge = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-12)
        slope = up * (1 - up)
        # d log p / d (x - t_k): the upper edge of the grade counts against, the lower for it
        d = np.zeros_like(up)
        low, high = grades > 0, grades < GRADES
        d[at[low], grades[low] - 1] += slope[at[low], grades[low] - 1] / p[low]
        d[at[high], grades[high]] -= slope[at[high], grades[high]] / p[high]
        n = max(1, len(rows))
        gw = np.bincount(flat, d.sum(axis=1)[owner], n_features) / n - l2 * w
        gt = -d.sum(axis=0) / n
        g_gaps = np.array([gt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)])
        g = np.concatenate([gw, [gt.sum()], g_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w += move[:n_features]
        first += move[n_features]
        gaps = np.clip(gaps + move[n_features + 1 :], -4, 4)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _z(n0: Column, n1: Column, of0: int, of1: int) -> Column:
    """How much more often toxic documents have a feature, in standard errors."""
    if not of0 or not of1:
        return F.lit(0.0)
    share = (n0 + n1) / (of0 + of1)
    return (n1 / of1 - n0 / of0) / F.sqrt(share * (1 - share) * (1 / of0 + 1 / of1) + 1e-12)


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most about ``max_train`` labelled documents, chosen by a hash of doc_id."""
    spark = docs.sparkSession
    grade = F.max(F.col("severity").cast("int")) if "severity" in labels.columns else F.lit(None).cast("int")
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), grade.alias("grade"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    own = level(list(sizes.values()), max_train)
    part = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20))
    rate = F.when(F.col("toxic") == 1, own / max(1, sizes.get(1, 0))).otherwise(own / max(1, sizes.get(0, 0)))
    chosen = usable.where(part < rate * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    # About max_train rows of twenty bytes: small enough to send to every task.
    sample = doc_text(docs).join(F.broadcast(chosen), "doc_id")
    of = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    a0, b0, a1, b1 = (of.get((c, h), 0) for c in (0, 1) for h in (0, 1))
    nothing = Model({}, np.zeros(0), np.full(GRADES, 50.0), 0.5)
    if not a0 + b0 or not a1 + b1:
        return nothing
    seen = map_batches(sample.select("text", "toxic", "half"), _feature_rows, "feature string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    n = {c: F.col(c) for c in COUNTS}
    z = _z(n["a0"] + n["b0"], n["a1"] + n["b1"], a0 + b0, a1 + b1)
    scored = seen.withColumns({"z": z, "z_a": _z(n["a0"], n["a1"], a0, a1), "z_b": _z(n["b0"], n["b1"], b0, b1)})
    picked = scored.where((n["a0"] + n["b0"] + n["a1"] + n["b1"] >= MIN_DOCS) & (F.abs("z") >= MIN_Z)).select("feature", "z", "z_a", "z_b").orderBy(F.abs("z").desc(), "feature").limit(max_features).collect()
    if not picked:
        return nothing
    index = {r["feature"]: i for i, r in enumerate(picked)}
    telling = np.array([[r["z_b"] >= TELLING_Z, r["z_a"] >= TELLING_Z] for r in picked]).T  # of each half, by the other

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(index)
        for b in (b for whole in batches for b in chunks(whole)):
            got = [(sorted(find(ws)), n) for ws, n in map(distinct_words, b.column("text").to_pylist())]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "toxic", "grade", "half")), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "toxic", "grade", "half", "found", "n_words"])

    rows = sorted(map_batches(sample.select("doc_id", "toxic", "grade", "half", "text"), hits, "doc_id long, toxic int, grade int, half int, found array<int>, n_words long").collect(), key=lambda r: (r["doc_id"], r["n_words"]))
    found = [np.array(r["found"], np.int64) for r in rows]
    toxic = np.array([r["toxic"] for r in rows])
    density = np.array([telling[r["half"]][f].sum() / max(1, r["n_words"]) for f, r in zip(found, rows)])
    edges = np.quantile(density[toxic == 1], [(k + 1) / GRADES for k in range(GRADES - 1)])
    by_density = np.where(toxic == 1, 1 + np.searchsorted(edges, density, side="left"), 0)
    grades = np.array([d if r["grade"] is None else min(GRADES, max(0, r["grade"])) for d, r in zip(by_density, rows)])
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows]) if len(rows) >= 200 else np.zeros(len(rows), bool)
    keep = np.flatnonzero(~held)
    w, t = fit_cumulative([found[i] for i in keep], grades[keep], len(index))
    model = Model(index, w, t, 0.5)
    check = np.flatnonzero(held) if held.any() else keep
    scores = np.array([model.severity(set(found[i]))[0] for i in check])
    # The sample has more toxic documents than the table: the others count by how many they stand for.
    weight = np.where(toxic[check] == 1, 1.0, max(1.0, (sizes[0] / (a0 + b0)) / (sizes[1] / (a1 + b1))))
    right, said = weight * (toxic[check] == 1), lambda c: scores >= c
    best = max((2 * right[said(c)].sum() / max(1, weight[said(c)].sum() + right.sum()), -abs(c - 0.5), c) for c in np.linspace(0.1, 1.5, 57))
    model.cutoff = float(best[2])
    return model


def score(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (grade), toxic, kept, and the columns ``more`` of ``docs``; with them the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES words and weights
    named = doc_text(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = Finder(m.index)
        for b in (b for whole in batches for b in chunks(whole)):
            got = [m.severity(find(distinct_words(t)[0])) for t in b.column("text").to_pylist()]
            bad = pa.array([g[0] >= m.cutoff for g in got], pa.bool_())
            rest = [b.column(c) for c in ("text", *more)] if more else []
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), bad, pa.array([not x for x in bad.to_pylist()], pa.bool_()), *rest], names=["doc_id", "expected_severity", "severity", "toxic", "kept", *(("text", *more) if more else ())])

    schema = "doc_id long, expected_severity double, severity int, toxic boolean, kept boolean"
    if more:
        schema += ", text string" + "".join(f", {c} {dict(named.dtypes)[c]}" for c in more)
    return map_batches(named, run, schema)
