"""Language identification by words first, then shorter and shorter n-grams (operator 3).

A known word is scored by its frequency in each language, -log10(count /
total); a word that is frequent in some language but unseen in another costs
PENALTY there.  A word no language knows falls back to its character n-grams
(word ends marked), longest first: the first length of which any n-gram is
known scores it by their mean; if none is, the word says nothing.  A document's
score for a language is the mean over its words, and the lowest wins.

The model is fitted on a sample of at most about ``max_train`` labelled
documents (whole texts), chosen by a hash of doc_id, and holds at most about
``max_words`` words and ``max_grams`` n-grams; it is sent to every task.  Each
language has the same room in the sample and in both tables (in that of
n-grams, for each length); what a language does not need goes to the others.

Defined results: a null or empty text, or one without a letter, gives ``und`` with
score 0; so does any text if nothing could be learned; ties go to the language
that sorts first; repeated rows are labelled alike; a very long text is taken
whole; an empty table gives an empty result; columns that are not named are not
read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, doc_text, level, map_batches

MAX_TRAIN, MAX_WORDS, MAX_GRAMS = 20_000, 60_000, 60_000
LENGTHS = (5, 4, 3, 2, 1)
MIN_COUNT = 3
PENALTY = 7.0
CACHE_WORDS = 300_000
#: Bytes of text whose words are counted or scored together.
PIECE = 4 << 20
#: Sharpness of the score: difference in mean cost at which the winner is ten times as likely.
DECADE = 0.5

#: A letter, and what letters and marks (vowel signs, accents that stand by themselves) follow it.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    """Words in lower case, composed where Unicode has a composed letter."""
    text = (text or "").lower()
    return _WORD.findall(text if text.isascii() else unicodedata.normalize("NFC", text))


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    known: dict[str, int]  # word to its row of costs
    grams: dict[str, int]  # n-gram to its row
    costs: np.ndarray  # row, language

    def word_cost(self, word: str) -> np.ndarray | None:
        at = self.known.get(word)
        if at is not None:
            return self.costs[at]
        for n in LENGTHS:
            rows = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if rows:
                return self.costs[rows].mean(axis=0)
        return None


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Predicted language and score of each text."""
        model = self.model
        if len(self.at) > CACHE_WORDS:
            self.clear()
        split = [words(t) for t in texts]
        fresh: list[np.ndarray] = []
        for w in {w for ws in split for w in ws if w not in self.at}:
            cost = model.word_cost(w)
            if cost is None:
                self.at[w] = 0  # says nothing
            else:
                self.at[w] = len(self.table) + len(fresh)
                fresh.append(cost)
        if fresh:
            self.table = np.concatenate([self.table, np.array(fresh)])
        table = self.table
        out = []
        for ws in split:
            ids = np.fromiter((self.at[w] for w in ws), np.int64, len(ws))
            ids = ids[ids > 0]
            if not len(ws) or not model.langs:
                out.append(("und", 0.0))
                continue
            cost = table[ids].mean(axis=0) if len(ids) else np.zeros(len(model.langs))
            best = int(cost.argmin())
            out.append((model.langs[best], float(1 / (10 ** (-(cost - cost[best]) / DECADE)).sum())))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b for whole in batches for b in chunks(whole, limit=PIECE)):
        by_lang: dict[str, Counter[str]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words(text))
        out: dict[tuple[int, str, str], int] = {}
        for lang, count in by_lang.items():
            for w, c in count.items():
                out[(0, w, lang)] = c
                for n in LENGTHS:
                    for g in grams(w, n):
                        out[(n, g, lang)] = out.get((n, g, lang), 0) + c
        keys = list(out)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(out.values()), pa.int64())], names=["n", "gram", "lang", "c"])


def _least(steps: list[tuple[int, int]], room: float) -> tuple[int, float]:
    """The least count of which rows are kept, and the share of its rows, for ``room`` rows of (count, rows)."""
    for c, n in sorted(steps, reverse=True):
        if n > room:
            return c, room / n
        room -= n
    return 0, 1.0


def _in_room(known: DataFrame, room: int) -> DataFrame:
    """Rows of ``known``: of each language and length the most frequent, at most about ``room`` rows."""
    if known.count() <= room:
        return known
    each = known.select("n", "gram", "by_lang", F.explode("by_lang").alias("lang", "c"))
    steps: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for r in each.groupBy("n", "lang", "c").agg(F.count("*").alias("rows")).collect():  # different counts only
        steps.setdefault((r["n"], r["lang"]), []).append((r["c"], r["rows"]))
    own = level([sum(n for _, n in x) for x in steps.values()], room)
    limits = known.sparkSession.createDataFrame([(*k, *_least(x, own)) for k, x in steps.items()], "n int, lang string, least long, part double")
    drawn = F.pmod(F.xxhash64("n", "gram"), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    kept = each.join(F.broadcast(limits), ["n", "lang"]).where((F.col("c") > F.col("least")) | ((F.col("c") == F.col("least")) & drawn))
    return kept.groupBy("n", "gram").agg(F.first("by_lang").alias("by_lang"))


def train(labelled: DataFrame, *, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang); rows without text or lang are left out."""
    usable = doc_text(labelled, F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # The count reads ids and languages only.
    sizes = {r["lang"]: r["count"] for r in labelled.select(F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").groupBy("lang").count().collect()}
    own = level(list(sizes.values()), max_train)
    rates = labelled.sparkSession.createDataFrame([(x, min(1.0, own / n)) for x, n in sizes.items()], "lang string, rate double")
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("lang")), F.lit(1 << 40))
    sample = usable.join(F.broadcast(rates), "lang").where(part < F.col("rate") * (1 << 40))
    counts = cut(map_batches(sample.select("text", "lang"), _count, "n int, gram string, lang string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c")))
    known = counts.groupBy("n", "gram").agg(F.sum("c").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "c")))).alias("by_lang"))
    known = cut(known.where(F.col("total") >= MIN_COUNT).select("n", "gram", "by_lang"))
    word_rows, gram_rows = _in_room(known.where("n = 0"), max_words), _in_room(known.where("n > 0"), max_grams)
    sums = {(r["n"], r["lang"]): r["c"] for r in counts.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({lang for _, lang in sums})
    at: dict[str, int] = {}
    pieces: dict[str, int] = {}
    costs = []
    for r in word_rows.select("n", "gram", "by_lang").unionAll(gram_rows.select("n", "gram", "by_lang")).collect():
        (pieces if r["n"] else at)[r["gram"]] = len(costs)
        costs.append([min(PENALTY, -np.log10(c / sums[(r["n"], x)])) if (c := r["by_lang"].get(x)) else PENALTY for x in langs])
    return Model(langs, at, pieces, np.array(costs, np.float64).reshape(len(costs), len(langs)))


def predict(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and the columns ``more`` of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    named = doc_text(docs, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in (b for whole in batches for b in chunks(whole, limit=PIECE)):
            got = scorer(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *(b.column(c) for c in more)], names=["doc_id", "lang_pred", "score", *more])

    return map_batches(named, run, "doc_id long, lang_pred string, score double" + "".join(f", {c} {dict(named.dtypes)[c]}" for c in more))
