"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents (doc_id, text,
lang, source, n_chars), the last one token ids.  A document that a stage
rejects, shortens or repeats is so for all later stages.  ``run`` writes each
stage to the shared folder and reads it again.

Defined results, by stage.  Nulls: a null text is not toxic, duplicates nothing,
is empty after the third stage and is not taken into the mix; rows without doc_id
stay as they are until the mix.  Empty texts go the same way.  Very long texts
are taken whole at each stage.  Repeated rows (one doc_id): one stays after the
second stage.  Ties: of documents that duplicate each other the smallest doc_id
stays; of repeated passages no copy stays.  Other columns than the five, whatever
their names, are left out.  An empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mixing, neardup, sentencepiece, suffixes, toxicity
from lodestar.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the fitted cutoff."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "lang", "source", "n_chars").where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return neardup.deduplicated(docs.select(*COLUMNS), k=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur anywhere else too, whatever their length in bytes."""
    left = suffixes.without_repeats(docs, "lang", "source", words=True, length=suffixes.PASSAGE_WORDS, gram=suffixes.PASSAGE_GRAM)
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: parts left out, or taken twice, by the targets of their sources."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return sentencepiece.encode(docs, "lang", "source", "n_chars")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_to_targets),
    ("tokens", encode),
]

#: No SQL: the stages fit models, hash and draw; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
