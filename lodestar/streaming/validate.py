"""Checking documents as they arrive.

A document is checked by itself, so the stream holds no state: each micro-batch
goes through the same checks, and findings are appended as Parquet under the
number of the batch, which a replayed batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks
from ..sources.vocabulary import Vocabulary


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, raw of JSON files put into a folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw"))


def validate_stream(documents: DataFrame, vocab: Vocabulary, out: str, checkpoint: str, supplied: DataFrame | None = None) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        checks.validate(checks.session(df, vocab, supplied)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
