"""Structured Streaming entry points.

The reference has no streams; every normaliser and parser here is a
stateless projection, so it runs unchanged on a streaming DataFrame.
Extractors aggregate per document, so they run per micro-batch through
``foreachBatch`` (each micro-batch is a complete set of documents), with an
idempotent append keyed by the batch id.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyforge.functions import parse as P
from keyforge.functions import text as T

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def read_documents(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream of document rows from parquet files arriving in ``path``."""
    return (spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def clean_stream(stream: DataFrame) -> DataFrame:
    """TXT1 / TXT4 / KWD2 on a stream (stateless)."""
    return stream.select("doc_id", T.clean_text(F.col("text")).alias("text"),
                         T.word_count(F.col("text")).alias("word_count"))


def parse_stream(stream: DataFrame, col: str = "response") -> DataFrame:
    """PRS4 on a stream of model answers (doc_id, response)."""
    return stream.select("doc_id", P.parse_answer(F.col(col)).alias("keywords"))


def extract_per_batch(stream: DataFrame, extractor, sink_path: str, checkpoint: str | None = None,
                      query_name: str = "keyphrases"):
    """Run a batch extractor (``fn(docs) -> (doc_id, keywords)``) on every
    micro-batch and append the result to parquet.  The checkpoint lies beside
    the result unless given (readers skip the folder), so a restarted
    application goes on behind the last finished batch."""
    checkpoint = checkpoint or os.path.join(sink_path, f"_checkpoint-{query_name}")

    def run(batch: DataFrame, batch_id: int) -> None:
        out = extractor(batch.select("doc_id", "text")).withColumn("batch_id", F.lit(batch_id))
        # Idempotent on retry: the batch's own folder is overwritten.
        out.write.mode("overwrite").parquet(os.path.join(sink_path, f"batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .queryName(query_name).start())
