"""CHK1 / CHK2: fixed word windows of a document and per-window results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyforge.functions.text import WS, sentences


def word_chunks(docs: DataFrame, size: int = 100) -> DataFrame:
    """CHK1 (doc_id, chunk_no, chunk): windows of ``size`` words.  As in the
    reference loop (``while c <= len``), a length that is a multiple of
    ``size`` (or 0) yields one extra empty window."""
    words = F.filter(F.split(F.col("text"), f"[{WS}]+", -1), lambda w: w != "")
    w = docs.select("doc_id", words.alias("words"))
    return w.select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor(F.size("words") / size).cast("int")),
        lambda i: F.array_join(F.slice("words", i * size + 1, size), " "))).alias("chunk_no", "chunk"))


def chunk_first_sentences(docs: DataFrame, size: int = 100) -> DataFrame:
    """CHK2 (doc_id, keywords): the first sentence of every window joined by
    ';' in window order, split again and made distinct."""
    c = word_chunks(docs, size)
    firsts = c.select("doc_id", "chunk_no", F.coalesce(F.get(sentences(F.col("chunk")), 0), F.lit("")).alias("first"))
    joined = (firsts.groupBy("doc_id")
              .agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_no", "first")))["first"], ";")
                   .alias("joined")))
    return joined.select("doc_id", F.array_distinct(F.split("joined", ";", -1)).alias("keywords"))
