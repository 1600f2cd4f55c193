"""Deterministic inputs derived from the given tables (FIXTURES.md §3).

The test tables carry no gold keyword lists, so ``kw_raw`` derives them
from each document: its eight most frequent word tokens.  Every helper is a
Spark job over the whole table; the tokens of a document are counted in Arrow
batches of whole documents, so its cost grows with the data.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyforge.functions.text import TOKEN_RE
from keyforge.operators import batches as B
from keyforge.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GOLD_SIZE = 8
MIN_TOKEN_LEN = 4


def _long_tokens(text) -> F.Column:
    """Lower-cased word tokens of length >= 4, in document order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOKEN_RE), 0), F.lower),
                    lambda t: F.length(t) >= MIN_TOKEN_LEN)


def _counts(batch: pa.RecordBatch):
    """(document, term, count, first place) of every distinct token of each row, and the terms."""
    copy_o, copies = B.parts(batch["toks"])
    tok_o, toks = B.parts(copies)
    copy = B.owner(tok_o)
    code, _, term_of, terms = B.numbered(toks)
    n = max(len(terms), 1)
    key = B.owner(copy_o)[copy] * n + (term_of[code] if len(code) else code)
    keys, owner, count = np.unique(key, return_inverse=True, return_counts=True)
    first = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(first, owner, np.arange(len(key)) - tok_o[copy])
    return keys // n, keys % n, count, first, pa.array(terms, pa.string())


def _long_token_rows(docs: DataFrame, first_half: bool = False) -> DataFrame:
    """(doc_id, toks): one row per id with the long tokens of each of its texts; no row per token."""
    t = docs.select("doc_id", _long_tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    if first_half:
        t = t.select("doc_id", F.slice("toks", F.lit(1), F.floor(F.size("toks") / 2).cast("int")).alias("toks"))
    return t.groupBy("doc_id").agg(F.collect_list("toks").alias("toks"))


def top_tokens(docs: DataFrame, k: int = GOLD_SIZE, first_half: bool = False) -> DataFrame:
    """(doc_id, toks): the k most frequent long tokens per document, ordered by
    count desc, token asc.  ``first_half`` restricts to the first half of the
    tokens (1-based position * 2 <= n)."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, term, count, _, terms = _counts(batch)
        order = np.lexsort((term, -count, doc))
        top = order[B.rank_in(doc[order]) < k]
        size = np.bincount(doc[top], minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch["doc_id"], B.in_lists(size, terms.take(pa.array(term[top])))], ["doc_id", "toks"])

    t = _long_token_rows(docs, first_half)
    return B.map_batches(t, rows, B.typed(t, "toks array<string>")).where(F.size("toks") > 0)


def kw_raw(docs: DataFrame) -> DataFrame:
    """kw_raw(doc_id, text, key, dataset): ``key`` = top-8 tokens joined by
    LF, then LF + an upper-case copy of the first, then two LF; '' when the
    document has no long token.  ``dataset`` = ``source``."""
    top = top_tokens(docs)
    key = F.concat(F.array_join("toks", "\n"), F.lit("\n"), F.upper(F.col("toks")[0]),
                   F.lit("\n\n"))
    return (docs.join(top, "doc_id", "left")
            .select("doc_id", "text",
                    F.when(F.col("toks").isNull(), F.lit("")).otherwise(key).alias("key"),
                    F.col("source").alias("dataset")))


def kw_pairs(docs: DataFrame) -> DataFrame:
    """kw_pairs(doc_id, pred, ref): ref = cleaned gold list; pred = top-8
    tokens of the first half of the document."""
    from keyforge.functions.text import empty_strs, to_keywords
    gold = kw_raw(docs).select("doc_id", to_keywords(F.col("key")).alias("ref"))
    pred = top_tokens(docs, first_half=True).withColumnRenamed("toks", "pred")
    return (gold.join(pred, "doc_id", "left")
            .select("doc_id", F.coalesce("pred", empty_strs()).alias("pred"), "ref"))


def responses(docs: DataFrame) -> DataFrame:
    """responses(doc_id, response): simulated model answers in the three
    shapes the parser must handle (list literal, KEYWORDS block, refusal)."""
    top = top_tokens(docs)
    quoted = F.array_join(F.transform("toks", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    as_list = F.concat(F.lit("Here are the keywords for the document.\n["), quoted, F.lit("]"))
    lines = F.transform("toks", lambda t, i: F.when(i % 2 == 0, F.concat(F.lit("- "), t))
                        .otherwise(F.concat((i + 1).cast("string"), F.lit(". "), t)))
    as_block = F.concat(F.lit("Keywords:\n"), F.array_join(lines, "\n"),
                        F.lit("\n\nNote: extracted from the text"))
    resp = (F.when(F.col("doc_id") % 3 == 0, as_list)
            .when(F.col("doc_id") % 3 == 1, as_block)
            .otherwise(F.lit("none")))
    return (docs.select("doc_id").join(top, "doc_id", "left")
            .select("doc_id", F.when(F.col("toks").isNull(), F.lit("none"))
                    .otherwise(resp).alias("response")))


def weighted_gold(docs: DataFrame, k: int = GOLD_SIZE) -> DataFrame:
    """(doc_id, ref): the k long tokens of a document with the highest
    tf * ln(N / df), ordered by it and then by first place: how often a word
    occurs in its document does not settle whether it is among them."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, term, count, first, terms = _counts(batch)
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc)), terms.take(pa.array(term)), pa.array(count), pa.array(first)], ["doc_id", "tok", "tf", "pos"])

    t = _long_token_rows(docs)
    tf = written(B.map_batches(t, rows, B.typed(t, "tok string, tf long, pos long")), "token-tf")
    df = written(tf.groupBy("tok").agg(F.count(F.lit(1)).alias("df")), "token-df")
    w = Window.partitionBy("doc_id").orderBy(F.col("v").desc(), F.col("pos"))
    top = (tf.join(df, "tok").withColumn("v", F.round(F.col("tf") * F.log(F.lit(float(docs.count())) / F.col("df")), 9))
           .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k))
    return top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rn", "tok"))).alias("s")).select("doc_id", F.col("s.tok").alias("ref"))
