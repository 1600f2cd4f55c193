"""Exact greedy walks over ranked per-document candidate lists in bounded
chunks (used by YAKE's near-duplicate filter, YAK6).

A greedy walk keeps a candidate when it passes a test against the items
kept so far and stops once ``k`` are kept.  Running it over the first
``c1`` ranks of every document, then over ranks ``(c1, c2]`` only for the
documents that are not finished, and so on, gives exactly the result of one
walk over the whole list, while no step ever holds more than one chunk of a
document in an array.  Nearly all documents finish in the first chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.session import keep

CHUNKS = (64, 512, 4096, None)


def greedy_walk(cands: DataFrame, k: int, accept: Callable[[Column, Column], Column],
                item_cols: list[str], order: list | None = None, rank_col: str = "rk", key: str = "doc_id",
                chunks=CHUNKS) -> DataFrame:
    """``cands``: one row per candidate with ``key`` and ``item_cols``, walked
    in ``order`` (or, when ``order`` is None, by an existing 1-based
    ``rank_col``).  ``accept(kept_array, item)`` -> boolean Column.
    Returns (key, kept: array<struct<rank, item_cols...>>) in walk order.

    Ranks are computed per pass: the first pass keeps only the top ``c1``
    per document in every task before sorting (window group limit); later
    passes rank only the documents still open."""
    from pyspark.sql import Window
    if order is not None:
        cands = keep(cands)
        w = Window.partitionBy(key).orderBy(*order)
    probe = cands if order is None else cands.withColumn(rank_col, F.lit(1))
    item_type = probe.select(F.struct(F.col(rank_col).alias("rk"), *item_cols).alias("s")).schema["s"].dataType
    empty = F.array().cast(F.ArrayType(item_type))

    def step(acc, x):
        return F.when((F.size(acc) >= k) | ~accept(acc, x), acc).otherwise(F.concat(acc, F.array(x)))

    results = []
    state = None  # (key, kept) of documents still open
    lo = 0
    for hi in chunks:
        part = cands if state is None else cands.join(state.select(key), key, "left_semi")
        if order is not None:
            part = part.withColumn(rank_col, F.row_number().over(w))
        if hi is not None:
            part = part.where(F.col(rank_col) <= hi)
        part = part.where(F.col(rank_col) > lo)
        arrs = (part.groupBy(key)
                .agg(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("rk"), *item_cols))).alias("c"),
                     F.max(rank_col).alias("_last")))
        if state is not None:
            # Right join: open documents without further candidates finish here.
            arrs = arrs.join(state, key, "right")
            init = F.col("kept")
        else:
            init = empty
        items = F.coalesce(F.col("c"), F.array().cast(F.ArrayType(item_type)))
        # Persisted: the next pass reads the open documents from it, so the
        # walk of this pass is computed once.
        walked = keep(arrs.select(key, F.aggregate(items, init, step).alias("kept"), "_last"))
        if hi is None:
            results.append(walked.select(key, "kept"))
            break
        done = (F.size("kept") >= k) | F.col("_last").isNull() | (F.col("_last") < hi)
        results.append(walked.where(done).select(key, "kept"))
        state = walked.where(~done).select(key, "kept")
        lo = hi
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
