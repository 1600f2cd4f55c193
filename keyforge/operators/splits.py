"""Seeded splits, batches and sample caps (SPL1-SPL6).

Rows are ordered by ``md5(concat(id, ':', seed))``.  Exact positions in that
order come from a *rank index*: the ids alone are range-sorted and written
with their place in their partition, and a tiny offsets table (one row per
partition, broadcast) turns the place into a global rank.  The written index
holds one row per id and never changes, whatever executors are lost later;
texts, id arrays and other wide columns take no part in the sort, they meet
the index in one join on the id.  No single-partition window is used.  The
scalable mode needs no sort at all: the first 32 bits of the hash pick the
split directly (proportions are then approximate).

Ids are unique (a null id counts as one id).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyforge.session import written


def shuffle_key(id_col: str = "doc_id", seed: int = 42):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.lit(str(seed))))


def rank_index(df: DataFrame, order_cols: list, id_cols: list[str], rank_col: str = "rn") -> DataFrame:
    """(id_cols..., rank_col): the 1-based global rank of every row of ``df`` by
    ``order_cols`` (ties must not occur; add a unique column last), as a
    written table.  ``df`` should hold no more than the ids and what orders
    them."""
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    place = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    s = written(df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
                .select(*id_cols, part.alias("_pid"), place.alias("_place")), "rank-index")
    offsets = (s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off")))
    # One row per partition: a proven size bound, so it is broadcast.
    return s.join(F.broadcast(offsets), "_pid").select(*id_cols, (F.col("_off") + F.col("_place") + 1).alias(rank_col))


def seeded_rank(df: DataFrame, id_col: str = "doc_id", seed: int = 42) -> tuple[DataFrame, int]:
    """``df`` with ``rn``, the rank of its id in the seeded order, and the number of rows."""
    index = rank_index(df.select(id_col, shuffle_key(id_col, seed).alias("_h")), ["_h", id_col], [id_col])
    n = index.count()  # one number to the driver, from the written index
    return (index if df.columns == [id_col] else join_index(df, index, [id_col])), n


def join_index(df: DataFrame, index: DataFrame, id_cols: list[str]) -> DataFrame:
    """``df`` with the other columns of ``index``, matched on ids that may be null."""
    index = index.select(*(F.col(c).alias(f"_i_{c}") for c in id_cols), *(c for c in index.columns if c not in id_cols))
    on = [df[c].eqNullSafe(index[f"_i_{c}"]) for c in id_cols]
    return df.join(index, on).drop(*(f"_i_{c}" for c in id_cols))


def split_counts(n: int, test_size: float = 0.2, val_share: float = 0.5) -> tuple[int, int, int]:
    """Sizes of (train, validation, test) for two ``train_test_split`` calls:
    the held-out part is ceil(test_size * n), and the final test part is
    ceil(val_share * held_out)."""
    held = math.ceil(test_size * n)
    test = math.ceil(val_share * held)
    return n - held, held - test, test


def three_way_split(df: DataFrame, id_col: str = "doc_id", seed: int = 42, test_size: float = 0.2,
                    second: float = 0.5, names=("train", "validation", "test"),
                    second_from: str = "held") -> DataFrame:
    """SPL1 (80/10/10, ``second_from='held'``) and SPL2 (80/20 then 90/10 of
    train, ``second_from='train'``) with exact counts.  Adds ``split``."""
    ranked, n = seeded_rank(df, id_col, seed)
    held = math.ceil(test_size * n)
    if second_from == "held":
        n_train, n_val = n - held, held - math.ceil(second * held)
    else:
        n_val = math.ceil(second * (n - held))
        n_train = n - held - n_val
    out = ranked.withColumn("_a", F.lit(n_train)).withColumn("_b", F.lit(n_train + n_val))
    split = (F.when(F.col("rn") <= F.col("_a"), F.lit(names[0]))
             .when(F.col("rn") <= F.col("_b"), F.lit(names[1])).otherwise(F.lit(names[2])))
    return out.withColumn("split", split).drop("_a", "_b", "rn")


def hash_split(df: DataFrame, id_col: str = "doc_id", seed: int = 42, fractions=(0.8, 0.1, 0.1),
               names=("train", "validation", "test")) -> DataFrame:
    """SPL1 scalable mode: split from the first 32 bits of the row hash."""
    u = F.conv(F.substring(shuffle_key(id_col, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    a, b = fractions[0], fractions[0] + fractions[1]
    return df.withColumn("split", F.when(u < a, names[0]).when(u < b, names[1]).otherwise(names[2]))


def batches(df: DataFrame, batch_size: int, id_col: str = "doc_id", seed: int = 42,
            drop_remainder: bool = True) -> DataFrame:
    """SPL3 ``generate_batch_indices`` (and SPL6 with ``drop_remainder=False``):
    ``batch_id`` = (rank - 1) // batch_size over the seeded order; with
    ``drop_remainder`` the incomplete last batch is left out."""
    ranked, n = seeded_rank(df, id_col, seed)
    out = ranked.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch_size))
    if drop_remainder:
        n_batches = n // batch_size
        out = out.where(F.col("batch_id") < n_batches)
    return out


def select_batch(batched: DataFrame, batch_num: int) -> DataFrame:
    """SPL4: rows of one batch; a number past the last batch is an error
    (raised inside the job, Q15)."""
    last = batched.agg(F.max("batch_id")).first()[0]
    if last is None or batch_num < 0 or batch_num > last:
        raise ValueError(f"batch {batch_num} does not exist (last batch is {last})")
    return batched.where(F.col("batch_id") == batch_num)


def first_n(df: DataFrame, n: int, order_col: str = "doc_id") -> DataFrame:
    """SPL5 ``max_samples``: the first ``n`` rows by id (a sampling feature;
    Spark runs it as a distributed top-k)."""
    return df.orderBy(order_col).limit(n)


def cap_per_group(df: DataFrame, caps: dict, group_col: str = "split", order_col: str = "doc_id") -> DataFrame:
    """SPL5 per-split caps: keep the first ``cap`` rows (by ``order_col``) of
    each capped group; other groups pass whole.  The literal bound lets Spark
    apply the window group limit per task before the shuffle, so a group
    holding a third of the data ships only ``cap`` rows per task."""
    if not caps:
        return df
    w = Window.partitionBy(group_col).orderBy(order_col)
    cap = F.lit(None).cast("long")
    for g, c in caps.items():
        cap = F.when(F.col(group_col) == g, F.lit(c)).otherwise(cap)
    groups = list(caps)
    capped = (df.where(F.col(group_col).isin(groups))
              .withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= max(caps.values()))
              .where(F.col("_r") <= cap).drop("_r"))
    rest = df.where(~F.col(group_col).isin(groups) | F.col(group_col).isNull())
    return capped.unionByName(rest)
