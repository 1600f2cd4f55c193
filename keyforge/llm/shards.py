"""Sharding by a two-pass external shuffle (operator 9).

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of the whole record and, for equal records, of their ordinal, so that a record
repeated many times spreads as well.  Pass two reads each bucket as one array,
in a defined order, applies a Fisher-Yates shuffle (Spark's ``shuffle``, which
swaps in place with a seeded generator; bucket b lies in partition b, so its
generator is the same in every run) and writes it.  Buckets laid end to end
are one uniform permutation.  Shard s takes positions [s*N/S, (s+1)*N/S): the
``rows`` law, counts at most one apart.

Whole records pass two exchanges: equal ones meet and are counted (partially
before the exchange, so a record that holds a third of all rows is one row of
each task), then all are scattered.  How many rows a bucket will hold follows
from hashes alone, in a job of its own; the place of a bucket's first row is a
prefix sum in two steps, over groups of buckets and over at most ``GROUPS``
group totals, and travels to its bucket as one more row of the scatter.  A
bucket lies in at most two shards and is written where it is, so there are as
many write tasks as buckets.

Every input row comes out once, nulls included.  An empty table gives an empty
result.  Columns named like the results are carried apart and not overwritten:
the caller gets the record as a struct.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyforge.llm.common import no_null, written
from keyforge.session import ensure_checkpoint_dir

GROUPS = 1024
LAW = "rows"


def digests(records: DataFrame, seed: int) -> list[Column]:
    """128 bits that tell records apart; nulls count by their place."""
    parts: list[Column] = []
    for f in records.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), c]
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            parts.append(F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    return [F.xxhash64(F.lit(seed + k), *parts).alias(f"_d{k}") for k in (0, 1)]


def _each(counted: DataFrame, buckets: int, *cols: str) -> DataFrame:
    """One row per ordinal of a counted digest, with its bucket."""
    each = counted.select("_d0", "_d1", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("ordinal"), *cols)
    return each.withColumn("bucket", F.pmod(F.xxhash64("_d0", "_d1", "ordinal"), F.lit(buckets).cast("bigint")).cast("int"))


def scatter(records: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass one: (bucket, order, ordinal, rec)."""
    counted = records.select(*digests(records, seed), F.struct("*").alias("rec")).groupBy("_d0", "_d1", "rec").agg(F.count(F.lit(1)).alias("n"))
    return _each(counted, buckets, "rec").select("bucket", F.xxhash64("_d1", "_d0", "ordinal").alias("order"), "ordinal", "rec")


def bucket_places(records: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, first, total): the position of each bucket's first row, and the number of all rows; written."""
    counted = records.select(*digests(records, seed)).groupBy("_d0", "_d1").agg(F.count(F.lit(1)).alias("n"))
    counts = written(_each(counted, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "grp", F.floor(F.col("bucket") * F.lit(GROUPS) / F.lit(buckets))))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("n"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(totals), "grp")
    return written(first.select("bucket", (F.col("base") + F.col("first")).alias("first"), "total"))


def shuffled_buckets(scattered: DataFrame, places: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass two: (first, total, recs) of each bucket, shuffled.  The rows of a
    bucket are one partition already when they are gathered."""
    types = dict(scattered.dtypes)
    none = [F.lit(None).cast(types[c]).alias(c) for c in ("order", "ordinal", "rec")]
    marks = places.select("bucket", *none, "first", "total")
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("first", "total")]
    placed = scattered.select("bucket", "order", "ordinal", "rec", *nothing).unionByName(marks).repartitionById(buckets, F.col("bucket"))
    rows = F.sort_array(F.collect_list(F.when(F.col("rec").isNotNull(), F.struct("order", "ordinal", "rec"))))
    arrays = placed.groupBy("bucket").agg(rows.alias("recs"), F.max("first").alias("first"), F.max("total").alias("total"))
    return arrays.select("first", "total", F.shuffle(F.col("recs"), F.lit(seed)).alias("recs"))


def n_bytes(records: DataFrame) -> Column:
    """About the bytes of a row: the lengths of strings and binaries, JSON for nested values, 8 for others."""
    out = F.lit(8).cast("bigint")
    for f in records.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(F.struct(c))
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            c = F.lit("8 bytes.")
        out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out


def n_buckets(records: DataFrame, bucket_rows: int, bucket_bytes: int, least_buckets: int) -> int:
    rows, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(n_bytes(records)), F.lit(0))).first()
    return max(least_buckets, -(-rows // bucket_rows), -(-size // bucket_bytes))


def assign(records: DataFrame, shards: int = 16, seed: int = 42, bucket_rows: int = 20_000, least_buckets: int = 256, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(rec, shard, slot) for every record; ``rec`` is the input row as a struct.

    ``bucket_rows`` and ``bucket_bytes`` bound the mean size of a bucket, which
    one task holds in memory; there are more buckets for more rows or longer
    ones.  Records are compared and ordered, so they may not hold maps."""
    buckets = n_buckets(records, bucket_rows, bucket_bytes, least_buckets)
    arrays = shuffled_buckets(scatter(records, buckets, seed), bucket_places(records, buckets, seed), buckets, seed)
    each = arrays.select("first", "total", F.posexplode("recs").alias("i", "r"))
    at = F.col("first") + F.col("i")
    placed = each.select(F.col("r.rec").alias("rec"), at.alias("at"), F.expr(f"(first + i) * {shards} div total").alias("shard"), "total")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select("rec", F.col("shard").cast("int").alias("shard"), (F.col("at") - start).cast("bigint").alias("slot"))


def write_shards(records: DataFrame, path: str, shards: int = 16, seed: int = 42, **kw) -> None:
    """Write every shard as a folder ``shard=s``; each of its files holds a run
    of its rows in slot order."""
    placed = assign(records, shards, seed, **kw).select("shard", "slot", "rec")
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 42, **kw) -> DataFrame:
    """Shard and slot of every document, with its size and checksum.  The whole
    records are written as shards and all columns come from what was written."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, shards, seed, **kw)
    record = T.StructField("rec", docs.schema)
    back = docs.sparkSession.read.schema(T.StructType([T.StructField("slot", T.LongType()), record, T.StructField("shard", T.IntegerType())])).parquet(path)
    text = no_null(F.col("rec.text"))
    return back.select(
        "rec.doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
