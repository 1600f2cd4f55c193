"""Mixing sources to target weights by hash-threshold histograms (operator 6).

Targets are set on the table of sources alone: every source gets its weight's
share of the wanted total, but at most ``max_epochs`` times its own size; the
excess goes to the others by weight until none is above.  With the sources
ordered by limit / weight this is one water level over prefix sums.

A source whose target is k whole epochs and a rest takes each document k
times, and those whose seeded hash lies under a threshold once more.  The
threshold comes from histograms: sizes are summed by source and the first 12
bits of the hash, the bucket in which the running sum passes the rest is the
boundary, and only that bucket is summed again by the next 12 bits, five times
over 60 bits.  Thresholds are nested: a larger budget takes a superset.
Documents are never sorted, and the hash depends on ``doc_id`` and the seed
only, so reruns agree.

A null source is a source of its own, last in the order.  Documents without
words have size 0.  Rows that share a ``doc_id`` share a hash and are taken
together.  An empty table gives an empty result.  Columns of the input besides
the id, source and text are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyforge.llm.common import WORD_PATTERN, broadcast_if, no_null, written

LEVELS, BITS = 5, 12
#: Source tables up to this many rows (some MB) are broadcast.
BROADCAST_SOURCES = 50_000


def seeded_hash(key: Column, seed: str) -> Column:
    """60 bits of a seeded digest of ``key``, as bigint."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """``sizes`` (source, source_size) with sid, target, epochs and rest.  The
    input has one row per source; its windows see that summary only."""
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("sid", F.row_number().over(by_name))
         .withColumn("w", weight)
         .withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
         .withColumn("wanted", F.sum("source_size").over(total) * F.lit(share)))
    level = Window.orderBy(F.col("limit") / F.col("w"), "sid")
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("water", (F.col("wanted") - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("free", F.col("water") * F.col("w") < F.col("limit"))
    s = s.withColumn("water", F.min(F.when(F.col("free"), F.struct((F.col("limit") / F.col("w")).alias("at"), "sid", "water"))).over(total)["water"])
    s = s.withColumn("target", F.when(F.col("water") * F.col("w") < F.col("limit"), F.col("water") * F.col("w")).otherwise(F.col("limit")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (s.withColumn("epochs", epochs.cast("bigint"))
            .select("sid", "source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the hash threshold under which documents are taken once
    more.  ``rows`` has sid, size and h."""
    bound = sources.withColumns({"prefix": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint"), "cell": F.lit(None).cast("bigint"), "open": F.col("rest") > 0})
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        edge = bound.where("open").select("sid", "prefix")
        inside = rows if level == 1 else rows.join(broadcast_if(edge, BROADCAST_SOURCES), "sid").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("sid", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        sums = sums.join(bound.where("open").select("sid", "rest", "before"), "sid")
        running = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(running)).where("upto > rest")
        first = sums.groupBy("sid").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n")).alias("b"))
        bound = bound.join(first, "sid", "left").select(
            *sources.columns,
            F.when(F.col("open"), F.coalesce(F.col("b.bucket"), F.shiftleft(F.lit(1).cast("bigint"), BITS * level))).otherwise(F.shiftleft("prefix", BITS)).alias("prefix"),
            F.coalesce("b.before", "before").alias("before"), F.coalesce("b.n", "cell").alias("cell"),
            (F.col("open") & F.col("b").isNotNull()).alias("open"))
        bound = written(bound)
    # The last cell, of one hash value, is taken if that comes nearer.
    whole = F.col("open") & (F.col("rest") - F.col("before") > F.col("cell") / 2)
    return bound.select(*sources.columns, (F.col("prefix") + whole.cast("bigint")).alias("threshold"))


def _compact(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(no_null(text_col)).alias("size"), seeded_hash(F.col(id_col), seed).alias("h")))


def plan(rows: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """One row per source of ``rows`` (id, source, size, h): its size, target,
    whole epochs and hash threshold."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes, weights, share, max_epochs))
    named = broadcast_if(sources.select(F.col("source").alias("name"), "sid"), BROADCAST_SOURCES)
    coded = rows.join(named, F.col("source").eqNullSafe(F.col("name"))).select("size", "h", "sid")
    return thresholds(coded, sources)


def _copies(h: Column) -> Column:
    """How often a document with this hash is taken, beside its source's ``cut``."""
    return F.col("cut.epochs") + (h < F.col("cut.threshold")).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    rows = _compact(docs, seed, id_col, text_col, source_col)
    cuts = broadcast_if(plan(rows, weights, share, max_epochs).select(F.struct("*").alias("cut")), BROADCAST_SOURCES)
    out = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut.source")))
    return out.select(F.col("id").alias(id_col), "size", "cut.source_size", "cut.target", (F.col("size") * _copies(F.col("h"))).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: ``docs`` unchanged, each as often as it is taken.
    Texts are neither shuffled nor sorted."""
    cuts = broadcast_if(plan(_compact(docs, seed, id_col, text_col, source_col), weights, share, max_epochs).select(F.struct("*").alias("cut")), BROADCAST_SOURCES)
    out = docs.select(F.struct("*").alias("row")).join(cuts, F.col(f"row.{source_col}").eqNullSafe(F.col("cut.source")))
    n = _copies(seeded_hash(F.col(f"row.{id_col}"), seed))
    times = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n))
    return out.select("row", F.explode(times).alias("time")).select("row.*")
