"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyforge.session import ensure_checkpoint_dir

#: Words are maximal runs of other characters than these six.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The same characters for ``translate`` and ``str`` methods.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """Send a module's functions to the Python workers by value, so executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch brings into a Python worker: rows, and bytes
    for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: read again, never
    recomputed, and whole after the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a written table of at most ``max_rows`` rows; above that the
    join is a shuffled one, whose skewed partitions AQE splits."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def no_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
