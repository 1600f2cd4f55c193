"""Parquet table access (SRC1, SRC3) and document-local partitioning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC1: parquet scan; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "text")) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*cols)


def by_doc(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition once by document id.

    Everything downstream (token tables, term statistics, candidate windows,
    joins) is keyed by ``doc_id`` first; with AQE off and
    ``requireAllClusterKeysForCoPartition=false`` this is the only shuffle of
    the per-document pipeline (see ``keyforge.session``).  No partition count
    is fixed so AQE can size it from the data.
    """
    return df.repartition(F.col(key))


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """SRC3: read one split of a dataset written with ``partitionBy('split')``;
    the filter prunes partitions at planning time."""
    return spark.read.parquet(path).where(F.col("split") == split)


def record(df: DataFrame, doc_id: int) -> DataFrame:
    """SRC4 ``print_record`` / ``get_record``: one record by id."""
    return df.where(F.col("doc_id") == doc_id)


def require_columns(df: DataFrame, cols, what: str = "input") -> DataFrame:
    """FLT6: fail before planning when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} must contain columns {list(cols)}; missing {missing}, got {df.columns}")
    return df
