"""Spark session helpers.

Per-document operators group, window and join on keys that start with
``doc_id``, and documents are hash-partitioned by ``doc_id`` once
(``by_doc``).  With ``spark.sql.requireAllClusterKeysForCoPartition=false``
and AQE off, that one shuffle satisfies every later aggregate and join of
the pipeline (verified on the plans: no further exchange).  With AQE on
(the default here) Spark re-shuffles on the full keys but coalesces
partitions and splits skewed ones; measured on local[8] at sf0.1 AQE on is
as fast or faster, so it stays on.  ``spark.sql.adaptive.enabled=false``
switches to the single-shuffle plan.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A union of children that were shuffled by separate exchanges must not
    # claim their hash partitioning: AQE may coalesce those exchanges
    # differently, and an aggregate placed directly on the union would then
    # see one key in two partitions.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "keyforge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM.
        conf.setdefault("spark.driver.memory", os.environ.get("KEYFORGE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    tune(spark)
    ensure_checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Apply the session settings the operators rely on (idempotent)."""
    for k in ("spark.sql.requireAllClusterKeysForCoPartition",
              "spark.sql.unionOutputPartitioning",
              "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, DEFAULT_CONF[k])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (tests, local runs) fall back to a fresh local directory."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="keyforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Write ``df`` to the session's (shared) checkpoint folder and continue
    from it.  Used after multi-stage operators whose outputs are small
    (per-document keyword lists) so that later plans stay short: fault
    tolerant (no lineage replay after an executor loss) and cheap to plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str = "table"):
    """``df`` as Parquet in the session's shared checkpoint folder, read again.
    Unlike a cache it never changes after the loss of an executor, its columns
    can be pruned, and AQE can split its skewed partitions in a join."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_SCRATCH: list[list] = []


@contextlib.contextmanager
def scratch():
    """Tables that ``keep`` caches inside are released at the end.  What is
    returned from inside must have been written (``cut_lineage``, ``written``)."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            df.unpersist()


def keep(df):
    """``df`` cached for several readers (it spills to disk, and is computed
    anew if an executor is lost) until the surrounding ``scratch`` ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _SCRATCH:
        _SCRATCH[-1].append(df)
    return df
