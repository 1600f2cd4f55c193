"""Corpus ingest and sinks: SRC2 pair files, JOIN1 pairing, SET1, SNK1-SNK3.

The folders ``<root>/<folder>/docsutf8/*.txt`` and ``<root>/<folder>/keys/*.key``
of each named dataset are first *listed* (paths only, from any Hadoop file
system: local, HDFS, ``s3a://``).  The listing is a table: it is ranked by name
within each dataset, capped and paired (by position, the reference's behaviour,
Q16, or by file stem).  This manifest decides which bodies are wanted; only
those files are read.  Ranks come from a written rank index, so a dataset
holding a third of all files is not ranked in one task, and no body takes part
in a sort.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyforge.functions.text import strip
from keyforge.operators.splits import rank_index
from keyforge.session import written

#: The datasets of the reference's curation notebook: fixed values, name to folder.
DATASETS = {"inspec": "Inspec", "krapivin": "Krapivin2009", "pubmet": "PubMed", "www": "www"}
#: Rows of a per-dataset table up to which it is broadcast.
BROADCAST_DATASETS = 100_000


def list_files(spark: SparkSession, root: str, sub: str, ext: str, datasets: Mapping[str, str] | None = None) -> DataFrame:
    """SRC2a: (dataset, name, path) of the files below ``<root>/<folder>/<sub>``;
    no content is read.  ``datasets`` names the folders to take; without it
    every folder is a dataset of its own name."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}")
           .option("recursiveFileLookup", "true").load(root).select("path"))
    parts = rf"/([^/]+)/{sub}/(.+)\.{ext}$"
    files = raw.where(F.col("path").rlike(parts)).select(
        F.regexp_extract("path", parts, 1).alias("folder"), F.regexp_extract("path", parts, 2).alias("name"), "path")
    if datasets is None:
        return files.withColumnRenamed("folder", "dataset")
    named = F.element_at(F.create_map(*(F.lit(x) for pair in ((f, d) for d, f in datasets.items()) for x in pair)), F.col("folder"))
    return files.where(F.col("folder").isin(list(datasets.values()))).select(named.alias("dataset"), "name", "path")


def read_bodies(spark: SparkSession, files: DataFrame, out: str) -> DataFrame:
    """SRC2b: ``files`` with the stripped UTF-8 content of their ``path`` as
    ``out``.  The wanted paths go to the reader, which opens no other file;
    their number is bounded by the cap per dataset of the manifest."""
    wanted = [r.path for r in files.select("path").toLocalIterator()]
    if not wanted:
        return files.withColumn(out, F.lit(None).cast("string"))
    # commas part the paths of one load call; braces and the like are globs there
    escaped = [_literal(p) for p in wanted]
    raw = spark.read.format("binaryFile").load(escaped).select("path", strip(F.decode("content", "UTF-8")).alias(out))
    return files.join(raw, "path")


def _literal(path: str) -> str:
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def read_pair_files(spark: SparkSession, root: str, datasets: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC2 without pairing: (dataset, name, text) and (dataset, name, key) of all listed files."""
    def side(sub: str, ext: str, out: str) -> DataFrame:
        files = list_files(spark, root, sub, ext, datasets)
        raw = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true")
               .load(root).select("path", strip(F.decode("content", "UTF-8")).alias(out)))
        return files.join(raw, "path").drop("path")

    return side("docsutf8", "txt", "text"), side("keys", "key", "key")


def _ranked(files: DataFrame) -> DataFrame:
    """(dataset, name, n, rn): every file's place within its dataset by name
    (distributed), and the dataset's size."""
    names = files.select("dataset", "name")
    g = rank_index(names, ["dataset", "name"], ["dataset", "name"], "g")
    starts = written(g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), (F.min("g") - 1).alias("off")), "datasets")
    small = starts.count() <= BROADCAST_DATASETS
    return (g.join(F.broadcast(starts) if small else starts, "dataset")
            .select("dataset", "name", "n", (F.col("g") - F.col("off")).alias("rn")))


def manifest(txt: DataFrame, key: DataFrame, max_per_dataset: int = 1000) -> DataFrame:
    """JOIN1 + SRC2c on listings: (dataset, rn, txt_name, key_name) of the i-th
    ``.txt`` and the i-th ``.key`` of a dataset in name order, for
    i <= min(n_txt, n_key, max_per_dataset).  Both sides are cut to the cap
    before they meet."""
    t = _ranked(txt).where(F.col("rn") <= max_per_dataset).select("dataset", "rn", F.col("name").alias("txt_name"))
    k = _ranked(key).where(F.col("rn") <= max_per_dataset).select("dataset", "rn", F.col("name").alias("key_name"))
    return t.join(k, ["dataset", "rn"])


def pair_positional(txt: DataFrame, key: DataFrame, max_per_dataset: int = 1000) -> DataFrame:
    """JOIN1 + SRC2c on tables that hold the bodies: the manifest of their
    names, then the bodies of the chosen rows.  Returns (dataset, rn,
    txt_name, key_name, text, key)."""
    m = manifest(txt, key, max_per_dataset)
    t = txt.select("dataset", F.col("name").alias("txt_name"), "text")
    k = key.select("dataset", F.col("name").alias("key_name"), "key")
    return m.join(t, ["dataset", "txt_name"]).join(k, ["dataset", "key_name"]).select("dataset", "rn", "txt_name", "key_name", "text", "key")


def ingest(spark: SparkSession, root: str, datasets: Mapping[str, str] | None = None, max_per_dataset: int = 1000) -> DataFrame:
    """SRC2: (dataset, rn, txt_name, key_name, text, key) of the paired files of
    the named datasets; files that the manifest leaves out are not opened."""
    txt, key = list_files(spark, root, "docsutf8", "txt", datasets), list_files(spark, root, "keys", "key", datasets)
    m = written(manifest(txt, key, max_per_dataset), "manifest")
    for name, files, out in (("txt_name", txt, "text"), ("key_name", key, "key")):
        chosen = m.select("dataset", name).join(files.withColumnRenamed("name", name), ["dataset", name])
        m = m.join(read_bodies(spark, chosen, out).select("dataset", name, out), ["dataset", name])
    return m.select("dataset", "rn", "txt_name", "key_name", "text", "key")


def pair_by_stem(txt: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOIN1 safer option: equi-join on (dataset, name); second result lists
    the files without a partner."""
    paired = txt.join(key, ["dataset", "name"])
    unmatched = (txt.select("dataset", "name", F.lit("txt").alias("side"))
                 .join(key.select("dataset", "name"), ["dataset", "name"], "left_anti")
                 .unionByName(key.select("dataset", "name", F.lit("key").alias("side"))
                              .join(txt.select("dataset", "name"), ["dataset", "name"], "left_anti")))
    return paired, unmatched


def pair_report(txt: DataFrame, key: DataFrame, max_per_dataset: int = 1000) -> DataFrame:
    """SRC2d: per dataset n_txt, n_key, pairs used; skipped when zero,
    flagged when the counts differ.  Both sides are counted per dataset
    (partial aggregates) and full-outer joined."""
    a = txt.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_txt"))
    b = key.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_key"))
    j = a.join(b, "dataset", "full")
    n_txt, n_key = F.coalesce("n_txt", F.lit(0)), F.coalesce("n_key", F.lit(0))
    pairs = F.least(n_txt, n_key, F.lit(max_per_dataset))
    return j.select("dataset", n_txt.alias("n_txt"), n_key.alias("n_key"), pairs.alias("pairs"),
                    (pairs == 0).alias("skipped"), (n_txt != n_key).alias("count_mismatch"))


def concatenated(*pairs: DataFrame) -> DataFrame:
    """SET1: the (text, key, dataset) table of all datasets, one below another."""
    out = pairs[0].select("text", "key", "dataset")
    for p in pairs[1:]:
        out = out.unionByName(p.select("text", "key", "dataset"))
    return out


def write_parquet_gzip(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: gzip-compressed parquet."""
    df.write.mode(mode).option("compression", "gzip").parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: the split dataset, one folder per split (partition pruning on
    read, SRC3)."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: metrics as JSON (one small file)."""
    metrics.coalesce(1).write.mode(mode).json(path)
