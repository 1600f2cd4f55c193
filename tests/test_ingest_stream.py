"""Pair files (SRC2, JOIN1), sinks (SNK1-3), split read (SRC3), streaming."""
import os
import tempfile
import time

from pyspark.sql import functions as F

from keyforge.sources import ingest as IG
from keyforge.sources.tables import load_split
from tests.conftest import SF, rows


def make_pairs(root):
    layout = {
        "Inspec": ["a1", "a2", "a3"],
        "www": ["b1", "b2", "sub/b3"],
    }
    for ds, names in layout.items():
        for n in names:
            for sub, ext, body in (("docsutf8", "txt", f"  text of {n}\n"), ("keys", "key", f"k1 {n}\nk2\n")):
                if ds == "www" and n == "b2" and ext == "key":
                    continue  # one .key missing
                p = os.path.join(root, ds, sub, f"{n}.{ext}")
                os.makedirs(os.path.dirname(p), exist_ok=True)
                with open(p, "w", encoding="utf-8") as f:
                    f.write(body)
    with open(os.path.join(root, "www", "docsutf8", "README.md"), "w") as f:
        f.write("stray")


def test_pair_files(spark):
    root = tempfile.mkdtemp(prefix="kf-pairs-")
    make_pairs(root)
    txt, key = IG.read_pair_files(spark, root)
    assert txt.count() == 6 and key.count() == 5
    assert {r["text"] for r in rows(txt.where(F.col("name") == "a1"))} == {"text of a1"}
    rep = {r["dataset"]: r for r in rows(IG.pair_report(txt, key))}
    assert rep["www"]["n_txt"] == 3 and rep["www"]["n_key"] == 2 and rep["www"]["count_mismatch"]
    pos = rows(IG.pair_positional(txt, key).where(F.col("dataset") == "www").orderBy("rn"))
    assert [(r["txt_name"], r["key_name"]) for r in pos] == [("b1", "b1"), ("b2", "sub/b3")]  # Q16 mis-pairing
    paired, unmatched = IG.pair_by_stem(txt, key)
    assert paired.count() == 5 and [r["name"] for r in rows(unmatched)] == ["b2"]


def test_sinks_and_split_read(spark):
    out = tempfile.mkdtemp(prefix="kf-sink-")
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (3, "c", "test")],
                               "doc_id long, text string, split string")
    IG.write_splits(df, os.path.join(out, "ds"))
    t = load_split(spark, os.path.join(out, "ds"), "test")
    assert sorted(r["doc_id"] for r in rows(t)) == [2, 3]
    assert "PartitionFilters: [isnotnull(split" in t._jdf.queryExecution().executedPlan().toString()
    IG.write_parquet_gzip(df, os.path.join(out, "gz"))
    assert spark.read.parquet(os.path.join(out, "gz")).count() == 3
    IG.write_metrics(spark.createDataFrame([(0.5, 0.25)], "f1 double, rouge1 double"), os.path.join(out, "m"))
    assert spark.read.json(os.path.join(out, "m")).first()["f1"] == 0.5


def test_streaming_clean_and_extract(spark):
    from keyforge.operators import yake as Y
    from keyforge.streaming import documents as SD
    src = tempfile.mkdtemp(prefix="kf-src-")
    sink = tempfile.mkdtemp(prefix="kf-out-")
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").write.mode("overwrite").parquet(src + "/p1")
    stream = SD.read_documents(spark, src + "/p1")
    q = SD.clean_stream(stream).writeStream.format("memory").queryName("kf_clean").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS n FROM kf_clean").first()["n"] == 20
    q2 = SD.extract_per_batch(SD.read_documents(spark, src + "/p1"), Y.extract, sink,
                              checkpoint=tempfile.mkdtemp(prefix="kf-ck-"), query_name="kf_yake")
    q2.processAllAvailable()
    q2.stop()
    time.sleep(0.5)
    assert spark.read.parquet(sink).count() == 20


def test_required_columns(spark):
    import pytest
    from keyforge.sources.tables import require_columns
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert require_columns(df, ["doc_id", "text"]) is df
    with pytest.raises(ValueError):
        require_columns(df, ["text", "labels"], "split 'train'")
