"""Chunks, batches, splits and model-input arrays (CHK, SPL, ENC)."""
import pytest
from pyspark.sql import functions as F

from keyforge.operators import chunks as CH
from keyforge.operators import encode as EN
from keyforge.operators import splits as S
from tests.conftest import rows


def test_chunks_of_100_words(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate([0, 99, 100, 150])],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in rows(CH.word_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")))}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2}


def test_batches_drop_remainder(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    b = S.batches(df, 4)
    assert b.count() == 8
    assert sorted(r["batch_id"] for r in rows(b.select("batch_id").distinct())) == [0, 1]
    with pytest.raises(ValueError):
        S.select_batch(b, 2)


def test_exact_split_counts_disjoint_complete(spark):
    df = spark.range(1001).withColumnRenamed("id", "doc_id")
    s = S.three_way_split(df)
    counts = {r["split"]: r["count"] for r in rows(s.groupBy("split").count())}
    assert counts == {"train": 800, "validation": 100, "test": 101}
    assert s.select("doc_id").distinct().count() == 1001


def test_eos_after_truncation(spark):
    df = spark.createDataFrame([(list(range(2, 130)),)], "ids array<int>")
    out = df.select(EN.append_eos(F.col("ids")).alias("o")).first()["o"]
    assert len(out) == 129 and out[-1] == EN.EOS
    df2 = spark.createDataFrame([([5, 1],)], "ids array<int>")
    assert df2.select(EN.append_eos(F.col("ids")).alias("o")).first()["o"] == [5, 1]


def test_pad_to_multiple_of_8(spark):
    df = spark.createDataFrame([(0, list(range(3, 12))), (0, [3])], "b int, ids array<int>")
    out = rows(EN.pad_batch(df, "b", "ids", 2048, 8))
    assert {len(r["ids"]) for r in out} == {16}


def test_collator_labels(spark):
    df = spark.createDataFrame([(0, [7, 8], [5, 1]), (0, [9], [6])], "b int, input_ids array<int>, labels array<int>")
    out = sorted(rows(EN.collate(df, "b")), key=lambda r: r["input_ids"][0])
    assert out[0]["labels"] == [5, 1] and out[1]["labels"] == [6, -100]
    assert out[1]["input_ids"] == [9, 0] and out[1]["attention_mask"] == [1, 0]


def test_prompt_mask(spark):
    df = spark.createDataFrame([([10, 11, 12, 13, 0, 0], 2, 4)], "ids array<int>, t int, s int")
    out = df.select(EN.prompt_mask_labels(F.col("ids"), F.col("t"), F.col("s")).alias("l")).first()["l"]
    assert out == [-100, -100, 12, 13, -100, -100]
