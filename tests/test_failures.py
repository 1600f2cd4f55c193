"""A job that fails says so: no empty list stands for work that was not done."""
import pytest
from pyspark.sql import functions as F

from keyforge.operators import keybert as KB
from keyforge.operators import stages as ST
from keyforge.operators import textrank as TR
from keyforge.operators import yake as Y
from keyforge.plans import catalog


def fails(*_):
    raise OSError("No space left on device")


@pytest.mark.parametrize("module", [Y, KB, TR])
def test_stage_one_fails_with_its_extractors(spark, monkeypatch, module):
    docs = spark.createDataFrame([(1, "Graph theory and graph search.")], "doc_id long, text string")
    monkeypatch.setattr(module, "extract", fails)
    with pytest.raises(OSError, match="No space left"):
        ST.stage_one(docs)
    with pytest.raises(OSError, match="No space left"):
        ST.two_stage(docs)


@pytest.mark.parametrize("name", ["set3_ext2_stage_one", "ext2_stage_one_json", "ref1_refine", "ref2_audit", "ref3_two_stage", "ref3_two_stage_with_answers", "agg6_method_report"])
def test_queries_fail_with_their_extractors(spark, monkeypatch, tmp_path, name):
    spark.createDataFrame([(1, "Graph theory and graph search.", "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    query = catalog.queries()[name]
    monkeypatch.setattr(TR, "extract", fails)
    with pytest.raises(OSError, match="No space left"):
        query(spark, str(tmp_path)).collect()


def test_a_task_that_fails_ends_stage_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Graph theory.")], "doc_id long, text string")
    monkeypatch.setattr(TR, "extract", lambda d, _: d.select("doc_id", F.raise_error(F.lit("lost")).cast("array<string>").alias("keywords")).checkpoint())
    with pytest.raises(Exception, match="lost"):
        ST.stage_one(docs)
