"""Refinement rules (REF1/REF2), merge (SET3), scalable split and caps."""
from pyspark.sql import functions as F

from keyforge.operators import splits as S
from keyforge.operators import stages as ST
from tests.conftest import rows


def test_merge_priority_and_casing(spark):
    df = spark.createDataFrame([(["GPU kernel", " x "], ["gpu KERNEL", "y"], ["", "X", "z"])],
                               "a array<string>, b array<string>, c array<string>")
    out = df.select(ST.merge_candidates(F.col("a"), F.col("b"), F.col("c")).alias("m")).first()["m"]
    assert out == ["GPU kernel", "x", "y", "z"]


def test_refine_rules_dedup_and_fill(spark):
    text = " ".join(["matrix"] * 5 + ["kernel"] * 4 + ["tensor"] * 3 + ["vector"] * 2 + ["scalar"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cands = spark.createDataFrame([(1, ["gpu kernels.", "GPU kernel", "kernel gpu", "the", "a", "paper topic",
                                        "one two three four five six", "x", "tensor cores"])],
                                  "doc_id long, combined array<string>")
    out = rows(ST.refine(cands, docs, ST.RefineConfig(min_items=4, max_items=18)))[0]["refined"]
    # trailing period dropped; plural / order variants merged into the first form;
    # stop-word-only, banned, too long and one-character items removed
    assert out[:2] == ["gpu kernels", "tensor cores"]
    # filled with the most frequent words whose key is not taken yet (keys are
    # whole phrases, so the word "kernel" is not covered by "gpu kernels")
    assert out[2:] == ["matrix", "kernel"]


def test_audit_counts(spark):
    docs = spark.createDataFrame([(1, "Sparse attention in long documents")], "doc_id long, text string")
    cands = spark.createDataFrame([(1, ["sparse attention", "documents"])], "doc_id long, combined array<string>")
    lists = spark.createDataFrame([(1, ["Sparse Attention", "graph", "documents"])], "doc_id long, keywords array<string>")
    a = rows(ST.audit(lists, cands, docs))[0]
    assert (a["n_items"], a["n_verbatim"], a["n_from_candidates"]) == (3, 2, 2)
    assert not a["size_ok"]


def test_hash_split_and_caps(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    h = {r["split"]: r["count"] for r in rows(S.hash_split(df).groupBy("split").count())}
    assert abs(h["train"] / 20000 - 0.8) < 0.02 and abs(h["test"] / 20000 - 0.1) < 0.02
    capped = S.cap_per_group(S.hash_split(df), {"validation": 5, "test": 7})
    c = {r["split"]: r["count"] for r in rows(capped.groupBy("split").count())}
    assert c["validation"] == 5 and c["test"] == 7 and c["train"] == h["train"]
