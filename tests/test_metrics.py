"""Set F1 and ROUGE: golden values and invariants."""
import pytest

from keyforge.functions.porter import stem
from keyforge.operators import metrics as M
from tests.conftest import rows


def pairs(spark, data):
    return spark.createDataFrame(data, "doc_id long, pred array<string>, ref array<string>")


def test_f1_half(spark):
    r = rows(M.f1_keywords(pairs(spark, [(1, ["A", "b"], ["a", "c"])])))[0]
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)


def test_f1_empty(spark):
    r = rows(M.f1_keywords(pairs(spark, [(1, [], [])])))[0]
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_rouge_order_matters_for_l(spark):
    r = rows(M.rouge_scores(pairs(spark, [(1, ["a b", "c"], ["b a", "c"])])))[0]
    assert r["rouge1"] == pytest.approx(1.0)
    assert r["rougeL"] == pytest.approx(0.6667, abs=1e-4)
    assert r["count"] == 1


def test_rouge_identical_is_one_and_bounded(spark):
    data = [(1, ["x y z", "w"], ["x y z", "w"]), (2, ["p"], ["q r"]), (3, [], ["a"])]
    per = {r["doc_id"]: r for r in rows(M.rouge_per_doc(pairs(spark, data), keep=["doc_id"]))}
    assert per[1]["rouge1"] == pytest.approx(1.0) and per[1]["rougeL"] == pytest.approx(1.0)
    for r in per.values():
        assert 0.0 <= r["rouge1"] <= 1.0 and 0.0 <= r["rougeL"] <= 1.0
    assert per[3]["rouge1"] == 0.0


def test_lcs_matches_python(spark):
    import itertools
    import random
    rnd = random.Random(7)
    data = []
    for i in range(30):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
        data.append((i, a, b))

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    from pyspark.sql import functions as F
    df = spark.createDataFrame(data, "i long, a array<string>, b array<string>")
    got = {r["i"]: r["l"] for r in rows(df.select("i", M.lcs_length(F.col("a"), F.col("b")).alias("l")))}
    for i, a, b in data:
        assert got[i] == lcs(a, b)


def test_f1_symmetric_in_tp(spark):
    a = rows(M.f1_keywords(pairs(spark, [(1, ["a", "b", "c"], ["a"])])))[0]
    b = rows(M.f1_keywords(pairs(spark, [(1, ["a"], ["a", "b", "c"])])))[0]
    assert a["f1"] == pytest.approx(b["f1"]) and a["precision"] == pytest.approx(b["recall"])


@pytest.mark.parametrize("word,expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("happy", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("hopeful", "hope"), ("goodness", "good"),
    ("adjustment", "adjust"), ("controlling", "control"), ("generalization", "gener")])
def test_porter(word, expected):
    assert stem(word) == expected
