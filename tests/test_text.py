"""Golden edge rows of FIXTURES.md §4 for the text / keyword normalisers."""
from pyspark.sql import functions as F

from keyforge.functions import text as T


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_tab_deleted_and_lines_stripped(spark):
    assert one(spark, T.clean_text, "a\tb\r\n c  d ") == "ab\nc d"


def test_control_characters(spark):
    assert one(spark, T.clean_text, "x\x00y\x7fz") == "xyz"


def test_clean_text_idempotent(spark):
    s = "  A  b\t\n\n  c 　"
    once = one(spark, T.clean_text, s)
    assert one(spark, T.clean_text, once) == once


def test_null_kw_string(spark):
    assert one(spark, T.normalize_kw_string, None) == []


def test_mixed_separators(spark):
    assert one(spark, T.normalize_kw_string, "A; b,a\n B ;C") == ["A", "b", "C"]


def test_case_folding_sharp_s(spark):
    assert one(spark, T.dedup_ci, ["Straße", "STRASSE"], "array<string>") == ["Straße"]


def test_outer_punctuation(spark):
    assert one(spark, T.clean_kw, "  “gpu   kernel”, ") == "gpu kernel"


def test_length_bounds(spark):
    f = lambda c: T.postprocess(c, min_len=2, max_len=2)
    assert one(spark, f, ["a", "ab", "abc"], "array<string>") == ["ab"]


def test_to_keywords_drops_blank_lines_and_case_copies(spark):
    assert one(spark, T.to_keywords, "alpha\nbeta\nALPHA\n\n") == ["alpha", "beta"]


def test_word_count_unicode_space(spark):
    assert one(spark, T.word_count, "") == 0
    assert one(spark, T.word_count, " a b  c ") == 3


def test_keep_punctuated_sentences(spark):
    assert one(spark, T.keep_punctuated_sentences, "Title\nFirst one. Second one!\nno end") == "First one.\nSecond one!"


def test_join_keywords(spark):
    assert one(spark, T.join_keywords, [" a ", "", "(b)"], "array<string>") == "a; b"
