"""Evaluation: set F1 (AGG1), ROUGE-1 (AGG2), ROUGE-L (AGG3), corpus means
(AGG4), method reports (AGG6/AGG7), split sizes (AGG8), token accounting
(AGG9/AGG10).

Per-document scores are computed on the two keyword arrays of one row (no
shuffle); corpus figures are plain partial + final aggregates.  The two counts
of ROUGE take an Arrow batch of rows: clipped overlap from token counts, and
the longest common subsequence with the rows of its table held as bits, one
addition per predicted token.
"""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.functions.porter import stem_table
from keyforge.functions.text import col_, fold, join_keywords
from keyforge.session import written

# The counts travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUGE_TOKEN = "[a-z0-9]+"


def set_counts(pred, ref) -> tuple[Column, Column, Column]:
    """tp, fp, fn of the case-folded keyword sets of one row."""
    ps, rs = folded_set(pred), folded_set(ref)
    tp = F.size(F.array_intersect(ps, rs))
    fp = F.size(F.array_except(ps, rs))
    fn = F.size(F.array_except(rs, ps))
    return tp.cast("bigint"), fp.cast("bigint"), fn.cast("bigint")


def folded_set(c) -> Column:
    """The distinct case-folded keywords of a list."""
    return F.array_distinct(F.transform(F.coalesce(col_(c), F.array().cast("array<string>")), fold))


def with_reference(pairs: DataFrame, ref: str = "ref") -> DataFrame:
    """``pairs`` with what ``evaluation_report`` needs of their reference lists,
    made once for all predictions that meet it."""
    return pairs.withColumns({"_rs": folded_set(ref), "_rt": rouge_tokens(F.col(ref))})


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision / recall / F1 with 0 on an empty denominator."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f


def f1_keywords(pairs: DataFrame, pred: str = "pred", ref: str = "ref",
                by: list[str] | None = None) -> DataFrame:
    """AGG1 ``f1_keywords``: micro precision / recall / F1 over all rows."""
    by = by or []
    tp, fp, fn = set_counts(pred, ref)
    agg = (pairs.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
           .groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                             F.sum("fn").alias("fn")))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                      f.alias("f1"))


def rouge_tokens(arr) -> Column:
    """ROUGE tokens of a keyword list: joined with '; ', lower-cased, runs of
    ``[a-z0-9]`` (no stemming)."""
    return F.regexp_extract_all(F.lower(join_keywords(arr)), F.lit(ROUGE_TOKEN), 0)


def _fmeasure(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    p = hits / F.greatest(n_pred, F.lit(1))
    r = hits / F.greatest(n_ref, F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _row_wise(count, *cols: Column) -> Column:
    """``count(pred tokens, ref tokens)`` of every row, a batch of rows at a time."""
    return F.arrow_udf(lambda p, r: pa.array([count(x, y) for x, y in zip(p.to_pylist(), r.to_pylist(), strict=True)], pa.int64()), "long")(*cols)


def _overlap(pt: list | None, rt: list | None) -> int | None:
    if pt is None or rt is None:
        return None if pt is None else len(pt)
    return sum((Counter(pt) & Counter(rt)).values())


def _lcs(pt: list | None, rt: list | None) -> int | None:
    """Bit ``j`` of the row is 0 where the length grows at ``rt[j]``: one sum per token of ``pt`` updates the whole row."""
    if not rt:
        return 0
    if pt is None:
        return None
    at: dict = {}
    for j, t in enumerate(rt):
        at[t] = at.get(t, 0) | 1 << j
    row = full = (1 << len(rt)) - 1
    for t in pt:
        if hit := row & at.get(t, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(rt) - row.bit_count()


def rouge1(pt: Column, rt: Column) -> Column:
    """AGG2: ROUGE-1 F of two token arrays (clipped unigram overlap)."""
    return _fmeasure(_row_wise(_overlap, pt, rt), F.size(pt), F.size(rt))


def lcs_length(pt: Column, rt: Column) -> Column:
    """Longest common subsequence length of two token arrays."""
    return _row_wise(_lcs, pt, rt)


def rougeL(pt: Column, rt: Column) -> Column:
    """AGG3: ROUGE-L F of two token arrays."""
    lcs = lcs_length(pt, rt)
    n, m = F.size(pt), F.size(rt)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(_fmeasure(lcs, n, m))


def stemmed(t: DataFrame, cols: tuple = ("_pt", "_rt")) -> DataFrame:
    """AGG5: ``t`` with the tokens of two array columns replaced by their stems.
    Every distinct token is stemmed once; the stems come back by a join on the
    token with the written stem table (AQE can split its hot tokens), and by
    row and place."""
    t = written(t.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    words = t.select("_row", F.posexplode(F.concat(*cols)).alias("pos", "token"))
    stems = written(stem_table(words.select("token").distinct()), "stems")
    back = (words.join(stems, "token").groupBy("_row")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("s")).select("_row", F.col("s.stem").alias("s")))
    a, b = cols
    s = F.coalesce("s", F.array().cast("array<string>"))
    return (t.join(back, "_row", "left")
            .select(*(c for c in t.columns if c not in (*cols, "_row")), F.slice(s, 1, F.size(a)).alias(a),
                    F.slice(s, F.size(a) + 1, F.size(b)).alias(b)))


def _scored(pairs: DataFrame, pred: str, ref: str, keep: list, use_stemmer: bool) -> DataFrame:
    """``keep`` columns with the ROUGE tokens ``_pt`` and ``_rt`` of every pair."""
    t = pairs.select(*keep, rouge_tokens(F.col(pred)).alias("_pt"), rouge_tokens(F.col(ref)).alias("_rt"))
    return stemmed(t) if use_stemmer else t


def rouge_per_doc(pairs: DataFrame, pred: str = "pred", ref: str = "ref",
                  keep: list[str] | None = None, use_stemmer: bool = True) -> DataFrame:
    keep = keep or []
    t = _scored(pairs, pred, ref, keep, use_stemmer)
    return t.select(*keep, rouge1(F.col("_pt"), F.col("_rt")).alias("rouge1"),
                    rougeL(F.col("_pt"), F.col("_rt")).alias("rougeL"))


def rouge_scores(pairs: DataFrame, pred: str = "pred", ref: str = "ref",
                 by: list[str] | None = None, use_stemmer: bool = True) -> DataFrame:
    """AGG4 ``rouge_scores``: corpus means and their average; count = max(1, n).
    Tokens are stemmed (AGG5) unless ``use_stemmer`` is off."""
    by = by or []
    per = rouge_per_doc(pairs, pred, ref, by, use_stemmer)
    agg = per.groupBy(*by).agg(F.sum("rouge1").alias("s1"), F.sum("rougeL").alias("sl"),
                               F.count(F.lit(1)).alias("n"))
    n = F.greatest(F.col("n"), F.lit(1))
    return agg.select(*by, (F.col("s1") / n).alias("rouge1"), (F.col("sl") / n).alias("rougeL"),
                      ((F.col("s1") + F.col("sl")) / (2 * n)).alias("rouge_avg"),
                      n.alias("count"))


def evaluation_report(pairs: DataFrame, pred: str = "pred", ref: str = "ref",
                      by: list[str] | None = None, use_stemmer: bool = True) -> DataFrame:
    """AGG7 / AGG6: ROUGE means (of stems unless ``use_stemmer`` is off) plus
    micro set-F1 in one pass over the pairs (one aggregate, grouped by ``by``).
    ``pairs`` may have what ``with_reference`` makes."""
    by = by or []
    # Every list is folded and cut into tokens once; the counts read the results.
    t = pairs if "_rt" in pairs.columns else with_reference(pairs, ref)
    t = t.select(*by, "_rs", "_rt", folded_set(pred).alias("_ps"), rouge_tokens(F.col(pred)).alias("_pt"))
    t = t.select(*by, "_pt", "_rt", F.size(F.array_intersect("_ps", "_rs")).cast("bigint").alias("tp"), F.size("_ps").alias("_p"), F.size("_rs").alias("_r"))
    t = t.select(*by, "_pt", "_rt", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_r") - F.col("tp")).alias("fn"))
    t = stemmed(t) if use_stemmer else t
    t = t.select(*by, "tp", "fp", "fn", rouge1(F.col("_pt"), F.col("_rt")).alias("r1"),
                 rougeL(F.col("_pt"), F.col("_rt")).alias("rl"))
    agg = t.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                             F.sum("fn").alias("fn"), F.sum("r1").alias("s1"),
                             F.sum("rl").alias("sl"), F.count(F.lit(1)).alias("n"))
    n = F.greatest(F.col("n"), F.lit(1))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*by, (F.col("s1") / n).alias("rouge1"), (F.col("sl") / n).alias("rougeL"),
                      ((F.col("s1") + F.col("sl")) / (2 * n)).alias("rouge_avg"),
                      p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("count"))


def split_sizes(df: DataFrame, col: str = "split") -> DataFrame:
    """AGG8: rows per split / dataset."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def generated_length(ids: str, pad_id: int = 0) -> Column:
    """AGG9 ``gen_len`` term: non-pad ids of one row."""
    return F.size(F.filter(F.col(ids), lambda x: x != pad_id))


def supervised_tokens(labels: str) -> Column:
    """AGG10: label positions that carry loss (!= -100)."""
    return F.size(F.filter(F.col(labels), lambda x: x != -100))
