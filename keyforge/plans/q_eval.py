"""Registered queries: evaluation (AGG*), prediction/reference join (JOIN3),
set operations (SET2) and the minimum end-to-end slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.operators import metrics as M
from keyforge.plans import oracle_ctes as O
from keyforge.plans.registry import r6, register
from keyforge.sources import fixtures as FX
from keyforge.sources.tables import documents, table


def _pairs(spark, sf, cols=("doc_id", "text", "source")):
    return FX.kw_pairs(documents(spark, sf, cols))


_TP, _FP, _FN = O.set_counts("pred", "ref")


@register("agg1_f1_keywords", "WITH " + O.kw_pairs_cte() + f""",
c AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn FROM kw_pairs),
s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c)
SELECT tp, fp, fn,
  round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN
     2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn)))
     ELSE 0.0 END, 6) AS f1
FROM s""")
def agg1_f1_keywords(spark, sf):
    r = M.f1_keywords(_pairs(spark, sf))
    return r.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"))


_PT = O.rouge_tokens("pred")
_RT = O.rouge_tokens("ref")


@register("agg2_agg3_rouge_per_doc", "WITH " + O.kw_pairs_cte() + f""",
t AS (SELECT doc_id, {_PT} AS pt, {_RT} AS rt FROM kw_pairs)
SELECT doc_id, round({O.rouge1('pt', 'rt')}, 6) AS rouge1, round({O.rougeL('pt', 'rt')}, 6) AS rougeL FROM t""")
def agg2_agg3_rouge_per_doc(spark, sf):
    r = M.rouge_per_doc(_pairs(spark, sf), keep=["doc_id"], use_stemmer=False)
    return r.select("doc_id", r6("rouge1").alias("rouge1"), r6("rougeL").alias("rougeL"))


@register("agg4_rouge_scores", "WITH " + O.kw_pairs_cte() + f""",
t AS (SELECT doc_id, {_PT} AS pt, {_RT} AS rt FROM kw_pairs),
s AS (SELECT {O.rouge1('pt', 'rt')} AS r1, {O.rougeL('pt', 'rt')} AS rl FROM t)
SELECT round(sum(r1) / greatest(count(*), 1), 6) AS rouge1, round(sum(rl) / greatest(count(*), 1), 6) AS rougeL,
       round((sum(r1) + sum(rl)) / (2 * greatest(count(*), 1)), 6) AS rouge_avg,
       greatest(count(*), 1)::BIGINT AS count
FROM s""")
def agg4_rouge_scores(spark, sf):
    r = M.rouge_scores(_pairs(spark, sf), use_stemmer=False)
    return r.select(r6("rouge1").alias("rouge1"), r6("rougeL").alias("rougeL"),
                    r6("rouge_avg").alias("rouge_avg"), F.col("count").cast("bigint").alias("count"))


@register("join3_set2_pred_ref", "WITH " + O.kw_pairs_cte() + f"""
SELECT p.doc_id, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn
FROM kw_pairs p JOIN labels l USING (doc_id)""")
def join3_set2_pred_ref(spark, sf):
    """JOIN3: predictions joined to references by id (inner, like ``zip``);
    SET2: per-row intersection / differences of the folded sets."""
    pairs = _pairs(spark, sf)
    labs = table(spark, sf, "labels").select("doc_id")
    tp, fp, fn = M.set_counts("pred", "ref")
    return pairs.join(labs, "doc_id").select("doc_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


@register("min_slice_by_lang", "WITH " + O.kw_pairs_cte() + """,
tok AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS t FROM documents),
tf AS (SELECT doc_id, lang, lower(t) AS term, count(*) AS tf FROM tok GROUP BY ALL),
top10 AS (SELECT doc_id, lang, list(term ORDER BY tf DESC, term) AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tf QUALIFY rn <= 10)
  GROUP BY doc_id, lang),
p AS (SELECT t.doc_id, t.lang, t.pred, g.ref FROM top10 t JOIN gold g USING (doc_id)),
c AS (SELECT lang, """ + O.set_counts("pred", "ref")[0] + " AS tp, " + O.set_counts("pred", "ref")[1]
          + " AS fp, " + O.set_counts("pred", "ref")[2] + f""" AS fn,
         {O.rouge1(_PT, _RT)} AS r1 FROM p),
s AS (SELECT lang, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, avg(r1) AS rouge1,
      count(*) AS n_docs FROM c GROUP BY lang)
SELECT lang, n_docs,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1,
  round(rouge1, 6) AS rouge1
FROM s""")
def min_slice_by_lang(spark, sf):
    """Minimum slice: top-10 terms by tf as the prediction, joined to the
    gold lists, micro P/R/F1 and mean ROUGE-1 per language."""
    from keyforge.operators.tokens import term_frequencies
    from keyforge.functions.text import to_keywords
    docs = documents(spark, sf, ("doc_id", "text", "source", "lang"))
    tf = term_frequencies(docs.select("doc_id", "text"))
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("term"))
    top = (tf.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10)
           .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rn", "term"))).alias("s"))
           .select("doc_id", F.col("s.term").alias("pred")))
    gold = FX.kw_raw(docs).select("doc_id", to_keywords(F.col("key")).alias("ref"))
    pairs = top.join(gold, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    tp, fp, fn = M.set_counts("pred", "ref")
    t = pairs.select("lang", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                     M.rouge1(M.rouge_tokens(F.col("pred")), M.rouge_tokens(F.col("ref"))).alias("r1"))
    s = t.groupBy("lang").agg(F.sum("tp").cast("double").alias("tp"), F.sum("fp").cast("double").alias("fp"),
                              F.sum("fn").cast("double").alias("fn"), F.avg("r1").alias("rouge1"),
                              F.count(F.lit(1)).alias("n_docs"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("lang", "n_docs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(f, 6).alias("f1"), r6("rouge1").alias("rouge1"))


@register("agg7_evaluation_report", "WITH " + O.kw_pairs_cte() + f""",
sc AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {O.rouge1(_PT, _RT)} AS r1, {O.rougeL(_PT, _RT)} AS rl FROM kw_pairs),
ag AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(r1) AS s1, sum(rl) AS sl, count(*) AS n FROM sc)
SELECT round(s1 / greatest(n, 1), 6) AS rouge1, round(sl / greatest(n, 1), 6) AS rougeL,
       round((s1 + sl) / (2 * greatest(n, 1)), 6) AS rouge_avg,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1,
       greatest(n, 1)::BIGINT AS count
FROM ag""")
def agg7_evaluation_report(spark, sf):
    """AGG7: ROUGE means and micro set-F1 of one prediction table, one row."""
    r = M.evaluation_report(_pairs(spark, sf), use_stemmer=False)
    return r.select(*[r6(c).alias(c) for c in ("rouge1", "rougeL", "rouge_avg", "precision", "recall", "f1")],
                    F.col("count").cast("bigint").alias("count"))


STEMMED_SQL = "WITH " + O.kw_pairs_cte() + f""",
tk AS (SELECT doc_id, pred, ref, {_PT} AS pt, {_RT} AS rt FROM kw_pairs),""" + O.stemmed_tokens("tk")


@register("agg5_rouge_stemmed_per_doc", STEMMED_SQL + f"""
SELECT doc_id, round({O.rouge1('pt', 'rt')}, 6) AS rouge1, round({O.rougeL('pt', 'rt')}, 6) AS rougeL FROM stemmed""")
def agg5_rouge_stemmed_per_doc(spark, sf):
    """AGG5: ROUGE of stems, per document."""
    r = M.rouge_per_doc(_pairs(spark, sf), keep=["doc_id"])
    return r.select("doc_id", r6("rouge1").alias("rouge1"), r6("rougeL").alias("rougeL"))


@register("agg5_rouge_stemmed", STEMMED_SQL + f""",
s AS (SELECT {O.rouge1('pt', 'rt')} AS r1, {O.rougeL('pt', 'rt')} AS rl FROM stemmed)
SELECT round(sum(r1) / greatest(count(*), 1), 6) AS rouge1, round(sum(rl) / greatest(count(*), 1), 6) AS rougeL,
       round((sum(r1) + sum(rl)) / (2 * greatest(count(*), 1)), 6) AS rouge_avg, greatest(count(*), 1)::BIGINT AS count
FROM s""")
def agg5_rouge_stemmed(spark, sf):
    """AGG4 with the reference's default, stemming."""
    r = M.rouge_scores(_pairs(spark, sf))
    return r.select(r6("rouge1").alias("rouge1"), r6("rougeL").alias("rougeL"),
                    r6("rouge_avg").alias("rouge_avg"), F.col("count").cast("bigint").alias("count"))


@register("agg7_evaluation_report_stemmed", STEMMED_SQL + f""",
sc AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {O.rouge1('pt', 'rt')} AS r1, {O.rougeL('pt', 'rt')} AS rl FROM stemmed),
ag AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(r1) AS s1, sum(rl) AS sl, count(*) AS n FROM sc)
SELECT round(s1 / greatest(n, 1), 6) AS rouge1, round(sl / greatest(n, 1), 6) AS rougeL,
       round((s1 + sl) / (2 * greatest(n, 1)), 6) AS rouge_avg,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1,
       greatest(n, 1)::BIGINT AS count
FROM ag""")
def agg7_evaluation_report_stemmed(spark, sf):
    """AGG7 with the reference's default, stemming."""
    r = M.evaluation_report(_pairs(spark, sf))
    return r.select(*[r6(c).alias(c) for c in ("rouge1", "rougeL", "rouge_avg", "precision", "recall", "f1")],
                    F.col("count").cast("bigint").alias("count"))
