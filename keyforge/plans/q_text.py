"""Registered queries: sources, text / keyword normalisation, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.functions import text as T
from keyforge.plans import duck as D
from keyforge.plans.oracle_ctes import gold_cte, kw_raw_cte
from keyforge.plans.registry import register, show_list
from keyforge.sources import fixtures as FX
from keyforge.sources.tables import documents, table


@register("src1_documents_scan", """
SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, sum(length(text))::BIGINT AS text_len
FROM documents GROUP BY lang""")
def src1_documents_scan(spark, sf):
    return (table(spark, sf, "documents").groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("bigint").alias("chars"),
                 F.sum(F.length("text")).cast("bigint").alias("text_len")))


@register("kw_raw_fixture", "WITH " + kw_raw_cte() + """
SELECT doc_id, key, dataset FROM kw_raw""")
def kw_raw_fixture(spark, sf):
    docs = documents(spark, sf, ("doc_id", "text", "source"))
    return FX.kw_raw(docs).select("doc_id", "key", "dataset")


@register("txt1_clean_text", f"""
SELECT doc_id, {D.clean_text('text')} AS text_clean FROM documents""")
def txt1_clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("text_clean"))


@register("txt3_to_keywords", "WITH " + kw_raw_cte() + f"""
SELECT doc_id, {D.show_list(D.to_keywords('key'))} AS keywords, len({D.to_keywords('key')})::BIGINT AS n_kw
FROM kw_raw""")
def txt3_to_keywords(spark, sf):
    raw = FX.kw_raw(documents(spark, sf, ("doc_id", "text", "source")))
    kws = raw.select("doc_id", T.to_keywords(F.col("key")).alias("kw"))
    return kws.select("doc_id", show_list("kw").alias("keywords"), F.size("kw").cast("bigint").alias("n_kw"))


@register("src4_record_lookup", "WITH " + kw_raw_cte() + f"""
SELECT doc_id, text, {D.show_list(f"list_transform(string_split(key, chr(10)), lambda rk: {D.clean_text('rk')})")} AS key_lines
FROM kw_raw WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'de')""")
def src4_record_lookup(spark, sf):
    raw = FX.kw_raw(documents(spark, sf, ("doc_id", "text", "source", "lang")))
    target = (table(spark, sf, "documents").where(F.col("lang") == "de")
              .agg(F.min("doc_id").alias("t")))
    rec = raw.join(target, raw.doc_id == target.t, "left_semi")
    return rec.select("doc_id", "text",
                      show_list(F.transform(F.split("key", "\n", -1), T.clean_text)).alias("key_lines"))


@register("kwd2_normalize_kw_string", f"""
SELECT doc_id, {D.show_list(D.normalize_kw_string('text'))} AS keywords,
       len({D.normalize_kw_string('text')})::BIGINT AS n_kw
FROM documents""")
def kwd2_normalize_kw_string(spark, sf):
    t = documents(spark, sf).select("doc_id", T.normalize_kw_string(F.col("text")).alias("kw"))
    return t.select("doc_id", show_list("kw").alias("keywords"), F.size("kw").cast("bigint").alias("n_kw"))


@register("kwd3_to_keyword_list", f"""
SELECT c.conv_id, {D.show_list(D.dedup_ci("list(c.text ORDER BY c.turn)"))} AS keywords
FROM conversations c GROUP BY c.conv_id""")
def kwd3_to_keyword_list(spark, sf):
    conv = table(spark, sf, "conversations")
    lists = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    lists = lists.select("conv_id", F.col("s.text").alias("texts"))
    return lists.select("conv_id", show_list(T.to_keyword_list(F.col("texts"), "array<string>"))
                        .alias("keywords"))


@register("kwd4_clean_kw", f"""
SELECT doc_id, line_no::BIGINT AS line_no, {D.clean_kw('line')} AS kw
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""")
def kwd4_clean_kw(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                        T.clean_kw(F.col("line")).alias("kw"))


@register("kwd5_postprocess", f"""
SELECT doc_id,
  {D.show_list(D.postprocess("string_split(text, chr(10))", min_len=2, max_len=60))} AS kw_default,
  {D.show_list(D.postprocess("string_split(text, chr(10))", lowercase=True, min_len=3, max_len=None, dedupe=False, v="q"))} AS kw_lower
FROM documents""")
def kwd5_postprocess(spark, sf):
    lines = F.split(F.col("text"), "\n", -1)
    return documents(spark, sf).select(
        "doc_id",
        show_list(T.postprocess(lines, min_len=2, max_len=60)).alias("kw_default"),
        show_list(T.postprocess(lines, lowercase=True, min_len=3, dedupe=False)).alias("kw_lower"))


@register("kwd6_join_keywords", "WITH " + gold_cte() + f"""
SELECT doc_id, {D.join_keywords('ref')} AS joined FROM gold""")
def kwd6_join_keywords(spark, sf):
    raw = FX.kw_raw(documents(spark, sf, ("doc_id", "text", "source")))
    return raw.select("doc_id", T.join_keywords(T.to_keywords(F.col("key"))).alias("joined"))


@register("txt4_word_count", f"""
SELECT doc_id, {D.word_count('text')} AS word_count FROM documents""")
def txt4_word_count(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@register("txt5_flt2_short_docs", f"""
SELECT doc_id, coalesce(replace(replace(text, chr(10), ';'), chr(9), ' '), '') AS text_flat,
       {D.word_count('text')} AS word_count
FROM documents WHERE {D.word_count('text')} > 25""")
def txt5_flt2_short_docs(spark, sf):
    """TXT4 -> TXT5 -> FLT2: word count taken before the newline removal,
    documents with <= 25 words dropped."""
    d = documents(spark, sf).select("doc_id", "text", T.word_count(F.col("text")).alias("word_count"))
    return (d.where(F.col("word_count") > 25)
            .select("doc_id", T.remove_tabs(T.remove_newlines(F.col("text"))).alias("text_flat"),
                    "word_count"))


@register("txt6_keep_sentences", f"""
SELECT doc_id, {D.keep_punctuated_sentences('text')} AS text_sentences FROM documents""")
def txt6_keep_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", T.keep_punctuated_sentences(F.col("text"))
                                       .alias("text_sentences"))


@register("flt1_nonempty_keywords", "WITH " + gold_cte() + """
SELECT dataset, count(*) AS n_pairs FROM gold JOIN kw_raw USING (doc_id)
WHERE len(ref) > 0 GROUP BY dataset""")
def flt1_nonempty_keywords(spark, sf):
    raw = FX.kw_raw(documents(spark, sf, ("doc_id", "text", "source")))
    kws = raw.select("dataset", T.to_keywords(F.col("key")).alias("kw"))
    return (kws.where(F.size("kw") > 0).groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("n_pairs")))
