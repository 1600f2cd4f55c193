"""Registered queries: answer parsing (PRS), prompts (PRM), chunking (CHK),
presence / verbatim tests (JOIN4, JOIN5), FLT3."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.functions import parse as P
from keyforge.functions import prompts as PR
from keyforge.functions import text as T
from keyforge.functions.text import WS
from keyforge.plans import duck as D
from keyforge.plans.oracle_ctes import gold_cte, kw_pairs_cte, responses_cte
from keyforge.plans.registry import register, show_list
from keyforge.sources import fixtures as FX
from keyforge.sources.tables import by_doc, documents


def _docs(spark, sf, cols=("doc_id", "text", "source")):
    return by_doc(documents(spark, sf, cols))


def _gold(spark, sf):
    raw = FX.kw_raw(_docs(spark, sf))
    return raw.select("doc_id", "text", T.to_keywords(F.col("key")).alias("ref"))


@register("prs1_clean_keyword", f"""
SELECT doc_id, line_no::BIGINT AS line_no, {D.clean_keyword('line')} AS kw
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)""")
def prs1_clean_keyword(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                        P.clean_keyword(F.col("line")).alias("kw"))


@register("prs2_parse_list_literal", "WITH " + responses_cte() + f"""
SELECT doc_id, {D.show_list(D.parse_list_literal('response'))} AS keywords FROM responses""")
def prs2_parse_list_literal(spark, sf):
    r = FX.responses(_docs(spark, sf))
    return r.select("doc_id", show_list(P.parse_list_literal(F.col("response"))).alias("keywords"))


@register("prs3_parse_keyword_lines", "WITH " + responses_cte() + f"""
SELECT doc_id, {D.show_list(D.parse_keyword_lines('response'))} AS keywords FROM responses""")
def prs3_parse_keyword_lines(spark, sf):
    r = FX.responses(_docs(spark, sf))
    return r.select("doc_id", show_list(P.parse_keyword_lines(F.col("response"))).alias("keywords"))


@register("prs4_parse_answer", "WITH " + responses_cte() + f""",
p AS (SELECT doc_id, {D.parse_answer('response')} AS kw FROM responses)
SELECT doc_id, {D.show_list('kw')} AS keywords, len(kw)::BIGINT AS n_kw FROM p""")
def prs4_parse_answer(spark, sf):
    r = FX.responses(_docs(spark, sf)).select("doc_id", P.parse_answer(F.col("response")).alias("kw"))
    return r.select("doc_id", show_list("kw").alias("keywords"), F.size("kw").cast("bigint").alias("n_kw"))


_SEQ_PREFIX = D.q(PR.SEQ2SEQ_PREFIX)


@register("prm1_seq2seq_pairs", "WITH " + gold_cte() + f"""
SELECT g.doc_id, {_SEQ_PREFIX} || {D.strip("coalesce(d.text, '')")} AS input_text,
       array_to_string(list_filter(list_transform(g.ref, lambda ra: {D.strip('ra')}), lambda rb: rb <> ''), '; ') AS target_text
FROM gold g JOIN documents d USING (doc_id)""")
def prm1_seq2seq_pairs(spark, sf):
    g = _gold(spark, sf)
    inp, tgt = PR.seq2seq_pair(F.col("text"), F.col("ref"))
    return g.select("doc_id", inp.alias("input_text"), tgt.alias("target_text"))


@register("prm2_flt3_chat_examples", "WITH " + gold_cte() + f"""
SELECT doc_id, {D.q(PR.SYSTEM_PREAMBLE + chr(10) + chr(10) + 'DOCUMENT:' + chr(10))} || {D.strip("coalesce(d.text, '')")}
         || chr(10) || chr(10) || {D.q(PR.RESPONSE_TAG)} AS text,
       array_to_string(g.ref, '; ') AS labels
FROM gold g JOIN documents d USING (doc_id)
WHERE {D.strip("array_to_string(g.ref, '; ')")} <> ''""")
def prm2_flt3_chat_examples(spark, sf):
    g = _gold(spark, sf)
    text, labels = PR.chat_example(F.col("text"), F.col("ref"))
    out = g.select("doc_id", text.alias("text"), labels.alias("labels"))
    return out.where(T.strip(F.col("labels")) != "")  # FLT3


@register("prm3_inference_input", f"""
SELECT doc_id, {_SEQ_PREFIX} || {D.strip("coalesce(text, '')")} || chr(10) || chr(10) AS input_text,
       {D.q(PR.NOTEBOOK_PREFIX)} || replace(text, chr(10), ' ') AS notebook_input
FROM documents""")
def prm3_inference_input(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", PR.inference_input(F.col("text")).alias("input_text"),
                    PR.notebook_input(F.col("text")).alias("notebook_input"))


def _cands_sql(arr: str) -> str:
    items = f"list_filter(list_transform(coalesce({arr}, []::VARCHAR[]), lambda ca: {D.strip('ca')}), lambda cb: cb IS NOT NULL AND cb <> '')"
    return (f"(CASE WHEN len({items}) = 0 THEN 'None supplied.' ELSE "
            f"array_to_string(list_transform({items}, lambda cc: '- ' || cc), chr(10)) END)")


_HEAD, _REST = PR.USER_PROMPT.split("{document}")
_MID, _TAIL = _REST.split("{candidates}")


@register("prm4_prm5_refine_prompt", "WITH " + gold_cte() + f"""
SELECT g.doc_id, {_cands_sql('g.ref')} AS candidates,
  {D.q(f"<|system|>{chr(10)}{PR.SYSTEM_PROMPT}{chr(10)}</|system|>{chr(10)}<|user|>{chr(10)}")}
    || {D.q(_HEAD)} || {D.strip("coalesce(d.text, '')")} || {D.q(_MID)} || {_cands_sql('g.ref')} || {D.q(_TAIL)}
    || {D.q(f"{chr(10)}</|user|>{chr(10)}<|assistant|>{chr(10)}")} AS prompt
FROM gold g JOIN documents d USING (doc_id)""")
def prm4_prm5_refine_prompt(spark, sf):
    g = _gold(spark, sf)
    return g.select("doc_id", PR.format_candidates(F.col("ref")).alias("candidates"),
                    PR.refine_prompt(F.col("text"), F.col("ref")).alias("prompt"))


@register("prm6_prm7_training_text", "WITH " + gold_cte() + f""",
ex AS (
  SELECT doc_id, {D.q(PR.SYSTEM_PREAMBLE + chr(10) + chr(10) + 'DOCUMENT:' + chr(10))} || {D.strip("coalesce(d.text, '')")}
           || chr(10) || chr(10) || {D.q(PR.RESPONSE_TAG)} AS p, array_to_string(g.ref, '; ') AS t
  FROM gold g JOIN documents d USING (doc_id))
SELECT doc_id,
  p || (CASE WHEN t <> '' AND NOT ends_with(p, ' ') THEN ' ' ELSE '' END) || t || '</s>' AS full_text,
  CASE WHEN ends_with({D.strip('p')}, {D.q(PR.RESPONSE_TAG)}) THEN p
       ELSE regexp_replace(p, {D.q(f'[{WS}]+$')}, '') || ' ' || {D.q(PR.RESPONSE_TAG)} END AS tagged,
  CASE WHEN ends_with({D.strip('t')}, {D.q(PR.RESPONSE_TAG)}) THEN t
       ELSE regexp_replace(t, {D.q(f'[{WS}]+$')}, '') || ' ' || {D.q(PR.RESPONSE_TAG)} END AS tagged_target
FROM ex""")
def prm6_prm7_training_text(spark, sf):
    g = _gold(spark, sf)
    p, t = PR.chat_example(F.col("text"), F.col("ref"))
    ex = g.select("doc_id", p.alias("p"), t.alias("t"))
    return ex.select("doc_id", PR.training_text(F.col("p"), F.col("t")).alias("full_text"),
                     PR.tagged_prompt(F.col("p")).alias("tagged"),
                     PR.tagged_prompt(F.col("t")).alias("tagged_target"))


_WORDS = f"list_filter(regexp_split_to_array(text, {D.q(f'[{WS}]+')}), lambda wa: wa <> '')"


@register("chk1_word_chunks", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range(len(words) // 100 + 1)) AS chunk_no FROM w)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, array_to_string(words[chunk_no * 100 + 1 : chunk_no * 100 + 100], ' ') AS chunk
FROM c""")
def chk1_word_chunks(spark, sf):
    from keyforge.operators.chunks import word_chunks
    return word_chunks(documents(spark, sf)).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


@register("chk2_chunk_first_sentences", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
c AS (SELECT doc_id, unnest(range(len(words) // 100 + 1)) AS chunk_no, words FROM w),
s AS (SELECT doc_id, chunk_no, coalesce(({D.sentences("array_to_string(words[chunk_no * 100 + 1 : chunk_no * 100 + 100], ' ')")})[1], '') AS first
      FROM c),
j AS (SELECT doc_id, string_agg(first, ';' ORDER BY chunk_no) AS joined FROM s GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(joined, ';'))), ' | ') AS keywords FROM j""")
def chk2_chunk_first_sentences(spark, sf):
    from keyforge.operators.chunks import chunk_first_sentences
    r = chunk_first_sentences(by_doc(documents(spark, sf)))
    return r.select("doc_id", show_list(F.array_sort("keywords")).alias("keywords"))


@register("join4_presence", "WITH " + kw_pairs_cte() + """,
pk AS (SELECT DISTINCT doc_id, unnest(pred) AS kw FROM kw_pairs),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word FROM documents),
flag AS (SELECT pk.doc_id, pk.kw, EXISTS (SELECT 1 FROM words w WHERE w.doc_id = pk.doc_id AND w.word = pk.kw) AS present FROM pk)
SELECT doc_id, count(*) AS n_pred, count(*) FILTER (WHERE present) AS n_present FROM flag GROUP BY doc_id""")
def join4_presence(spark, sf):
    from keyforge.operators.presence import presence
    docs = _docs(spark, sf)
    pairs = FX.kw_pairs(docs)
    flags = presence(pairs.select("doc_id", F.explode("pred").alias("kw")).distinct(), docs)
    return flags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred"),
                                       F.count(F.when(F.col("present"), 1)).alias("n_present"))


@register("join5_verbatim", "WITH " + gold_cte() + f""",
gk AS (SELECT g.doc_id, unnest(g.ref) AS kw FROM gold g)
SELECT gk.doc_id, count(*) AS n_kw,
       count(*) FILTER (WHERE contains({D.fold('d.text')}, {D.fold('gk.kw')})) AS n_verbatim
FROM gk JOIN documents d USING (doc_id) GROUP BY gk.doc_id""")
def join5_verbatim(spark, sf):
    from keyforge.operators.presence import verbatim
    g = _gold(spark, sf)
    v = verbatim(g.select("doc_id", F.explode("ref").alias("kw")), _docs(spark, sf))
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kw"),
                                   F.count(F.when(F.col("verbatim"), 1)).alias("n_verbatim"))
