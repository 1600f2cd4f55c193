"""Registered queries: token table and the three extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.operators import tokens as TK
from keyforge.operators import yake as Y
from keyforge.plans import duck as D
from keyforge.plans.oracle_extract import tokens_cte, yake_cte
from keyforge.plans.registry import register, show_list
from keyforge.sources.tables import by_doc, documents


def docs_by_id(spark, sf):
    return by_doc(documents(spark, sf))


@register("tok1_token_table", "WITH " + tokens_cte() + """
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT sid) AS n_sent_with_tokens, max(n_sent) AS n_sent,
       count(DISTINCT lower(tok)) AS n_terms, count(nxt2) AS n_trigrams
FROM toks GROUP BY doc_id""")
def tok1_token_table(spark, sf):
    t = TK.token_table(docs_by_id(spark, sf))
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("sid").alias("n_sent_with_tokens"),
        F.max("n_sent").alias("n_sent"), F.countDistinct(F.lower("tok")).alias("n_terms"),
        F.count("nxt2").alias("n_trigrams"))


_YAKE_LISTS = f"""
SELECT d.doc_id, {D.show_list(D.postprocess('coalesce(k.kept, []::VARCHAR[])'))} AS keywords
FROM documents d LEFT JOIN yake_kept k USING (doc_id)"""


@register("yak1_yake_extract", "WITH " + tokens_cte() + "," + yake_cte() + _YAKE_LISTS)
def yak1_yake_extract(spark, sf):
    kw = Y.extract(docs_by_id(spark, sf))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("yak3_window_2", "WITH " + tokens_cte() + "," + yake_cte(window=2) + _YAKE_LISTS)
def yak3_window_2(spark, sf):
    """YAK1 / YAK3 with neighbours up to two tokens away."""
    kw = Y.extract(docs_by_id(spark, sf), Y.YakeConfig(window_size=2))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("yak1_four_languages", "WITH " + tokens_cte(keep="lang, ") + "," + yake_cte(lang=True) + _YAKE_LISTS)
def yak1_four_languages(spark, sf):
    """YAK1 with the stop words of each document's own language."""
    docs = by_doc(documents(spark, sf, ("doc_id", "text", "lang")))
    kw = Y.extract(docs, Y.YakeConfig(language_col="lang"))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("yak4_chosen_features", "WITH " + tokens_cte() + "," + yake_cte(features=("WFreq", "WSpread", "WPos")) + _YAKE_LISTS)
def yak4_chosen_features(spark, sf):
    """YAK1 / YAK4 with three of the five features."""
    kw = Y.extract(docs_by_id(spark, sf), Y.YakeConfig(features=("WFreq", "WSpread", "WPos")))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("yak5_four_word_phrases", "WITH " + tokens_cte(reach=3) + "," + yake_cte(n=4, window=3) + _YAKE_LISTS)
def yak5_four_word_phrases(spark, sf):
    """YAK5 with phrases of up to four words and a window of three."""
    kw = Y.extract(docs_by_id(spark, sf), Y.YakeConfig(max_ngram_size=4, window_size=3))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


# --- KeyBERT -----------------------------------------------------------------

from keyforge.operators import keybert as KB  # noqa: E402
from keyforge.plans import oracle_extract as OX  # noqa: E402

_KB_ARR = """kb_arr AS (SELECT doc_id, list({'name': phrase, 'sim': sim, 'terms': terms, 'norm': norm} ORDER BY phrase) AS c
          FROM kb_cand GROUP BY doc_id)"""


@register("key2_key4_tfidf_candidates", "WITH " + OX.kb_candidates_cte() + """
SELECT doc_id, count(*) AS n_cands, round(max(sim), 6) AS best_sim,
       round(sum(sim), 6) AS sum_sim, arg_max(phrase, sim * 1e12 - 0) AS dummy FROM kb_cand GROUP BY doc_id""".replace(
    ", arg_max(phrase, sim * 1e12 - 0) AS dummy", ""))
def key2_key4_tfidf_candidates(spark, sf):
    c = KB.tfidf_candidates(docs_by_id(spark, sf), KB.KeyBertConfig())
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cands"), F.round(F.max("sim"), 6).alias("best_sim"),
                                   F.round(F.sum("sim"), 6).alias("sum_sim"))


@register("key1_key5_keybert_mmr", "WITH " + OX.kb_candidates_cte() + "," + _KB_ARR + f""",
kb_pick AS (SELECT doc_id, {OX.mmr_sql('c', 20, 0.6, OX.term_pair_sim)} AS picks FROM kb_arr)
SELECT d.doc_id, {D.show_list(D.postprocess("list_transform(coalesce(p.picks, []), lambda pk: pk.name)"))} AS keywords
FROM documents d LEFT JOIN kb_pick p USING (doc_id)""")
def key1_key5_keybert_mmr(spark, sf):
    kw = KB.extract(docs_by_id(spark, sf))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("key3_corpus_min_df", "WITH " + OX.kb_candidates_cte() + """,
pdf AS (SELECT phrase, count(*) AS n FROM kb_cand GROUP BY phrase)
SELECT k.doc_id, count(*) AS n_kept FROM kb_cand k JOIN pdf USING (phrase) WHERE pdf.n >= 2 GROUP BY k.doc_id""")
def key3_corpus_min_df(spark, sf):
    cfg = KB.KeyBertConfig(min_df=2)
    c = KB.tfidf_candidates(docs_by_id(spark, sf), cfg)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@register("key4c_key5_embedding_mmr", f"""
WITH v AS (SELECT label, CAST(vec_id AS VARCHAR) AS name, list_transform(embedding, lambda ex: ex::DOUBLE) AS vec FROM embeddings),
vn AS (SELECT *, sqrt(list_reduce(list_transform(vec, lambda ey: ey * ey), lambda ea, eb: ea + eb, 0.0::DOUBLE)) AS norm FROM v),
dims AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM v) GROUP BY label, pos),
mean AS (SELECT label, list(m ORDER BY pos) AS mvec FROM dims GROUP BY label),
mn AS (SELECT *, sqrt(list_reduce(list_transform(mvec, lambda ez: ez * ez), lambda ec, ed: ec + ed, 0.0::DOUBLE)) AS mnorm FROM mean),
c AS (SELECT vn.label, vn.name, round(list_reduce(list_transform(range(1, len(vn.vec) + 1), lambda ei: vn.vec[ei] * mn.mvec[ei]),
             lambda ee, ef: ee + ef, 0.0::DOUBLE) / (vn.norm * mn.mnorm), 12) AS sim, vn.vec, vn.norm FROM vn JOIN mn USING (label)),
arr AS (SELECT label, list({{'name': name, 'sim': sim, 'vec': vec, 'norm': norm}} ORDER BY name) AS c FROM c GROUP BY label),
p AS (SELECT label, {OX.mmr_sql('c', 5, 0.6, OX.dense_pair_sim)} AS picks FROM arr)
SELECT label, (pk.i)::BIGINT AS rank, pk.p.name AS vec_id FROM (SELECT label, unnest(picks) AS p, unnest(range(1, len(picks) + 1)) AS i FROM p) pk""")
def key4c_key5_embedding_mmr(spark, sf):
    from keyforge.sources.tables import table
    r = KB.embedding_mmr(table(spark, sf, "embeddings"), k=5, d=0.6)
    return r.select("label", F.col("rank").cast("bigint").alias("rank"), F.col("name").alias("vec_id"))


# --- TextRank ----------------------------------------------------------------

from keyforge.operators import textrank as TR  # noqa: E402


@register("trk3_pagerank", "WITH " + tokens_cte() + "," + OX.textrank_cte() + """
SELECT doc_id, count(*) AS n_nodes, round(sum(r), 6) AS rank_sum, round(max(r), 6) AS max_rank
FROM tr_r10 GROUP BY doc_id""")
def trk3_pagerank(spark, sf):
    cfg = TR.TextRankConfig()
    r = TR.ranks_of(TK.token_rows(docs_by_id(spark, sf)), cfg)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.sum("rank"), 6).alias("rank_sum"),
                                   F.round(F.max("rank"), 6).alias("max_rank"))


@register("trk1_textrank_extract", "WITH " + tokens_cte() + "," + OX.textrank_cte() + f""",
tr_l AS (SELECT doc_id, list(phrase ORDER BY rank) AS kw FROM tr_top WHERE length(phrase) >= 2 GROUP BY doc_id)
SELECT d.doc_id, {D.show_list(D.postprocess('coalesce(l.kw, []::VARCHAR[])'))} AS keywords
FROM documents d LEFT JOIN tr_l l USING (doc_id)""")
def trk1_textrank_extract(spark, sf):
    kw = TR.extract(docs_by_id(spark, sf))
    return kw.select("doc_id", show_list("keywords").alias("keywords"))


@register("key4b_word2vec_mmr")
def key4b_word2vec_mmr(spark, sf):
    """KEY4(b) + KEY5: Word2Vec encoder, MMR with the dense similarity."""
    r = KB.word2vec_mmr(docs_by_id(spark, sf), k=10, d=0.6)
    return (r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("s"))
            .select("doc_id", show_list(F.col("s.phrase")).alias("keywords")))


_MS_TOP = """kb_top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, phrase) AS rk FROM kb_cand QUALIFY rk <= {n})"""


def _maxsum(spark, sf, top_n: int, nr: int):
    cfg = KB.KeyBertConfig(use_mmr=False, use_maxsum=True, top_k=top_n, nr_candidates=nr)
    r = KB.ranked_keyphrases(docs_by_id(spark, sf), cfg)
    return (r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("s"))
            .select("doc_id", show_list(F.col("s.phrase")).alias("keywords")))


_FIVE = ["c1", "c2", "c3", "c4", "c5"]


@register("key6_maxsum", "WITH " + OX.kb_candidates_cte() + "," + _MS_TOP.format(n=10) + f""",
kb_pair AS (SELECT a.doc_id, a.rk AS i, b.rk AS j, round({OX.term_pair_sim('a', 'b')} * 1000000000000)::BIGINT AS s
            FROM kb_top a JOIN kb_top b ON a.doc_id = b.doc_id AND a.rk < b.rk),
size AS (SELECT doc_id, max(rk) AS n FROM kb_top GROUP BY doc_id),
r AS (SELECT unnest(range(1, 11)) AS x),
combo AS (SELECT {', '.join(f'r{k}.x AS c{k}' for k in range(1, 6))} FROM r r1, r r2, r r3, r r4, r r5
          WHERE r1.x < r2.x AND r2.x < r3.x AND r3.x < r4.x AND r4.x < r5.x),
cost AS (SELECT p.doc_id, {', '.join(_FIVE)}, sum(s) AS cost FROM combo JOIN kb_pair p ON i IN ({', '.join(_FIVE)}) AND j IN ({', '.join(_FIVE)})
         JOIN size USING (doc_id) WHERE c5 <= n GROUP BY p.doc_id, {', '.join(_FIVE)}),
best AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost, {', '.join(_FIVE)}) = 1)
SELECT b.doc_id, string_agg(t.phrase, ' | ' ORDER BY t.rk) AS keywords
FROM best b JOIN kb_top t ON t.doc_id = b.doc_id AND t.rk IN ({', '.join(_FIVE)}) GROUP BY b.doc_id""")
def key6_maxsum(spark, sf):
    """KEY6: Max Sum Similarity, 5 of the 10 best candidates per document."""
    return _maxsum(spark, sf, 5, 10)


@register("key6_maxsum_default", "WITH " + OX.kb_candidates_cte() + "," + _MS_TOP.format(n=20) + """
SELECT doc_id, string_agg(phrase, ' | ' ORDER BY rk) AS keywords FROM kb_top GROUP BY doc_id HAVING count(*) = 20""")
def key6_maxsum_default(spark, sf):
    """KEY6 with the reference's defaults: 20 of the 20 best candidates."""
    return _maxsum(spark, sf, 20, 20)


@register("key6_maxsum_5_of_20")
def key6_maxsum_5_of_20(spark, sf):
    """KEY6, 5 of the 20 best (15,504 subsets per document); tests hold the search against enumeration."""
    return _maxsum(spark, sf, 5, 20)


@register("yak2_yak3_term_statistics", "WITH " + tokens_cte() + "," + yake_cte() + """
SELECT j.doc_id, count(*) AS n_terms, sum(j.tf)::BIGINT AS sum_tf, sum(j.sf)::BIGINT AS sum_sf,
       round(sum(j.med), 6) AS sum_median, sum(coalesce(j.wdl, 0))::BIGINT AS sum_wdl,
       sum(coalesce(j.wdr, 0))::BIGINT AS sum_wdr, sum(j.tf_a)::BIGINT AS sum_tf_a, sum(j.tf_n)::BIGINT AS sum_tf_n,
       count(*) FILTER (WHERE j.stop) AS n_stop
FROM y_j j GROUP BY j.doc_id""")
def yak2_yak3_term_statistics(spark, sf):
    """YAK2 / YAK3: per-term tf, case counts, sentence spread and median,
    distinct neighbours, summed per document."""
    cfg = Y.YakeConfig()
    stats = Y.document_terms(docs_by_id(spark, sf), cfg)
    return stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").cast("bigint").alias("sum_tf"),
        F.sum("sf").cast("bigint").alias("sum_sf"), F.round(F.sum("med"), 6).alias("sum_median"),
        F.sum(F.coalesce("wdl", F.lit(0))).cast("bigint").alias("sum_wdl"),
        F.sum(F.coalesce("wdr", F.lit(0))).cast("bigint").alias("sum_wdr"),
        F.sum("tf_a").cast("bigint").alias("sum_tf_a"), F.sum("tf_n").cast("bigint").alias("sum_tf_n"),
        F.count(F.when(F.col("stop"), 1)).alias("n_stop"))


@register("trk2_term_graph", "WITH " + tokens_cte() + "," + OX.textrank_cte() + """
SELECT doc_id, count(*) AS n_edges, sum(w)::BIGINT AS total_weight, count(DISTINCT src) AS n_nodes FROM tr_e GROUP BY doc_id""")
def trk2_term_graph(spark, sf):
    cfg = TR.TextRankConfig()
    g = TR.graph_of(TK.token_rows(docs_by_id(spark, sf)), cfg)
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").cast("bigint").alias("total_weight"),
                                   F.countDistinct("src").alias("n_nodes"))


# --- row level -----------------------------------------------------------------

@register("tok1_tokens", "WITH " + tokens_cte() + """
SELECT doc_id, n_sent::BIGINT AS n_sent, sid::BIGINT AS sid, bid::BIGINT AS bid, tid::BIGINT AS tid, tok, nxt1, nxt2 FROM toks""")
def tok1_tokens(spark, sf):
    """TOK1: every token with its place and its next two."""
    t = TK.token_table(docs_by_id(spark, sf))
    return t.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_sent", "sid", "bid", "tid")], "tok", "nxt1", "nxt2")


@register("yak4_term_scores", "WITH " + tokens_cte() + "," + yake_cte() + """
SELECT doc_id, term, tf::BIGINT AS tf, stop, round(H, 6) AS h FROM yake_terms""")
def yak4_term_scores(spark, sf):
    """YAK2-YAK4: every term of every document with its score."""
    terms = Y.document_terms(docs_by_id(spark, sf))
    return terms.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"), "stop", F.round("H", 6).alias("h"))


@register("yak3_neighbours", "WITH " + tokens_cte() + "," + yake_cte(window=2) + """
SELECT doc_id, a, b, w::BIGINT AS w FROM yake_edges""")
def yak3_neighbours(spark, sf):
    """YAK3: every pair of terms up to two tokens apart, with its count."""
    edges = Y.document_edges(docs_by_id(spark, sf), Y.YakeConfig(window_size=2))
    return edges.select("doc_id", "a", "b", F.col("w").cast("bigint").alias("w"))


@register("trk2_edges", "WITH " + tokens_cte() + "," + OX.textrank_cte() + """
SELECT doc_id, src, dst, w::BIGINT AS w FROM tr_e""")
def trk2_edges(spark, sf):
    """TRK2: every edge of every document's graph."""
    return TR.graph_of(TK.token_rows(docs_by_id(spark, sf)), TR.TextRankConfig()).select("doc_id", "src", "dst", F.col("w").cast("bigint").alias("w"))


@register("trk3_ranks", "WITH " + tokens_cte() + "," + OX.textrank_cte() + """
SELECT doc_id, term, round(r, 6) AS rank FROM tr_r10""")
def trk3_ranks(spark, sf):
    """TRK3: the rank of every node."""
    cfg = TR.TextRankConfig()
    return TR.ranks_of(TK.token_rows(docs_by_id(spark, sf)), cfg).select("doc_id", "term", F.round("rank", 6).alias("rank"))


@register("key2_candidates", "WITH " + OX.kb_candidates_cte() + """
SELECT doc_id, phrase, round(sim, 6) AS sim, round(norm, 6) AS norm, array_to_string(list_transform(terms, lambda kt: kt.term), ' ') AS terms FROM kb_cand""")
def key2_candidates(spark, sf):
    """KEY2-KEY4: every candidate with its similarity, norm and terms."""
    c = KB.tfidf_candidates(docs_by_id(spark, sf), KB.KeyBertConfig())
    return c.select("doc_id", "phrase", F.round("sim", 6).alias("sim"), F.round("norm", 6).alias("norm"), F.array_join("tn", " ").alias("terms"))
