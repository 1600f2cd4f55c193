"""Extractor invariants on the small test table."""
import pytest
from pyspark.sql import functions as F

from keyforge.operators import keybert as KB
from keyforge.operators import textrank as TR
from keyforge.operators import tokens as TK
from keyforge.operators import yake as Y
from keyforge.sources.tables import by_doc, documents
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def docs(spark):
    return by_doc(documents(spark, SF)).where(F.col("doc_id") < 40)


def test_pagerank_sums_to_one(spark, docs):
    cfg = TR.TextRankConfig()
    blocks = TK.block_table(docs).where(F.size("toks") > 0)
    r = TR.pagerank(TR.graph(blocks, cfg), cfg)
    for row in rows(r.groupBy("doc_id").agg(F.sum("rank").alias("s"))):
        assert row["s"] == pytest.approx(1.0, abs=1e-9)


def test_textrank_cut_before_length_filter(spark):
    cands = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "bc", 0.8), (1, 3, "de", 0.7), (1, 4, "fg", 0.6)],
                                  "doc_id long, rank int, phrase string, score double")
    top = cands.where(F.col("rank") <= 3).where(F.length("phrase") >= 2)
    assert top.count() == 2


def test_yake_lists_bounded_and_clean(spark, docs):
    kw = rows(Y.extract(docs))
    assert len(kw) == docs.count()
    for r in kw:
        assert len(r["keywords"]) <= 20
        assert len({k.lower() for k in r["keywords"]}) == len(r["keywords"])


def test_mmr_diversity_zero_is_cosine_order(spark, docs):
    cands = KB.tfidf_candidates(docs, KB.KeyBertConfig())
    mmr = KB.mmr_select(cands, 10, 0.0, ["terms", "norm", "tn"], KB.term_pair_sim)
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("doc_id").orderBy(
        F.col("sim").desc(), F.col("phrase"))
    plain = cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)
    a = {(r["doc_id"], r["rank"], r["phrase"]) for r in rows(mmr.select("doc_id", "rank", "phrase"))}
    b = {(r["doc_id"], r["rank"], r["phrase"]) for r in rows(plain.select("doc_id", "rank", "phrase"))}
    assert a == b


def test_mmr_tiers_are_exact(spark, docs):
    cands = KB.tfidf_candidates(docs, KB.KeyBertConfig())
    small = KB.mmr_select(cands, 20, 0.6, ["terms", "norm", "tn"], KB.term_pair_sim, tiers=(2, 8, None))
    rel = KB.mmr_select(cands, 20, 0.6, ["terms", "norm", "tn"], KB.term_pair_sim, tiers=(2, "relational"))
    full = KB.mmr_select(cands, 20, 0.6, ["terms", "norm", "tn"], KB.term_pair_sim, tiers=(None,))
    key = lambda df: {(r["doc_id"], r["rank"], r["phrase"]) for r in rows(df.select("doc_id", "rank", "phrase"))}
    assert key(small) == key(full)
    assert key(rel) == key(full)


def test_sentences_and_first_words(spark):
    from keyforge.operators import tokens as TK
    from keyforge.operators import yake as Y
    d = spark.createDataFrame([(1, "Hello world. Value 3.14 at example.com"), (2, '"Hello world. (Hello there.'), (3, ""), (4, None)], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_sent"] for r in TK.sentence_table(d).select("doc_id", "n_sent").distinct().collect()}
    assert n == {1: 2, 2: 2}
    s = Y.term_statistics(TK.token_table(d), Y.YakeConfig()).where("doc_id = 2 and term = 'hello'").first()
    assert (s["tf"], s["tf_n"]) == (2, 0)
    kept = {r["doc_id"]: r["keywords"] for r in Y.extract(d).collect()}
    assert kept[3] == [] and kept[4] == []


def test_maxsum_sizes(spark, docs):
    cands = KB.tfidf_candidates(docs, KB.KeyBertConfig())
    with pytest.raises(ValueError):
        KB.maxsum_select(cands, 6, 5)
    held = {r["doc_id"]: r["n"] for r in rows(cands.groupBy("doc_id").agg(F.count("*").alias("n")))}
    for n, nr in ((3, 6), (6, 20), (20, 20)):
        per = {r["doc_id"]: r["n"] for r in rows(KB.maxsum_select(cands, n, nr).groupBy("doc_id").agg(F.count("*").alias("n")))}
        assert per == {d: n for d, k in held.items() if k >= n}


def test_greedy_chunks_are_exact(spark, docs):
    from keyforge.operators.greedy import greedy_walk
    toks = TK.token_table(docs)
    terms, edges = Y.term_scores(toks, Y.YakeConfig())
    cand = Y.candidates(toks, terms, edges, Y.YakeConfig())
    order = [F.col("score"), F.col("phrase")]
    a = greedy_walk(cand, 20, Y._similar(0.9), ["phrase", "score"], order=order, chunks=(3, 7, None))
    b = greedy_walk(cand, 20, Y._similar(0.9), ["phrase", "score"], order=order, chunks=(None,))
    f = lambda df: {(r["doc_id"], tuple(x["phrase"] for x in r["kept"])) for r in rows(df)}
    assert f(a) == f(b)
