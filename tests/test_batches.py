"""Whole-document passes against the relational operators they stand for."""
import pytest
from pyspark.sql import functions as F

from keyforge.operators import encode as EN
from keyforge.operators import keybert as KB
from keyforge.operators import textrank as TR
from keyforge.operators import tokens as TK
from keyforge.operators import yake as Y
from tests.conftest import rows

TEXTS = [(1, "The quick brown fox jumps over the lazy dog. The quick Fox saw NASA 2 times; the quick fox ran (fast).\nFox and state of the art: state of art!", "en"),
         (2, "Ärger über Österreich und die Straße. Die Straße über Österreich, 3D und ²x ΣΑΣ.", "de"),
         (3, "the of and", "en"), (4, "", "en"), (5, None, None), (6, "data " * 40 + "data mining tools. Data mining, data mining tools", "en"),
         (7, "Graph theory twice. Graph theory of twice", "fr"), (7, "Graph theory twice. Graph theory of twice", "fr"), (None, "null ids meet nothing here", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string").repartition(3, "doc_id")


def _same(a, b, cols, digits=9):
    def plain(df):
        return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows(df.select(*cols))), key=repr)
    assert plain(a) == plain(b)


@pytest.mark.parametrize("cfg", [Y.YakeConfig(), Y.YakeConfig(max_ngram_size=4, window_size=3), Y.YakeConfig(language_col="lang", window_size=2),
                                 Y.YakeConfig(features=("WFreq", "WSpread", "WPos"), max_ngram_size=1)])
def test_yake_of_whole_documents(spark, odd, cfg):
    toks = TK.token_table(odd, cfg.reach, cfg.keep)
    terms, edges = Y.term_scores(toks, cfg)
    mine = Y.document_terms(odd, cfg)
    _same(terms, mine, ["doc_id", "term", "tf", "stop", "H"])
    _same(Y.term_statistics(toks, cfg), mine, ["doc_id", "term", "tf", "tf_a", "tf_n", "n_sent", "sf", "med", "wdl", "wil", "wdr", "wir", "stop"])
    _same(edges, Y.document_edges(odd, cfg), ["doc_id", "a", "b", "w"])
    lists = Y.candidate_lists(odd, cfg)
    _same(Y.candidates(toks, terms, edges, cfg), lists.select("doc_id", F.inline("c")), ["doc_id", "phrase", "score"])


def test_yake_walks_are_exact(spark, odd):
    got = [{(r["doc_id"], r["rank"], r["phrase"]) for r in rows(Y.ranked_keyphrases(odd, first=n))} for n in (2, 9, 64)]
    assert got[0] == got[1] == got[2] and got[0]


def test_textrank_of_whole_documents(spark, odd):
    cfg = TR.TextRankConfig(top_k=50)
    blocks = TK.block_table(odd).where(F.size("toks") > 0)
    toks = TK.token_rows(odd)
    edges = TR.graph_of(toks, cfg)
    _same(TR.graph(blocks, cfg), edges, ["doc_id", "src", "dst", "w"])
    ranks = TR.ranks_of(toks, cfg)
    _same(TR.pagerank(edges, cfg), ranks, ["doc_id", "term", "rank"])
    runs = {(r["doc_id"], r["phrase"]): r["score"] for r in rows(TR.ranked_keyphrases(odd, cfg))}
    by = {(r["doc_id"], r["term"]): r["rank"] for r in rows(ranks) if r["doc_id"] is not None}
    assert (1, "quick brown fox jumps") in runs and (6, "data mining tools") in runs
    for (doc, phrase), score in runs.items():
        words = [by.get((doc, w), 0.0) for w in phrase.split(" ")]
        assert score == pytest.approx((sum(x * x for x in words) / len(words)) ** 0.5)


def _plain_tfidf(spark, docs, cfg):
    """Candidates, similarities and norms in plain Python."""
    import math
    import re
    texts = {r["doc_id"]: [w for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()) if len(w) >= 2 and w not in cfg.stopwords] for r in rows(docs)}
    df = {}
    for ws in texts.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for d, ws in texts.items():
        wd = {w: ws.count(w) * idf[w] for w in ws}
        dn = math.sqrt(sum(x * x for x in wd.values()))
        for i in range(len(ws)):
            for n in (1, 2, 3):
                if i + n <= len(ws):
                    g = ws[i:i + n]
                    cw = {w: g.count(w) * idf[w] for w in g}
                    norm = math.sqrt(sum(x * x for x in cw.values()))
                    out[d, " ".join(g)] = (sum(wd[w] * x for w, x in cw.items()) / dn / norm, norm)
    return out


def test_keybert_of_whole_documents(spark, odd):
    docs, cfg = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"), KB.KeyBertConfig()
    cands = KB.tfidf_candidates(docs, cfg)
    got = {(r["doc_id"], r["phrase"]): (r["sim"], r["norm"]) for r in rows(cands)}
    want = _plain_tfidf(spark, docs, cfg)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    key = lambda df: {(r["doc_id"], r["rank"], r["phrase"]) for r in rows(df)}
    assert key(KB.tfidf_mmr(docs, cfg)) == key(KB.mmr_select(cands, cfg.top_k, cfg.diversity, ["terms", "norm", "tn"], KB.term_pair_sim, tiers=(None,)).drop("score"))
    assert key(KB.maxsum_select(KB.tfidf_candidates(docs, cfg, 6), 3, 6)) == key(KB.maxsum_select(cands, 3, 6))


def test_encoder_joins_distinct_words(spark):
    d = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None), (4, "zz a a"), (None, "a"), (5, "a b"), (5, "a b")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "term string, id int")
    for head in (1, 4096):
        enc = EN.encode(d, "text", vocab, head=head)
        got = sorted(((r["doc_id"] or 0, r["ids"]) for r in rows(enc)))
        assert got == [(0, []), (1, [4, 3, 4, 5]), (2, []), (3, []), (4, [2, 3, 3]), (5, [3, 3, 4, 4]), (5, [3, 3, 4, 4])]
        assert "array_distinct" in enc._jdf.queryExecution().optimizedPlan().toString()
