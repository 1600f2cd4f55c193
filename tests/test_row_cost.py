"""What a row costs: lists and texts are counted in batches, not by lambdas or rows per token."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyforge.functions.text import fold
from keyforge.operators import batches as B
from keyforge.operators import keybert as KB
from keyforge.operators import metrics as M
from keyforge.operators import ranker as RK
from keyforge.operators import textrank as TR
from keyforge.operators import tokens as TK
from keyforge.operators import yake as Y
from keyforge.sources import fixtures as FX
from tests.conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_tries_no_large_class(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁn", "ᾳ", "Été", "plain", None, "ſo", "ᲀ"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold("w").alias("f"))
    assert all(r["f"] == (r["w"].casefold() if r["w"] is not None else None) for r in rows(df))
    assert max(len(x.split("]")[0]) for x in df._jdf.queryExecution().optimizedPlan().toString().split("RLIKE [")[1:] or [""]) < 100


def test_rouge_counts_as_the_table_does(spark):
    rnd = random.Random(5)
    pairs = [([rnd.choice("abcde") for _ in range(rnd.randrange(90))], [rnd.choice("abcdef") for _ in range(rnd.randrange(90))]) for _ in range(30)] + [([], []), (None, ["a"])]
    df = spark.createDataFrame(pairs, "p array<string>, r array<string>").select("p", "r", M.lcs_length(F.col("p"), F.col("r")).alias("lcs"), M.rouge1(F.col("p"), F.col("r")).alias("r1"))
    assert "lambdafunction" not in plan(df)
    for x in rows(df):
        p, r = x["p"] or [], x["r"]
        t = [0] * (len(r) + 1)
        for a in p:
            t = [0, *_row(t, a, r)]
        assert x["p"] is None and x["lcs"] is None or x["lcs"] == t[-1]
        hits = sum(min(p.count(a), r.count(a)) for a in set(p))
        assert abs(x["r1"] - (2 * hits / (len(p) + len(r)) if hits else 0.0)) < 1e-12


def _row(old, a, r):
    left = 0
    for j, b in enumerate(r):
        left = old[j] + 1 if a == b else max(old[j + 1], left)
        yield left


def test_top_tokens_make_no_row_per_token(spark):
    docs = spark.createDataFrame([(1, "Beta beta gamma alpha"), (2, None), (3, "a bc"), (4, "zeta zeta zeta alpha"), (4, "alpha alpha beta"), (None, "gamma")], "doc_id long, text string")
    top = FX.top_tokens(docs, 2)
    assert {r["doc_id"]: r["toks"] for r in rows(top)} == {1: ["beta", "alpha"], 4: ["alpha", "zeta"], None: ["gamma"]}
    assert {r["doc_id"]: r["toks"] for r in rows(FX.top_tokens(docs, 2, first_half=True))} == {1: ["beta"], 4: ["zeta", "alpha"]}
    assert "Generate" not in plan(top)
    gold = {r["doc_id"]: r["ref"] for r in rows(FX.weighted_gold(docs.where("doc_id is not null"), 2))}
    assert gold == {1: ["beta", "gamma"], 4: ["zeta", "alpha"]}


TEXTS = [(1, "The quick brown fox jumps over the lazy dog. The quick Fox saw NASA 2 times; the quick fox ran (fast).\nFox and state of the art: state of art!"),
         (2, "Ärger über Österreich und die Straße. Die Straße über Österreich, 3D und ²x ΣΑΣ."), (3, "the of and"), (4, ""), (5, None),
         (6, "data " * 9 + "data mining tools. Data mining, data mining tools"), (7, "Graph theory twice"), (7, "Graph theory twice"), (None, "null ids here"), (8, "x")]


def test_ranker_features_need_no_token_rows(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3, "doc_id")
    cfg, ycfg = RK.RankerConfig(), Y.YakeConfig()
    blocks = TK.block_table(docs).where(F.size("toks") > 0)
    toks = TK.token_table_from_blocks(blocks, ycfg.reach)
    score = {(r["doc_id"], r["phrase"]): r["score"] for r in rows(Y.candidates(toks, *Y.term_scores(toks, ycfg), ycfg))}
    nodes = rows(TR.pagerank(TR.graph(blocks, TR.TextRankConfig()), TR.TextRankConfig()))
    size = Counter(r["doc_id"] for r in nodes)
    rank = {(r["doc_id"], r["term"]): r["rank"] * size[r["doc_id"]] for r in nodes}

    def no(*_):
        raise AssertionError("a row per token")
    monkeypatch.setattr(Y, "term_scores", no)
    feats = rows(RK.candidate_features(docs, cfg))
    by = {(r["doc_id"], r["phrase"]): r for r in feats}
    assert len(by) == len(feats) == 65
    assert (by[6, "data mining"]["tf"], by[7, "graph theory"]["tf"], by[1, "fox"]["cap_share"], by[1, "times"]["cap_share"]) == (3, 2, 0.5, 0.0)
    for (d, p), r in by.items():
        s, words = score.get((d, p), 0), p.split(" ")
        assert abs(r["yake"] - (-math.log(s) if s > 0 else 0.0)) < 1e-9
        assert abs(r["textrank"] - (0.0 if d is None else sum(rank.get((d, w), 0.0) for w in words) / len(words))) < 1e-9


def test_word_vectors_stay_in_their_batch(spark, monkeypatch):
    """A null text has no words; the head of the vocabulary and the rest give the same candidates; no row per dimension."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    kind = {"min_count": 1, "vector_size": 8, "partitions": 1}
    found = {(r["doc_id"], r["phrase"]): r for r in rows(KB.word2vec_candidates(docs, **kind))}
    monkeypatch.setattr(KB, "HEAD", 3)
    cands = KB.word2vec_candidates(docs, **kind)
    again = {(r["doc_id"], r["phrase"]): r for r in rows(cands)}
    assert found == again and "posexplode" not in plan(cands) and {d for d, _ in found} == {1, 2, 6, 7}
    assert all(len(r["vec"]) == 8 and abs(r["norm"] - math.hypot(*r["vec"])) < 1e-9 for r in found.values())
    want = rows(KB.mmr_select(cands, 5, 0.6, ["vec", "norm"], KB.dense_pair_sim, sim_floor=-1.0))
    got = rows(KB.word2vec_mmr(docs, k=5, d=0.6, **kind))
    shown = lambda x: sorted((r["doc_id"], r["rank"], r["phrase"], round(r["score"], 9)) for r in x)
    assert shown(got) == shown(want) and {r["doc_id"] for r in got} == {1, 2, 6, 7}


def test_empty_lists_without_offsets():
    """The JVM may send an empty list column whose offsets hold anything."""
    lists = pa.Array.from_buffers(pa.list_(pa.int64()), 0, [None, pa.py_buffer(np.array([-7], dtype=np.int32))], children=[pa.array([], pa.int64())])
    offsets, values = B.parts(lists)
    assert offsets.tolist() == [0] and len(values) == 0


def test_plain_keywords_take_one_look(spark):
    """The short way of KWD4 and the long one give the same for every text."""
    from keyforge.functions import text as TX
    odd = ["graph", "graph theory", " graph", "graph  theory", "graph\ttheory", "graph\n", "graph theory\n", "(graph)", "-graph", "graph-theory", "été straße", "a b", "", " ", None, "'", "3d", "x;", "a,b", "graph "]
    words = ["graph", "Été", " ", "  ", "-", "(", "3", "\n", " ", ";", "'"]
    rnd = random.Random(3)
    odd += ["".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    long = TX.strip(F.regexp_replace(TX.strip(F.regexp_replace("w", f"[{TX.WS}]+", " ")), f"^[{TX.KW_EDGE}]+|[{TX.KW_EDGE}]+$", ""))
    got = rows(spark.createDataFrame([(w,) for w in odd], "w string").select("w", TX.clean_kw("w").alias("a"), long.alias("b"), F.col("w").rlike(TX.PLAIN).alias("plain")))
    assert all(r["a"] == r["b"] for r in got) and any(r["plain"] for r in got) and any(r["plain"] is False for r in got)


def test_a_gold_list_is_folded_once(spark):
    """The counts of the report read lists that are made once; the ones of prepared references are the same."""
    df = spark.createDataFrame([("a", ["Graph", "graph", "tree x", None], ["GRAPH", "yak"]), ("a", None, ["x"]), ("b", [], []), ("b", ["yak"], None), (None, ["é"], ["É"])], "m string, pred array<string>, ref array<string>")
    rep = M.evaluation_report(df, by=["m"], use_stemmer=False)
    assert plan(rep).count("array_distinct(") <= 2
    shown = lambda d: sorted(map(str, rows(d)))
    assert shown(rep) == shown(M.evaluation_report(M.with_reference(df), by=["m"], use_stemmer=False))
    f1 = {r["m"]: (r["precision"], r["recall"], r["f1"]) for r in rows(M.f1_keywords(df, by=["m"]))}
    assert f1 == {r["m"]: (r["precision"], r["recall"], r["f1"]) for r in rows(rep)} and f1[None] == (1.0, 1.0, 1.0)
