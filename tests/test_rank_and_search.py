"""Rank index, vocabulary, MaxSum, PageRank, stemming, folding, manifest, failure isolation."""
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyforge.functions import porter
from keyforge.functions.text import fold
from keyforge.operators import encode as EN
from keyforge.operators import maxsum as MS
from keyforge.operators import metrics as M
from keyforge.operators import splits as S
from keyforge.operators import stages as ST
from keyforge.operators import textrank as TR
from keyforge.operators import yake as Y
from keyforge.session import cut_lineage
from keyforge.sources import ingest as IG
from tests.conftest import SF, rows
from tests.test_ingest_stream import make_pairs


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- rank index ----

def test_rank_index_is_written_and_survives_a_lost_cache(spark):
    df = spark.range(997).select(F.col("id").alias("doc_id"), F.repeat(F.lit("wide"), 50).alias("body"))
    a, n = S.seeded_rank(df)
    first = {r["doc_id"]: r["rn"] for r in rows(a)}
    spark.catalog.clearCache()
    assert n == 997 and {r["doc_id"]: r["rn"] for r in rows(a)} == first
    assert sorted(first.values()) == list(range(1, 998))
    keys = {r["doc_id"]: r["h"] for r in rows(df.select("doc_id", S.shuffle_key().alias("h")))}
    assert sorted(first, key=first.get) == sorted(keys, key=lambda i: (keys[i], i))
    assert "rangepartitioning" not in plan(a)  # no wide column is sorted: the plan reads the written index


def test_rank_of_null_ids_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "doc_id long, body string")
    a, n = S.seeded_rank(df)
    assert n == 3 and sorted(r["rn"] for r in rows(a)) == [1, 2, 3]
    a, n = S.seeded_rank(df.limit(0))
    assert n == 0 and a.count() == 0


# ---- vocabulary ----

def test_every_corpus_word_has_an_id_whatever_the_head(spark):
    d = docs(spark)
    vocab = EN.build_vocab(d)
    ids = {r["term"]: r["id"] for r in rows(vocab)}
    assert sorted(ids.values()) == list(range(3, 3 + len(ids)))
    want = {r["doc_id"]: [ids[w] for w in r["w"]] for r in rows(d.select("doc_id", EN.word_tokens("text").alias("w"))) if r["w"] is not None}
    for head in (1, 50, 10 ** 6):
        got = {r["doc_id"]: r["ids"] for r in rows(EN.encode(d, "text", vocab, head=head))}
        assert {k: v for k, v in got.items() if k in want} == want
    odd = spark.createDataFrame([(1, "zzqqxx the zzqqxx"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in rows(EN.encode(odd, "text", vocab, max_len=2))}
    assert got == {1: [EN.UNK, ids.get("the", EN.UNK)], 2: [], 3: []}


# ---- MaxSum ----

def test_least_similar_against_enumeration():
    rng = np.random.default_rng(1)
    for t in range(300):
        n = int(rng.integers(1, 10))
        k = int(rng.integers(1, n + 1))
        m = np.triu(rng.integers(-3 if t % 2 else 0, 5, (n, n)), 1)
        m = m + m.T
        best = min((sum(m[a, b] for a, b in itertools.combinations(c, 2)), c) for c in itertools.combinations(range(n), k))
        assert tuple(MS.least_similar(m, k)) == best[1]
    assert MS.least_similar(np.zeros((3, 3), dtype=np.int64), 4) == []


def test_least_similar_where_subsets_cannot_be_listed():
    rng = np.random.default_rng(2)
    m = np.triu(rng.integers(0, 10 ** 12, (30, 30)), 1)
    m = m + m.T
    picked = MS.least_similar(m, 10)
    cost = lambda c: sum(int(m[a, b]) for a, b in itertools.combinations(c, 2))
    assert len(set(picked)) == 10 and picked == sorted(picked)
    swaps = [sorted({*picked} - {a} | {b}) for a in picked for b in range(30) if b not in picked]
    assert cost(picked) <= min(map(cost, swaps)) and cost(picked) <= min(cost(rng.choice(30, 10, replace=False)) for _ in range(2000))
    assert MS.least_similar(m[:20, :20], 20) == list(range(20))


# ---- PageRank ----

def plain_rank(edges, d, rounds):
    nodes = sorted({a for a, _, _ in edges})
    out = {a: sum(w for x, _, w in edges if x == a) for a in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        r = {v: (1 - d) / len(nodes) + d * sum(r[a] * w / out[a] for a, b, w in edges if b == v) for v in nodes}
    return r


def test_pagerank_in_the_row(spark):
    rnd = random.Random(3)
    data, want = [], {}
    for doc in range(8):
        pairs = {tuple(sorted(rnd.sample("abcdefghij", 2))): rnd.randint(1, 5) for _ in range(rnd.randint(1, 15))}
        edges = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
        data += [(doc, *e) for e in edges]
        want |= {(doc, v): r for v, r in plain_rank(edges, 0.85, 10).items()}
    df = spark.createDataFrame(data, "doc_id long, src string, dst string, w long").repartition("doc_id")
    got = TR.pagerank(df, TR.TextRankConfig())
    assert {(r["doc_id"], r["term"]): r["rank"] for r in rows(got)} == pytest.approx(want, abs=1e-12)
    assert plan(got).count("Exchange") <= 1 + plan(df).count("Exchange")
    assert rows(TR.pagerank(df.limit(0), TR.TextRankConfig())) == []


# ---- YAKE settings ----

def test_yake_settings(spark):
    for bad in ({"language": "xx"}, {"features": ("WRel",)}, {"features": ("Nope", "WFreq")}, {"window_size": 0}, {"max_ngram_size": 0}):
        with pytest.raises(ValueError):
            Y.YakeConfig(**bad)
    assert Y.YakeConfig(language="xx", stopwords=("a",)).reach == 2
    d = spark.createDataFrame([(1, "die Katze und der Hund sehen die Katze", "de"), (2, "die Katze und der Hund sehen die Katze", "en")],
                              "doc_id long, text string, lang string")
    kw = {r["doc_id"]: r["keywords"] for r in rows(Y.extract(d, Y.YakeConfig(language_col="lang")))}
    assert not any(w.split()[0] in ("die", "der", "und") or w.split()[-1] in ("die", "der", "und") for w in kw[1])
    assert any(w.startswith("die") for w in kw[2])
    edges = {w: rows(Y.term_scores(Y.token_table(d, 3, ()), Y.YakeConfig(window_size=w))[1].where("doc_id = 1 and a = 'hund'")) for w in (1, 2)}
    assert {r["b"] for r in edges[1]} == {"sehen"} and {r["b"] for r in edges[2]} == {"sehen", "die"}


# ---- stemming ----

def test_stem_table_is_the_letterwise_algorithm(spark):
    rnd = random.Random(4)
    ends = ["ational", "ing", "ed", "eed", "ies", "sses", "s", "y", "ization", "fulness", "icate", "ement", "ion", "sion", "e", "ll", "izer", "bled", "tted", "ive", ""]
    words = {"".join(rnd.choice("abcdefghilmnoprstuvwy1") for _ in range(rnd.randint(1, 7))) + rnd.choice(ends) for _ in range(4000)}
    words |= {"yes", "sky", "happy", "yyy", "ayy", "hopping", "falling", "hissing", "controll", "rate", "cease", "toy", "syzygy", "agreed", "feed", "plastered", "bled"}
    words.discard("")
    df = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    got = {r["token"]: r["stem"] for r in rows(porter.stem_table(df))}
    assert got == {w: porter.stem_token(w) for w in words}


def test_stemmed_scores_of_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, ["running dogs"], ["runs dog"]), (1, ["running dogs"], ["runs dog"]), (2, [], ["x"]), (3, None, None)],
                               "doc_id long, pred array<string>, ref array<string>")
    got = sorted((r["doc_id"], round(r["rouge1"], 6)) for r in rows(M.rouge_per_doc(df, keep=["doc_id"])))
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert M.rouge_scores(df.limit(0)).first()["count"] == 1


# ---- folding ----

def test_full_case_folding(spark):
    words = ["Straße", "STRASSE", "ﬁne", "ΟΔΟΣ", "οδος", "ᾳ", "ŉ", "µ", "ſ", "Ａ", "ǰ", "plain", "", "ﬃ ß ς", "İ", "ẞ", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["f"] for r in rows(df.select(fold("w").alias("f")))] == [None if w is None else w.casefold() for w in words]


# ---- manifest ----

def test_ingest_opens_only_chosen_files(spark, tmp_path):
    root = str(tmp_path)
    make_pairs(root)
    names = {"inspec": "Inspec", "www": "www"}
    got = rows(IG.ingest(spark, root, names, max_per_dataset=2).orderBy("dataset", "rn"))
    assert [(r["dataset"], r["txt_name"], r["key_name"]) for r in got] == [("inspec", "a1", "a1"), ("inspec", "a2", "a2"), ("www", "b1", "b1"), ("www", "b2", "sub/b3")]
    assert got[0]["text"] == "text of a1" and got[3]["key"] == "k1 sub/b3\nk2"
    # a file beyond the cap is not opened: one that cannot be read does no harm
    os.remove(os.path.join(root, "Inspec", "docsutf8", "a3.txt"))
    os.symlink("/nonexistent", os.path.join(root, "Inspec", "docsutf8", "zz.md"))
    assert IG.ingest(spark, root, {"inspec": "Inspec"}, max_per_dataset=1).count() == 1
    assert IG.ingest(spark, root, {"none": "None"}).count() == 0
    listed = IG.list_files(spark, root, "docsutf8", "txt")
    assert "content" not in plan(listed).split("ReadSchema")[-1]
    parts = [IG.ingest(spark, root, {n: f}) for n, f in names.items()]
    assert IG.concatenated(*parts).columns == ["text", "key", "dataset"] and IG.concatenated(*parts).count() == sum(p.count() for p in parts)


# ---- failure isolation ----

def small(spark):
    return spark.createDataFrame([(i, f"Alpha beta gamma delta number{i}. Beta gamma epsilon zeta eta.") for i in range(30)], "doc_id long, text string")


def fails_for(bad):
    def extract(d):
        kw = F.when(F.col("doc_id").isin(bad), F.raise_error(F.lit("broken document")).cast("array<string>")).otherwise(F.array(F.lit("fine")))
        return cut_lineage(d.select("doc_id", kw.alias("keywords")))
    return extract


def test_a_failing_document_does_not_take_the_others_along(spark):
    s1 = {r["doc_id"]: r for r in rows(ST.stage_one(small(spark), extractors={"keybert": fails_for([7, 20])}))}
    assert len(s1) == 30
    for i, r in s1.items():
        assert r["yake"] and r["textrank"]
        assert r["keybert"] == ([] if i in (7, 20) else ["fine"])
        assert ("broken document" in r["error"] and r["error"].startswith("keybert:")) if i in (7, 20) else r["error"] is None


def test_an_extractor_that_always_fails_gives_empty_lists(spark):
    def broken(d):
        raise RuntimeError("no model")

    s1 = rows(ST.stage_one(small(spark), extractors={"textrank": broken}))
    assert len(s1) == 30 and all(r["textrank"] == [] and r["yake"] and r["keybert"] and "RuntimeError: no model" in r["error"] for r in s1)
    assert all(r["combined"] for r in s1)
