"""What travels between tasks: rare words only, no step computed twice."""
import math
from collections import Counter

import pytest

from keyforge.operators import encode as EN
from keyforge.operators import keybert as KB
from keyforge.operators import phrase_counts as PC
from keyforge.operators import ranker as RK
from keyforge.plans import q_model as QM
from tests.conftest import rows

TEXTS = [(1, "graph theory and graph search"), (2, "graph search of the tree"), (3, "tree graph zebra search"), (4, ""), (5, None), (6, "yak"),
         (7, "search tree"), (7, "graph yak yak theory"), (None, "graph")]


@pytest.fixture
def sent(spark, monkeypatch):
    """The tables whose rows go to Python."""
    got, frame = [], type(spark.range(0))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a: got.append(df) or real(df, *a))
    return got


def test_only_rare_words_meet_the_idf(spark, sent, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = []
    for most, met in ((0, {"graph", "search", "tree", "theory", "yak"}), (2, {"tree", "theory", "yak"}), (1 << 16, set())):
        monkeypatch.setattr(KB, "COMMON", most, raising=False)
        found.append(sorted(((r["doc_id"], r["phrase"], r["sim"], r["norm"], r["terms"]) for r in rows(KB.tfidf_candidates(docs, KB.KeyBertConfig())))))
        assert {t["term"] for r in rows(sent.pop()) for t in r["rare"]} == met
    assert found[0] == found[1] == found[2] and len({x[0] for x in found[0]}) == 5


def test_only_rare_words_meet_the_vocabulary(spark, sent):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = EN.build_vocab(docs)
    words = {r["term"]: r["id"] for r in rows(vocab)}
    for head in (2, 1 << 16):
        got = sorted((r["doc_id"], r["ids"]) for r in rows(EN.encode(docs.where("doc_id is not null"), "text", vocab, head=head)))
        assert got[0] == (1, [words[w] for w in "graph theory and graph search".split()]) and [x for x in got if x[0] in (4, 5)] == [(4, []), (5, [])]
        assert len({t["term"] for r in rows(sent.pop()) for t in r["rare"]}) == max(len(words) - head, 0)


@pytest.mark.parametrize(("name", "others"), [("enc5_collate", 0), ("enc6_enc7_prompt_mask", 0), ("enc8_pretokenized", 0), ("agg9_notebook_metrics", 2)])
def test_rows_are_encoded_once(spark, tmp_path, name, others):
    """The ranks and the batches are made of written rows; ``others``: the gold and the predicted list."""
    docs = spark.createDataFrame([(i, f"graph theory number{i % 3} search", "a") for i in range(9)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert getattr(QM, name)(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == others


def test_phrases_are_counted_without_a_row_each(spark, monkeypatch):
    """Few or many packs and buckets: the candidates in two documents at least, whole."""
    docs = spark.createDataFrame([*TEXTS, *((i, f"tree graph zebra w{i} w{i % 4}") for i in range(20, 60))], "doc_id long, text string")
    every = rows(KB.tfidf_candidates(docs, KB.KeyBertConfig()))
    df = Counter(r["phrase"] for r in every)
    shown = lambda x: sorted((r["doc_id"], r["phrase"], r["sim"], r["norm"], r["terms"], r["tn"]) for r in x)
    for pack, bucket in ((1, 1), (300, 200), (10 ** 9, 10 ** 9)):
        monkeypatch.setattr(PC, "PACK", pack)
        monkeypatch.setattr(PC, "BUCKET", bucket)
        for least in (2, 5):
            got = KB.tfidf_candidates(docs, KB.KeyBertConfig(min_df=least))
            assert shown(rows(got)) == shown(r for r in every if df[r["phrase"]] >= least)
        assert "phrase" not in got._jdf.queryExecution().optimizedPlan().toString().split("\n", 1)[1]
    assert rows(KB.tfidf_candidates(docs.limit(0), KB.KeyBertConfig(min_df=2))) == []


def test_ranker_features_carry_labels_and_meet_no_phrase_table(spark, sent, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    gold = spark.createDataFrame([(1, ["Graph Theory", "search"]), (3, ["zebra"]), (6, ["none"]), (None, ["graph"])], "doc_id long, ref array<string>")
    splits = spark.createDataFrame([(1, "train"), (3, "test"), (6, "train"), (None, "train")], "doc_id long, split string")
    plain = RK.candidate_features(docs)
    assert len(sent) == 3  # sends and answers of the packs, then the rows
    assert not any("phrase" in df.columns for df in sent)
    want = {(r["doc_id"], r["phrase"], r["label"], r["split"]) for r in rows(RK.label(plain, gold).join(splits, "doc_id"))}
    for pack, bucket in ((1, 1), (10 ** 9, 10 ** 9)):
        monkeypatch.setattr(PC, "PACK", pack)
        monkeypatch.setattr(PC, "BUCKET", bucket)
        feats = RK.candidate_features(docs, gold=gold, splits=splits)
        assert {(r["doc_id"], r["phrase"], r["label"], r["split"]) for r in rows(feats.where("split is not null"))} == want
        assert sorted(rows(feats.drop("label", "split")), key=str) == sorted(rows(plain), key=str)
    assert sum(x[2] for x in want) == 3
    one = {r["phrase"]: r for r in rows(plain.where("doc_id = 1"))}
    assert abs(one["graph theory"]["log_df"] - math.log(2)) < 1e-12
    assert abs(one["graph theory"]["idf"] - (math.log(9 / 5) + math.log(9 / 2)) / 2) < 1e-12
