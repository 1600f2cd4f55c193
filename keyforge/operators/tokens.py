"""TOK1: sentence / block / token tables shared by all extractors.

Layout of a document: sentences are split at runs of ``.``, ``!``, ``?`` that
white space follows, and at LF (pieces without a word character are dropped);
a sentence is cut into *blocks* at runs of punctuation (anything that is not a
letter, digit or whitespace), and blocks without a word character are not
counted; tokens are ``[\\p{L}\\p{N}]+`` runs inside a block.  Candidate
phrases never cross a block; neighbour relations are taken inside a block.

The neighbours of a token are read from the block's token array by index in
the same projection that explodes it, so no window sort is needed, and the
result stays partitioned like the input (hash on ``doc_id`` after
``by_doc``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyforge.functions.text import TOKEN_RE

SENT_SPLIT = r"[.!?]+[\x20\x09-\x0D]+|\x0A+"
PUNCT_RUN = r"[^\p{L}\p{N}\s]+"
HAS_WORD = r"[\p{L}\p{N}]"


def sentence_table(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """(doc_id, keep..., sid, sent): sentences with at least one word character,
    numbered from 0 in document order; plus ``n_sent`` per document."""
    sents = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SENT_SPLIT, -1),
                     lambda s: s.rlike(HAS_WORD))
    return (docs.select("doc_id", *keep, sents.alias("_s"))
            .select("doc_id", *keep, F.size("_s").alias("n_sent"), F.posexplode("_s").alias("sid", "sent")))


def block_table(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """(doc_id, keep..., n_sent, sid, bid, toks): the token array of every block."""
    s = sentence_table(docs, keep)
    blocks = F.filter(F.split("sent", PUNCT_RUN, -1), lambda x: x.rlike(HAS_WORD))
    b = s.select("doc_id", *keep, "n_sent", "sid", F.posexplode(blocks).alias("bid", "block"))
    return b.select("doc_id", *keep, "n_sent", "sid", "bid",
                    F.regexp_extract_all("block", F.lit(TOKEN_RE), 0).alias("toks"))


def token_rows(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """(doc_id, keep..., toks): one row per id, ``toks`` its texts as arrays of
    sentences of blocks of tokens, numbered as in the tables above.  No row per
    token: the documents are dealt by id once, as they are."""
    texts = docs.groupBy("doc_id").agg(F.collect_list(F.coalesce(F.col("text"), F.lit(""))).alias("_t"),
                                       *(F.first(c).alias(c) for c in keep))

    def blocks(sent):
        return F.transform(F.filter(F.split(sent, PUNCT_RUN, -1), lambda x: x.rlike(HAS_WORD)),
                           lambda b: F.regexp_extract_all(b, F.lit(TOKEN_RE), F.lit(0)))

    return texts.select("doc_id", *keep, F.transform("_t", lambda t: F.transform(
        F.filter(F.split(t, SENT_SPLIT, -1), lambda s: s.rlike(HAS_WORD)), blocks)).alias("toks"))


def rows_of_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, toks) of a block table in the form of ``token_rows``; for what
    depends on the blocks alone, not on their places."""
    return blocks.groupBy("doc_id").agg(F.array(F.array(F.collect_list("toks"))).alias("toks"))


def token_table(docs: DataFrame, reach: int = 2, keep: tuple = ()) -> DataFrame:
    """(doc_id, keep..., n_sent, sid, bid, tid, tok, nxt1..nxt{reach}) with ``nxt*``
    the following tokens of the same block (null past its end)."""
    return token_table_from_blocks(block_table(docs, keep).where(F.size("toks") > 0), reach, keep)


def token_table_from_blocks(b: DataFrame, reach: int = 2, keep: tuple = ()) -> DataFrame:
    """Token rows of a (possibly shared, persisted) block table."""

    def item(x, i):
        fields = [x.alias("tok")] + [F.get(F.col("toks"), i + d).alias(f"nxt{d}")
                                     for d in range(1, reach + 1)]
        return F.struct(*fields)

    t = b.select("doc_id", *keep, "n_sent", "sid", "bid",
                 F.posexplode(F.transform("toks", item)).alias("tid", "e"))
    return t.select("doc_id", *keep, "n_sent", "sid", "bid", "tid", "e.*")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) over lower-cased word tokens of the whole text."""
    toks = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_RE), 0)).alias("t"))
    return toks.groupBy("doc_id", F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def is_digit(tok: Column) -> Column:
    return tok.rlike(r"^\p{N}+$")


def is_mixed(tok: Column) -> Column:
    return tok.rlike(r"\p{N}") & tok.rlike(r"\p{L}")
