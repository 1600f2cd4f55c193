"""YAKE (Campos et al., Information Sciences 509, 2020) as a relational job.

YAK2 term statistics, YAK3 co-occurrence, YAK4 term score, YAK5 candidate
score, YAK6 near-duplicate walk, TOP1 ordering, YAK1 wrapper
(post-processing of the ranked list).

Term ``t`` of a document (lower-cased token):
  tf, tf_a (all upper-case occurrences), tf_n (capitalised, not first of its
  sentence), sentence ids S(t) (distinct), left/right neighbours inside a
  block (pairs up to ``window_size`` tokens apart; pairs with a digit or mixed
  letter-digit token skipped):
  DL = distinct left / left count, DR likewise.
  TCase = max(tf_a, tf_n) / (1 + ln tf)        TPos = ln(ln(3 + median S(t)))
  TFnorm = tf / (mean tf + sd tf) over non-stop terms
  TRel = 1 + (DL + DR) * tf / max tf           TSent = |S(t)| / #sentences
  H(t) = TRel * TPos / (TCase + TFnorm / TRel + TSent / TRel)
``features`` names the parts of H in use (WRel, WFreq, WSpread, WCase, WPos;
None: all); a part that is left out has its neutral value, 1 for TRel and TPos
and 0 for the others.  Stop words follow ``language``, or the language that a
column of the documents names for each row.
Candidate ``c`` (1..n consecutive tokens, any n of one block; no digit / mixed
token; first and last not a stop word; stop word = listed or shorter than
3 characters):  prod = product of H over non-stop terms times (2 - p) per
inner stop word, sum = sum of H minus (1 - p) per inner stop word, with
p = w(prev, stop) / tf(prev) * w(stop, next) / tf(next);
score(c) = prod / ((1 + sum) * tf(c)).  Lower is better.
Then: walk by (score, phrase), skip a phrase whose Levenshtein similarity
to a kept phrase exceeds ``dedup``, stop at ``top_k``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyforge.session import cut_lineage, keep, scratch

from keyforge.functions.stopwords import BY_LANGUAGE
from keyforge.functions.text import empty_strs, postprocess
from keyforge.operators import batches as B
from keyforge.operators.tokens import is_digit, is_mixed, token_rows, token_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_DIGITS = 12  # scores are ranked after rounding, absorbing last-ulp noise


FEATURES = ("WRel", "WFreq", "WSpread", "WCase", "WPos")


@dataclass
class YakeConfig:
    language: str = "en"
    max_ngram_size: int = 3
    dedup_thresh: float = 0.9
    window_size: int = 1
    top_k: int = 20
    features: tuple | None = None
    lowercase: bool = False
    min_len: int = 2
    max_len: int | None = None
    dedupe: bool = True
    #: A list of one's own in place of the language's.
    stopwords: tuple | None = None
    #: A column of the documents that names each one's language; languages without a list use ``language``.
    language_col: str | None = None

    def __post_init__(self):
        if self.stopwords is None and self.language not in BY_LANGUAGE:
            raise ValueError(f"no stop words for {self.language!r}; known are {sorted(BY_LANGUAGE)}, or pass stopwords")
        if self.max_ngram_size < 1 or self.window_size < 1:
            raise ValueError("max_ngram_size and window_size start at 1")
        unknown = set(self.features or ()) - set(FEATURES)
        if unknown or self.features is not None and not {"WFreq", "WSpread"} & set(self.features):
            raise ValueError(f"features are {FEATURES}, with WFreq or WSpread among them: without both H divides by 0")

    @property
    def keep(self) -> tuple:
        """Columns of the documents that the token table carries along."""
        return (self.language_col,) if self.language_col else ()

    @property
    def reach(self) -> int:
        return max(self.window_size, self.max_ngram_size - 1, 1)

    def uses(self, feature: str) -> bool:
        return self.features is None or feature in self.features


def _listed(term: Column, cfg: YakeConfig) -> Column:
    own = term.isin(list(cfg.stopwords or BY_LANGUAGE[cfg.language]))
    if cfg.language_col and cfg.stopwords is None:
        by = None
        for lang, words in BY_LANGUAGE.items():
            hit = F.col(cfg.language_col) == lang
            by = F.when(hit, term.isin(list(words))) if by is None else by.when(hit, term.isin(list(words)))
        own = by.otherwise(own)
    return own


def _stop(term: Column, cfg: YakeConfig) -> Column:
    return _listed(term, cfg) | (F.length(term) < 3)


def _joined_stats(stats, left, right, cfg):
    return (stats.join(left, ["doc_id", "term"], "left").join(right, ["doc_id", "term"], "left")
            .withColumn("stop", _stop(F.col("term"), cfg)))


def term_statistics(toks: DataFrame, cfg: YakeConfig) -> DataFrame:
    """YAK2 + YAK3: (doc_id, term, tf, tf_a, tf_n, sf, med, n_sent, wdl, wil,
    wdr, wir, stop) before scoring."""
    return term_scores(toks, cfg, raw=True)


def term_scores(toks: DataFrame, cfg: YakeConfig, raw: bool = False):
    """YAK2-YAK4. Returns (terms(doc_id, term, tf, stop, H), edges(doc_id, a, b, w))."""
    t = toks.select(
        "doc_id", *cfg.keep, "n_sent", "sid", "bid", "tid", F.lower("tok").alias("term"), "tok",
        *(F.col(f"nxt{d}") for d in range(1, cfg.window_size + 1)),
        (is_digit(F.col("tok")) | is_mixed(F.col("tok"))).alias("discard"))
    tag_a = F.col("tok").rlike(r"^\p{Lu}+$") & ~F.col("discard")
    tag_n = (F.col("tok").rlike(r"^\p{Lu}") & ~tag_a & ~F.col("discard")
             & ~((F.col("bid") == 0) & (F.col("tid") == 0)))
    # One aggregate per (doc_id, term); the distinct sentence ids of a term are
    # bounded by the document's sentence count, so their median is read from
    # the sorted set (interpolated like percentile 0.5).
    stats = (t.groupBy("doc_id", "term")
             .agg(F.count(F.lit(1)).alias("tf"), F.sum(tag_a.cast("int")).alias("tf_a"),
                  F.sum(tag_n.cast("int")).alias("tf_n"), F.array_sort(F.collect_set("sid")).alias("sids"),
                  F.first("n_sent").alias("n_sent"), *(F.first(c).alias(c) for c in cfg.keep)))
    k = F.size("sids")
    lo = F.element_at("sids", F.floor((k - 1) / 2).cast("int") + 1)
    hi = F.element_at("sids", F.ceil((k - 1) / 2).cast("int") + 1)
    stats = stats.select("doc_id", *cfg.keep, "term", "tf", "tf_a", "tf_n", "n_sent", k.alias("sf"),
                         (lo + (hi - lo) * F.lit(0.5)).alias("med"))
    # All following tokens within the window, from one explode.
    near = F.filter(F.array(*[F.when(~(is_digit(F.col(c)) | is_mixed(F.col(c))), F.lower(c))
                              for c in (f"nxt{d}" for d in range(1, cfg.window_size + 1))]), lambda x: x.isNotNull())
    edges = (t.where(~F.col("discard")).select("doc_id", F.col("term").alias("a"), F.explode(near).alias("b"))
             .groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("w")))
    right = edges.groupBy("doc_id", F.col("a").alias("term")).agg(
        F.count(F.lit(1)).alias("wdr"), F.sum("w").alias("wir"))
    left = edges.groupBy("doc_id", F.col("b").alias("term")).agg(
        F.count(F.lit(1)).alias("wdl"), F.sum("w").alias("wil"))
    s = _joined_stats(stats, left, right, cfg)
    if raw:
        return s
    doc = Window.partitionBy("doc_id")
    valid_tf = F.when(~F.col("stop"), F.col("tf"))
    s = (s.withColumn("max_tf", F.max("tf").over(doc))
         .withColumn("avg_tf", F.avg(valid_tf).over(doc))
         .withColumn("std_tf", F.stddev_pop(valid_tf).over(doc)))
    pwl = F.when(F.col("wil") > 0, F.col("wdl") / F.col("wil")).otherwise(F.lit(0.0))
    pwr = F.when(F.col("wir") > 0, F.col("wdr") / F.col("wir")).otherwise(F.lit(0.0))
    one, none = F.lit(1.0), F.lit(0.0)
    rel = ((F.lit(0.5) + pwl * (F.col("tf") / F.col("max_tf"))) + (F.lit(0.5) + pwr * (F.col("tf") / F.col("max_tf")))) if cfg.uses("WRel") else one
    freq = F.col("tf") / (F.col("avg_tf") + F.col("std_tf")) if cfg.uses("WFreq") else none
    spread = F.col("sf") / F.col("n_sent") if cfg.uses("WSpread") else none
    case = F.greatest("tf_a", "tf_n") / (one + F.log(F.col("tf"))) if cfg.uses("WCase") else none
    pos = F.log(F.log(F.lit(3.0) + F.col("med"))) if cfg.uses("WPos") else one
    h = (pos * rel) / (case + (freq / rel) + (spread / rel))
    terms = s.select("doc_id", "term", "tf", "stop", h.alias("H"))
    return terms, edges


def candidates(toks: DataFrame, terms: DataFrame, edges: DataFrame, cfg: YakeConfig) -> DataFrame:
    """YAK5: (doc_id, phrase, score) for every valid candidate.

    Each token is annotated once with its term's H / stop / tf and with the
    weight of the edge to the next token (two joins on the token table);
    a block's annotated tokens are then cut into 1..n-grams by array index,
    so the candidate table needs no further join."""
    n = cfg.max_ngram_size
    t = toks.select("doc_id", "sid", "bid", "tid", F.lower("tok").alias("term"), F.lower("nxt1").alias("nxt"),
                    (is_digit(F.col("tok")) | is_mixed(F.col("tok"))).alias("disc"))
    t = t.join(terms.select("doc_id", "term", "H", "stop", "tf"), ["doc_id", "term"], "left")
    t = t.join(edges.select("doc_id", F.col("a").alias("term"), F.col("b").alias("nxt"), "w"),
               ["doc_id", "term", "nxt"], "left")
    blocks = (t.groupBy("doc_id", "sid", "bid")
              .agg(F.array_sort(F.collect_list(F.struct("tid", "term", "H", "stop", "tf", "w", "disc"))).alias("a")))
    a = F.col("a")
    grams = blocks.select("doc_id", F.explode(F.filter(F.flatten(F.transform(
        a, lambda x, i: F.array(*[F.when(i + sz <= F.size(a), F.slice(a, i + 1, sz)) for sz in range(1, n + 1)]))),
        lambda g: g.isNotNull())).alias("g"))
    g = F.col("g")
    first, last = F.element_at(g, 1), F.element_at(g, -1)
    ok = ~first["stop"] & ~last["stop"] & ~F.exists(g, lambda x: x["disc"])
    grams = grams.where(ok).select("doc_id", F.array_join(g["term"], " ").alias("phrase"), "g")
    cand = grams.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("ctf"), F.first("g").alias("g"))
    g = F.col("g")
    e = lambda i: F.get(g, i)
    one, zero = F.lit(1.0), F.lit(0.0)
    # Term by term from the left; places past the end add nothing.  A stop word
    # is never first or last, so it has both neighbours.
    prod, total = one, zero
    for i in range(n):
        factor, addend = e(i)["H"], e(i)["H"]
        if 0 < i < n - 1:
            p = (F.coalesce(e(i - 1)["w"], F.lit(0)) / e(i - 1)["tf"]) * (F.coalesce(e(i)["w"], F.lit(0)) / e(i + 1)["tf"])
            factor = F.when(e(i)["stop"], one + (one - p)).otherwise(factor)
            addend = F.when(e(i)["stop"], -(one - p)).otherwise(addend)
        prod, total = prod * F.coalesce(factor, one), total + F.coalesce(addend, zero)
    score = prod / ((total + one) * F.col("ctf"))
    return cand.select("doc_id", "phrase", score.alias("score"))


# --- whole documents: the same statistics and scores, a batch of documents at a time ---

class _Terms:
    """YAK2-YAK4 of a batch: one entry per (document, term), sorted; edges as
    pairs of such entries with their counts."""

    def __init__(self, batch: pa.RecordBatch, cfg: YakeConfig):
        t = self.toks = B.Tokens(batch["toks"])
        n = len(t.terms)
        self.disc = t.flag(B.no_word)
        tag_a = t.flag(B.is_upper) & ~self.disc
        tag_n = t.flag(B.is_title) & ~tag_a & ~self.disc & ~((t.bid == 0) & (t.tid == 0))
        groups, _, self.g, self.tf = B.distinct(t.doc * n + t.term)
        size = self.size = len(groups)
        self.doc, self.term = (groups // n, groups % n) if size else (groups, groups)
        self.tf_a = np.bincount(self.g[tag_a], minlength=size)
        self.tf_n = np.bincount(self.g[tag_n], minlength=size)
        wide = int(t.sid.max(initial=0)) + 1
        spread = np.unique(self.g * wide + t.sid)
        self.sf = np.bincount(spread // wide, minlength=size)
        first = np.cumsum(self.sf) - self.sf
        sid = spread % wide
        lo, hi = (sid[first + (self.sf - 1) // 2], sid[first + self.sf // 2]) if size else (sid, sid)
        self.med = lo + (hi - lo) * 0.5
        self.stop = self.stops(batch, cfg)
        # an id that is null meets nothing in a join on it
        self.known = ~batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
        keys = [np.zeros(0, dtype=np.int64)]
        for d in range(1, cfg.window_size + 1):
            at = t.pairs(d)
            at = at[~self.disc[at] & ~self.disc[at + d]]
            keys.append(self.g[at] * size + self.g[at + d])
        self.edge, self.w = np.unique(np.concatenate(keys), return_counts=True)
        self.a, self.b = (self.edge // size, self.edge % size) if size else (self.edge, self.edge)
        count = lambda at, w=None: np.bincount(at, weights=w, minlength=size).astype(np.int64) * self.known[self.doc]
        self.wdr, self.wir, self.wdl, self.wil = count(self.a), count(self.a, self.w), count(self.b), count(self.b, self.w)

    def stops(self, batch: pa.RecordBatch, cfg: YakeConfig) -> np.ndarray:
        short = self.toks.of_terms(lambda x: len(x) < 3)
        listed = lambda words: (self.toks.of_terms(set(words).__contains__) | short)[self.term] if self.size else np.zeros(0, dtype=bool)
        out = listed(cfg.stopwords or BY_LANGUAGE[cfg.language])
        if cfg.language_col and cfg.stopwords is None:
            langs = np.array(batch[cfg.language_col].to_pylist(), dtype=object)[self.doc]
            for lang, words in BY_LANGUAGE.items():
                out = np.where(langs == lang, listed(words), out)
        return out

    def scores(self, cfg: YakeConfig) -> np.ndarray:
        """H of every entry; not a number where a document has stop words alone."""
        docs, n = self.doc, self.toks.n
        tf = self.tf.astype(np.float64)
        top = np.zeros(n)
        np.maximum.at(top, docs, tf)
        valid = ~self.stop
        with np.errstate(invalid="ignore", divide="ignore"):
            count = np.bincount(docs[valid], minlength=n)
            avg = np.bincount(docs[valid], weights=tf[valid], minlength=n) / count
            sd = np.sqrt(np.bincount(docs[valid], weights=(tf[valid] - avg[docs[valid]]) ** 2, minlength=n) / count)
            pwl = np.where(self.wil > 0, self.wdl / self.wil, 0.0)
            pwr = np.where(self.wir > 0, self.wdr / self.wir, 0.0)
            share = tf / top[docs]
            rel = (0.5 + pwl * share) + (0.5 + pwr * share) if cfg.uses("WRel") else np.ones(self.size)
            freq = tf / (avg + sd)[docs] if cfg.uses("WFreq") else np.zeros(self.size)
            spread = self.sf / self.toks.n_sent[docs] if cfg.uses("WSpread") else np.zeros(self.size)
            case = np.maximum(self.tf_a, self.tf_n) / (1.0 + np.log(tf)) if cfg.uses("WCase") else np.zeros(self.size)
            pos = np.log(np.log(3.0 + self.med)) if cfg.uses("WPos") else np.ones(self.size)
            return (pos * rel) / (case + (freq / rel) + (spread / rel))

    def candidates(self, cfg: YakeConfig, h: np.ndarray):
        """YAK5: (document, numbers of the terms or -1, score) of every candidate."""
        t, size, n = self.toks, self.size, cfg.max_ngram_size
        nxt = t.pairs(1)
        w = np.zeros(len(t.block), dtype=np.int64)
        key = self.g[nxt] * size + self.g[nxt + 1]
        at = np.searchsorted(self.edge, key)
        hit = at < len(self.edge)
        hit[hit] = self.edge[at[hit]] == key[hit]
        w[nxt[hit]] = self.w[at[hit]]
        g, disc, block = self.g, self.disc, t.block
        if t.twice:  # blocks at one place of several texts with one id are one block
            order = np.lexsort((disc, w, t.term, t.tid, t.bid, t.sid, t.doc))
            g, disc, w = g[order], disc[order], w[order]
            here = np.stack([t.doc[order], t.sid[order], t.bid[order]])
            block = np.cumsum(np.concatenate([[0], (here[:, 1:] != here[:, :-1]).any(axis=0)])) if len(order) else block
        stop = self.stop[g] if size else np.zeros(0, dtype=bool)
        usable = self.known[self.doc[g]] & ~disc if size else stop
        start, dense = np.flatnonzero(usable), g[usable]
        out = []
        for sz in range(1, n + 1):
            if sz > 1:
                last = start + sz - 1
                go = last < len(g)
                go[go] = (block[last[go]] == block[start[go]]) & usable[last[go]]
                start, dense, last = start[go], dense[go], last[go]
                _, dense = np.unique(dense * size + g[last], return_inverse=True)
            ends = ~stop[start] & ~stop[start + sz - 1]
            _, one, ctf = np.unique(dense[ends], return_index=True, return_counts=True)
            at = start[ends][one]
            prod, total = np.ones(len(at)), np.zeros(len(at))
            for i in range(sz):
                e = g[at + i]
                factor, addend = h[e], h[e]
                if 0 < i < n - 1 and i < sz - 1:
                    p = (w[at + i - 1] / self.tf[g[at + i - 1]]) * (w[at + i] / self.tf[g[at + i + 1]])
                    factor = np.where(self.stop[e], 1.0 + (1.0 - p), factor)
                    addend = np.where(self.stop[e], -(1.0 - p), addend)
                prod, total = prod * factor, total + addend
            words = np.full((len(at), n), -1, dtype=np.int64)
            for i in range(sz):
                words[:, i] = self.term[g[at + i]]
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append((self.doc[g[at]] if size else at, words, prod / ((total + 1.0) * ctf)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def phrase_names(names: pa.Array, words: np.ndarray) -> pa.Array:
    """The terms of every row of ``words`` (-1: none) with spaces between."""
    cols = [names.take(pa.array(c, mask=c < 0)) for c in words.T]
    return cols[0] if len(cols) == 1 else pc.binary_join_element_wise(*cols, " ", null_handling="skip")


def _edge_rows(batch: pa.RecordBatch, cfg: YakeConfig) -> pa.RecordBatch:
    s = _Terms(batch, cfg)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(pa.array(s.doc[s.a])), s.toks.names.take(pa.array(s.term[s.a])), s.toks.names.take(pa.array(s.term[s.b])), pa.array(s.w)],
        ["doc_id", "a", "b", "w"])


def _term_rows(batch: pa.RecordBatch, cfg: YakeConfig) -> pa.RecordBatch:
    s = _Terms(batch, cfg)
    h = s.scores(cfg)
    no = lambda x: pa.array(x, mask=x == 0)
    cols = {"term": s.toks.names.take(pa.array(s.term)), "tf": pa.array(s.tf), "tf_a": pa.array(s.tf_a), "tf_n": pa.array(s.tf_n),
            "n_sent": pa.array(s.toks.n_sent[s.doc].astype(np.int32)), "sf": pa.array(s.sf.astype(np.int32)), "med": pa.array(s.med),
            "wdl": no(s.wdl), "wil": no(s.wil), "wdr": no(s.wdr), "wir": no(s.wir), "stop": pa.array(s.stop), "H": pa.array(h, mask=np.isnan(h))}
    return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(s.doc)), *cols.values()], ["doc_id", *cols])


def _candidate_lists(batch: pa.RecordBatch, cfg: YakeConfig, most: int | None) -> pa.RecordBatch:
    s = _Terms(batch, cfg)
    doc, words, score = s.candidates(cfg, s.scores(cfg))
    order = np.lexsort((*words.T[::-1], B.rounded(score, SCORE_DIGITS), doc))
    doc, words, score = doc[order], words[order], score[order]
    n = np.bincount(doc, minlength=s.toks.n)
    rank = B.rank_in(doc) + 1
    if most is not None:
        cut = rank <= most
        doc, words, score, rank = doc[cut], words[cut], score[cut], rank[cut]
    lists = B.in_lists(np.bincount(doc, minlength=s.toks.n), B.structs(rk=rank.astype(np.int32), phrase=phrase_names(s.toks.names, words), score=score))
    return pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(n)], ["doc_id", "c", "n"])


def document_terms(docs: DataFrame, cfg: YakeConfig | None = None) -> DataFrame:
    """YAK2-YAK4: (doc_id, term, tf, tf_a, tf_n, n_sent, sf, med, wdl, wil, wdr,
    wir, stop, H), the rows of ``term_statistics`` and ``term_scores``."""
    cfg = cfg or YakeConfig()
    t = token_rows(docs, cfg.keep)
    return B.map_batches(t, lambda b: _term_rows(b, cfg), B.typed(
        t, "term string, tf long, tf_a long, tf_n long, n_sent int, sf int, med double, wdl long, wil long, wdr long, wir long, stop boolean, H double"))


def document_edges(docs: DataFrame, cfg: YakeConfig | None = None) -> DataFrame:
    """YAK3: (doc_id, a, b, w), the edges of ``term_scores``."""
    cfg = cfg or YakeConfig()
    t = token_rows(docs, cfg.keep)
    return B.map_batches(t, lambda b: _edge_rows(b, cfg), B.typed(t, "a string, b string, w long"))


def candidate_lists(docs: DataFrame, cfg: YakeConfig | None = None, most: int | None = None) -> DataFrame:
    """YAK5: (doc_id, c: array<struct<rk, phrase, score>>, n): the ``most`` best
    candidates of every document in the order of the walk (None: all), and how
    many it has.  The rows of ``candidates``, ranked."""
    cfg = cfg or YakeConfig()
    t = token_rows(docs, cfg.keep)
    return B.map_batches(t, lambda b: _candidate_lists(b, cfg, most), B.typed(
        t, "c array<struct<rk: int, phrase: string, score: double>>, n long"))


def _similar(dedup: float):
    def accept(kept, x):
        def near(y):
            most = F.greatest(F.length(y["phrase"]), F.length(x["phrase"]))
            # the distance is at least the difference in length, which is read first
            return ((F.lit(1.0) - F.abs(F.length(y["phrase"]) - F.length(x["phrase"])) / most > F.lit(dedup))
                    & (F.lit(1.0) - F.levenshtein(y["phrase"], x["phrase"]) / most > F.lit(dedup)))
        return ~F.exists(kept, near)
    return accept


#: Candidates of a document that the first walk takes; documents still open then walk their whole list.
FIRST_WALK = 64


def ranked_keyphrases(docs: DataFrame, cfg: YakeConfig | None = None, first: int = FIRST_WALK) -> DataFrame:
    """YAK2-YAK6 + TOP1: (doc_id, rank, phrase, score) of the kept phrases."""
    cfg = cfg or YakeConfig()
    accept = _similar(cfg.dedup_thresh)

    def walked(d: DataFrame, most: int | None) -> DataFrame:
        c = candidate_lists(d, cfg, most)
        empty = F.array().cast(c.schema["c"].dataType)
        step = lambda acc, x: F.when((F.size(acc) >= cfg.top_k) | ~accept(acc, x), acc).otherwise(F.concat(acc, F.array(x)))
        return c.select("doc_id", F.aggregate("c", empty, step).alias("kept"), "n")

    # Cached: the second walk reads the open documents from it.
    begun = keep(walked(docs, first))
    done = (F.size("kept") >= cfg.top_k) | (F.col("n") <= first)
    rest = walked(docs.join(begun.where(~done).select("doc_id"), "doc_id", "left_semi"), None)
    kept = begun.where(done).select("doc_id", "kept").unionByName(rest.select("doc_id", "kept"))
    return (kept.select("doc_id", F.posexplode("kept").alias("pos", "k"))
            .select("doc_id", (F.col("pos") + 1).alias("rank"), F.col("k.phrase").alias("phrase"),
                    F.col("k.score").alias("score")))


def extract(docs: DataFrame, cfg: YakeConfig | None = None) -> DataFrame:
    """YAK1 ``YakeExtractor.extract`` for every document: (doc_id, keywords);
    blank documents get ``[]`` (FLT4)."""
    cfg = cfg or YakeConfig()
    with scratch():
        kept = ranked_keyphrases(docs, cfg)
        lists = (kept.groupBy("doc_id")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("s"))
                 .select("doc_id", postprocess(F.col("s.phrase"), cfg.lowercase, cfg.min_len, cfg.max_len,
                                               cfg.dedupe).alias("keywords")))
        return cut_lineage(docs.select("doc_id").join(lists, "doc_id", "left")
                           .select("doc_id", F.coalesce("keywords", empty_strs()).alias("keywords")))
