"""KeyBERT-style extraction (KEY1-KEY6): candidates, vectors, cosine, MMR.

KEY2 candidates: lower-cased word tokens of >= 2 characters with stop words
removed, then distinct 1..3-grams over that sequence (count-vectoriser
semantics: n-grams may span a removed stop word).
KEY4 encoder: TF-IDF (smooth idf = ln((1 + N) / (1 + df)) + 1) over the
corpus; a document vector is tf * idf of its terms, a candidate vector is
count-in-phrase * idf.  Any other encoder plugs in as a vector table
(``mmr_select`` works on dense vectors too, see ``embedding_mmr``).
KEY5 MMR: first the best cosine to the document, then repeatedly
``argmax (1 - d) * sim(doc) - d * max sim(chosen)``; ties go to the
alphabetically first phrase (the vocabulary order of the reference).

Exact and bounded: MMR runs on each document's top ``M`` candidates by
document similarity for ``M`` in (256, 2048), then on the document's whole
list (bounded by its length) for the few documents still open.  For
groups that are not bounded (``embedding_mmr``: all vectors of a label)
the last tier is the relational MMR (one distributed argmax and one join
per pick), so such a group is never collected whole.  Every candidate
outside the cut scores at most ``(1 - d) * sim[M + 1] - d * floor`` (floor =
lowest possible pair similarity), so when every pick beats that bound the
result equals MMR over all candidates; otherwise only that document moves
on to the next tier.
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

from keyforge.session import cut_lineage, keep, scratch, written

from keyforge.functions.stopwords import ENGLISH
from keyforge.functions.text import TOKEN_RE, empty_strs, postprocess
from keyforge.operators import batches as B
from keyforge.operators import maxsum as MS
from keyforge.operators import phrase_counts as PC
from keyforge.operators.yake import phrase_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIM_DIGITS = 12
MAX_ROUNDS = 3  # of Word2Vec training
# Documents: the last tier is the document's whole candidate list, bounded
# by the document's length.  Arbitrary groups (e.g. all vectors of a label)
# are not bounded, so their last tier is the relational MMR.
TIERS = (256, 2048, None)
GROUP_TIERS = (32, 256, 2048, "relational")


@dataclass
class KeyBertConfig:
    top_k: int = 20
    ngram_range: tuple = (1, 3)
    stopwords: tuple = field(default_factory=lambda: tuple(ENGLISH))
    use_mmr: bool = True
    diversity: float = 0.6
    use_maxsum: bool = False
    nr_candidates: int = 20
    min_df: int = 1
    lowercase: bool = False
    min_len: int = 2
    max_len: int | None = None
    dedupe: bool = True


def _words(text: Column, stopwords) -> Column:
    toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)
    return F.filter(toks, lambda t: (F.length(t) >= 2) & ~t.isin(list(stopwords)))


def candidate_terms(docs: DataFrame, cfg: KeyBertConfig) -> DataFrame:
    """KEY2: (doc_id, phrase, term, cnt) — every distinct candidate with the
    count of each of its terms."""
    lo, hi = cfg.ngram_range
    w = docs.select("doc_id", _words(F.col("text"), cfg.stopwords).alias("w"))
    grams = w.select("doc_id", F.explode(F.transform(
        "w", lambda x, i: F.array(*[F.slice(F.col("w"), i + 1, n) for n in range(lo, hi + 1)]))).alias("g"))
    grams = grams.select("doc_id", F.explode("g").alias("g"))
    grams = grams.where(F.size("g") >= lo)
    sizes = F.size("g")
    # slice() near the end yields shorter arrays; keep exact n-grams only
    grams = grams.where(sizes.isin(list(range(lo, hi + 1))))
    cands = grams.select("doc_id", F.array_join("g", " ").alias("phrase"), "g").dropDuplicates(["doc_id", "phrase"])
    return (cands.select("doc_id", "phrase", F.explode("g").alias("term"))
            .groupBy("doc_id", "phrase", "term").agg(F.count(F.lit(1)).alias("cnt")))


#: Words whose idf every task has (a fixed bound); only the others meet the idf table.
COMMON = 1 << 16


def weighted_words(docs: DataFrame, cfg: KeyBertConfig, common: int | None = None) -> tuple[DataFrame, tuple[dict, float]]:
    """KEY4 weights: (doc_id, w, rare): one row per id with its words and the
    idf of those of its distinct words that are neither among the ``common``
    most frequent ones nor in one document alone; and the idf of these two.
    The documents are cut into words once, and written; ``w`` has them as one
    string."""
    words = docs.where(F.col("doc_id").isNotNull()).select("doc_id", _words(F.col("text"), cfg.stopwords).alias("w"))
    # Texts with one id are one document whose words stand side by side, by place.
    texts = words.groupBy("doc_id").agg(F.collect_list(F.coalesce("w", empty_strs())).alias("ws"))
    merged = F.transform(F.array_sort(F.flatten(F.transform("ws", lambda ws: F.transform(ws, lambda x, i: F.struct(i.alias("i"), x.alias("x")))))),
                         lambda e: e["x"])
    texts = written(texts.select("doc_id", B.packed(F.when(F.size("ws") == 1, F.get("ws", F.lit(0))).otherwise(merged)).alias("w")).where(F.col("w") != ""), "words")
    own = texts.select("doc_id", F.explode(F.array_distinct(B.unpacked("w"))).alias("term"))
    n_docs = docs.count()

    def idf_of(df_: Column) -> Column:
        return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df_)) + F.lit(1.0)

    # Written before it is joined: AQE then knows its size and can split the
    # partition of a hot term.  Words of one document need no row.
    idf = written(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1).select("term", "df", idf_of(F.col("df")).alias("idf")), "idf")
    hot = head_of(idf, "df", COMMON if common is None else common)
    known = {r["term"]: r["idf"] for r in hot.collect()}
    alone = docs.sparkSession.range(1).select(idf_of(F.lit(1)).alias("idf")).first()["idf"]
    rare = (own.join(F.broadcast(hot.select("term")), "term", "left_anti").join(idf.select("term", "idf"), "term")
            .groupBy("doc_id").agg(F.collect_list(F.struct("term", "idf")).alias("rare")))
    w = texts.join(rare, "doc_id", "left").select("doc_id", "w", F.coalesce("rare", F.array().cast("array<struct<term: string, idf: double>>")).alias("rare"))
    return w, (known, alone)


def size_of(w: DataFrame) -> int:
    """Characters of the documents' words."""
    return w.agg(F.sum(F.length("w").cast("long"))).first()[0] or 0


def head_of(t: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest ``count``, at most ``most``; equal counts stay together."""
    cut, n = None, 0
    for r in t.groupBy(count).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(count).desc()).collect():
        n += r["n"]
        if n > most:
            break
        cut = r[count]
    return t.where(F.col(count) >= F.lit(cut))


class _Candidates:
    """KEY2-KEY4 of a batch: the distinct n-grams of every document in phrase
    order with similarity, norm and the weights of their distinct terms."""

    def __init__(self, batch: pa.RecordBatch, cfg: KeyBertConfig, known: tuple[dict, float]):
        lo, hi = cfg.ngram_range
        head, alone = known
        offsets, words = B.parts(pc.split_pattern(batch["w"], " "))
        _, rare = B.parts(batch["rare"])
        code, _, term_of, self.terms = B.numbered(pa.concat_arrays([words, rare.field("term")]))
        term = term_of[code] if len(code) else code
        tok, rare_term = term[:len(words)], term[len(words):]
        n, self.n = max(len(self.terms), 1), batch.num_rows
        doc = B.owner(offsets)
        term_idf = np.array([head.get(x, alone) for x in self.terms], dtype=np.float64)
        term_idf[rare_term] = rare.field("idf").to_numpy(zero_copy_only=False)
        # entries (document, term), sorted, with idf and document weight
        keys, g, tf = np.unique(doc * n + tok, return_inverse=True, return_counts=True)
        idf = term_idf[keys % n] if len(keys) else np.zeros(0)
        self.wd = tf * idf
        self.entry_term = keys % n
        edoc = keys // n
        dnorm = np.sqrt(np.bincount(edoc, weights=self.wd * self.wd, minlength=self.n))
        out = []
        start, dense = np.arange(len(g)), g
        for sz in range(1, hi + 1):
            if sz > 1:
                last = start + sz - 1
                go = last < len(g)
                go[go] = doc[last[go]] == doc[start[go]]
                start, dense, last = start[go], dense[go], last[go]
                _, dense = np.unique(dense * max(len(keys), 1) + g[last], return_inverse=True)
            if sz >= lo:
                _, one = np.unique(dense, return_index=True)
                at = start[one]
                full = np.full((len(at), hi), -1, dtype=np.int64)
                for i in range(sz):
                    full[:, i] = g[at + i]
                out.append((doc[at], full))
        self.doc, full = (np.concatenate(x) for x in zip(*out, strict=True))
        self.words = np.where(full >= 0, self.entry_term[full], -1) if len(keys) else full
        order = np.lexsort((*self.words.T[::-1], self.doc))
        self.doc, self.words, full = self.doc[order], self.words[order], full[order]
        # distinct entries of a phrase in term order (entries of a document are), -1 behind them; their weights
        ordered = np.sort(np.where(full < 0, np.iinfo(np.int64).max, full), axis=1)
        count = (ordered[:, :, None] == ordered[:, None, :]).sum(axis=2)
        first = np.ones(ordered.shape, dtype=bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        self.has = first & (ordered < np.iinfo(np.int64).max)
        self.entry = np.where(self.has, ordered, 0)
        self.weight = np.where(self.has, count * idf[self.entry], 0.0) if len(idf) else np.zeros(ordered.shape)
        dot, sq = np.zeros(len(self.doc)), np.zeros(len(self.doc))
        for j in range(hi):
            w = self.weight[:, j]
            dot = dot + (self.wd[self.entry[:, j]] * w if len(self.wd) else w)
            sq = sq + w * w
        self.norm = np.sqrt(sq)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.sim = B.rounded(dot / (dnorm[self.doc] * self.norm), SIM_DIGITS)
        self.names = pa.array(self.terms, pa.string())

    def rows(self, batch: pa.RecordBatch, chosen: np.ndarray | None = None, **more) -> pa.RecordBatch:
        """The candidates (or the chosen ones) as rows."""
        at = np.arange(len(self.doc)) if chosen is None else chosen
        has = self.has[at]
        term = self.names.take(pa.array(self.entry_term[self.entry[at][has]])) if len(self.names) else self.names
        n = has.sum(axis=1)
        cols = {"doc_id": batch["doc_id"].take(pa.array(self.doc[at])), "phrase": phrase_names(self.names, self.words[at]), "sim": pa.array(self.sim[at]),
                "terms": B.in_lists(n, B.structs(term=term, w=self.weight[at][has])), "norm": pa.array(self.norm[at]), "tn": B.in_lists(n, term)} | more
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def of_documents(self):
        """The span of every document's candidates."""
        ends = np.cumsum(np.bincount(self.doc, minlength=self.n))
        return zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)

    def mmr(self, a: int, b: int, k: int, d: float) -> list[int]:
        """KEY5 over the candidates of one document, all of them: one pass over
        its sparse weights per pick."""
        sim, norm, entry, weight = self.sim[a:b], self.norm[a:b], self.entry[a:b], self.weight[a:b]
        if b == a:
            return []
        low = int(entry[self.has[a:b]].min())
        entry = np.where(self.has[a:b], entry - low, 0)
        chosen_w = np.zeros(int(entry.max()) + 1)
        near, free = np.zeros(b - a), np.ones(b - a, dtype=bool)
        picks: list[int] = []
        for step in range(min(k, b - a)):
            score = sim if step == 0 else (1.0 - d) * sim - d * near
            j = int(np.argmax(np.where(free, score, -np.inf)))
            picks.append(a + j)
            free[j] = False
            mine = self.has[a + j]
            chosen_w[entry[j][mine]] = weight[j][mine]
            dot = np.zeros(b - a)
            for p in range(entry.shape[1]):
                dot = dot + weight[:, p] * chosen_w[entry[:, p]]
            chosen_w[entry[j][mine]] = 0.0
            near = np.maximum(near, B.rounded(dot / (norm * norm[j]), SIM_DIGITS))
        return picks

    def best(self, n: int) -> np.ndarray:
        """The ``n`` candidates of every document nearest to it, by (sim desc, phrase)."""
        order = np.lexsort((np.arange(len(self.doc)), -self.sim, self.doc))
        return order[B.rank_in(self.doc[order]) < n]


_CANDIDATE = "phrase string, sim double, terms array<struct<term: string, w: double>>, norm double, tn array<string>"


def tfidf_candidates(docs: DataFrame, cfg: KeyBertConfig, best: int | None = None) -> DataFrame:
    """KEY3-KEY4: (doc_id, phrase, sim, terms: array<struct<term, w>>, norm, tn)
    of every candidate, or of the ``best`` ones of each document.

    A document's words stay in its row: its n-grams are cut, made distinct and
    weighed there, each candidate's dot product and norm summed over its (at
    most ``n``) distinct terms in term order."""
    w, known = weighted_words(docs, cfg)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Candidates(batch, cfg, known)
        return c.rows(batch, None if best is None else c.best(best))

    if cfg.min_df > 1:
        return PC.counted(w, size_of(w), lambda batch: _Candidates(batch, cfg, known),
                          lambda batch, c, df: c.rows(batch, np.flatnonzero(df >= cfg.min_df)), B.typed(w, _CANDIDATE))
    return B.map_batches(w, rows, B.typed(w, _CANDIDATE))


def tfidf_mmr(docs: DataFrame, cfg: KeyBertConfig) -> DataFrame:
    """KEY2-KEY5: (doc_id, rank, phrase, sim), ``mmr_select`` over
    ``tfidf_candidates`` where the candidates are made."""
    w, known = weighted_words(docs, cfg)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Candidates(batch, cfg, known)
        picks = [c.mmr(a, b, cfg.top_k, cfg.diversity) for a, b in c.of_documents()]
        at = np.array([p for x in picks for p in x], dtype=np.int64)
        rank = np.array([i + 1 for x in picks for i in range(len(x))], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(c.doc[at])), pa.array(rank), phrase_names(c.names, c.words[at]), pa.array(c.sim[at])],
                                          ["doc_id", "rank", "phrase", "sim"])

    return B.map_batches(w, rows, B.typed(w, "rank int, phrase string, sim double"))


def term_pair_sim(a: Column, b: Column) -> Column:
    """Cosine of two sparse candidate vectors (terms sorted by term).  Pairs
    without a shared term are 0 and are settled by the native
    ``arrays_overlap`` test before any lambda runs."""
    dot = F.aggregate(a["terms"], F.lit(0.0), lambda acc, t: acc + t["w"] * F.aggregate(
        F.filter(b["terms"], lambda u: u["term"] == t["term"]), F.lit(0.0), lambda z, u: z + u["w"]))
    return F.when(F.arrays_overlap(a["tn"], b["tn"]), F.round(dot / (a["norm"] * b["norm"]), SIM_DIGITS)) \
        .otherwise(F.lit(0.0))


def dense_pair_sim(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a["vec"], b["vec"], lambda x, y: x * y), F.lit(0.0), lambda z, v: z + v)
    return F.round(dot / (a["norm"] * b["norm"]), SIM_DIGITS)


def _mmr_array(items: Column, k: int, d: float, pair_sim) -> Column:
    """MMR over an array of candidate structs sorted by name; returns the
    picks array<struct<name, sim, score>> in selection order.

    Each pick takes three aggregate steps so that nothing is recomputed:
    score every candidate once (stored in the state), take the argmax with
    native array functions, then fold the chosen item into the
    max-similarity array."""
    n = F.size(items)
    pick_t = "array<struct<name:string,sim:double,score:double>>"
    init = F.struct(
        F.array().cast("array<int>").alias("sel"),
        F.transform(items, lambda x: F.lit(0.0)).alias("ms"),
        F.array().cast(pick_t).alias("picks"),
        F.array().cast("array<double>").alias("sc"),
        F.lit(0).alias("j"), F.lit(0.0).alias("best"))

    def state(acc, **over):
        names = ("sel", "ms", "picks", "sc", "j", "best")
        return F.struct(*[(over[nm] if nm in over else acc[nm]).alias(nm) for nm in names])

    def score(acc):
        sc = F.transform(items, lambda c, i: F.when(F.array_contains(acc["sel"], i + 1), F.lit(None).cast("double"))
                         .when(F.size(acc["sel"]) == 0, c["sim"])
                         .otherwise(F.lit(1.0 - d) * c["sim"] - F.lit(d) * F.element_at(acc["ms"], i + 1)))
        return state(acc, sc=sc)

    def choose(acc):
        best = F.array_max(acc["sc"])
        return state(acc, j=F.array_position(acc["sc"], best).cast("int"), best=best)

    def fold(acc):
        chosen = F.element_at(items, acc["j"])
        new_ms = F.transform(acc["ms"], lambda m, i: F.greatest(m, pair_sim(F.element_at(items, i + 1), chosen)))
        pick = F.struct(chosen["name"].alias("name"), chosen["sim"].alias("sim"), acc["best"].alias("score"))
        return state(acc, sel=F.concat(acc["sel"], F.array(acc["j"])), ms=new_ms,
                     picks=F.concat(acc["picks"], F.array(pick)))

    steps = F.sequence(F.lit(1), F.least(F.lit(k), n) * 3)
    walk = F.aggregate(steps, init, lambda acc, s: F.when(s % 3 == 1, score(acc))
                       .when(s % 3 == 2, choose(acc)).otherwise(fold(acc)))
    return F.when(n == 0, F.array().cast(pick_t)).otherwise(walk["picks"])


def mmr_select(cands: DataFrame, k: int, d: float, item_cols: list[str], pair_sim, key: str = "doc_id",
               name: str = "phrase", sim_floor: float = 0.0, tiers=TIERS) -> DataFrame:
    """KEY5 over (key, name, sim, item_cols...): (key, rank, name, sim, score)."""
    w = Window.partitionBy(key).orderBy(F.col("sim").desc(), F.col(name))
    cands = keep(cands)
    results = []
    open_keys = None
    for m in tiers:
        if m == "relational":
            # Run the per-pick rounds only when some group is still open (the
            # tier results are persisted, so the test is cheap).
            if open_keys is None or not open_keys.isEmpty():
                results.append(_mmr_relational(cands, open_keys, k, d, item_cols, pair_sim, key, name))
            break
        # Rank per tier: the literal bound lets Spark keep only the top
        # m + 1 per document in every task before sorting (window group
        # limit); later tiers rank only the documents still open.
        part = cands if open_keys is None else cands.join(open_keys, key, "left_semi")
        part = part.withColumn("rk", F.row_number().over(w))
        if m is not None:
            part = part.where(F.col("rk") <= m + 1)
        item = F.struct(F.col(name).alias("name"), F.col("sim"), *[F.col(c) for c in item_cols])
        inside = F.col("rk") <= m if m is not None else F.lit(True)
        arrs = part.groupBy(key).agg(
            F.sort_array(F.collect_list(F.when(inside, item))).alias("items"),
            F.max(F.when(~inside, F.col("sim"))).alias("next_sim"))
        # Persisted: the next tier takes its open keys from this result.
        picked = keep(arrs.select(key, _mmr_array(F.col("items"), k, d, pair_sim).alias("picks"), "next_sim"))
        if m is None:
            results.append(picked)
            break
        bound_first = F.col("next_sim")
        bound_rest = F.lit(1.0 - d) * F.col("next_sim") - F.lit(d * sim_floor)
        # Exact when nothing lies outside the cut, or when all k picks were
        # made inside it and each beat the best score an outside candidate
        # could reach at that step.
        ok = F.col("next_sim").isNull() | ((F.size("picks") >= k) & F.forall(
            F.transform("picks", lambda p, i: F.when(i == 0, p["score"] > bound_first).otherwise(p["score"] > bound_rest)),
            lambda b: b))
        results.append(picked.where(ok))
        open_keys = picked.where(~ok).select(key)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return (out.select(key, F.posexplode("picks").alias("pos", "p"))
            .select(key, (F.col("pos") + 1).alias("rank"), F.col("p.name").alias(name),
                    F.col("p.sim").alias("sim"), F.col("p.score").alias("score")))


def _mmr_relational(cands: DataFrame, open_keys: DataFrame | None, k: int, d: float, item_cols: list[str],
                    pair_sim, key: str, name: str) -> DataFrame:
    """Exact MMR for the groups in ``open_keys`` without collecting a group:
    each of the ``k`` picks is a distributed argmax (``min_by`` on
    (-score, name), partial aggregation per task, so a group holding a third
    of all rows is spread over many tasks) followed by a join that folds the
    pick into every candidate's max similarity.  Every round is written to
    the checkpoint folder so the plan does not grow.  Returns (key, picks,
    next_sim) like the array tiers."""
    from keyforge.session import cut_lineage
    cur = cands if open_keys is None else cands.join(open_keys, key, "left_semi")
    item = F.struct(F.col(name).alias("name"), F.col("sim"), *[F.col(c) for c in item_cols])
    cur = cut_lineage(cur.select(key, item.alias("it"), F.lit(0.0).alias("ms"), F.lit(False).alias("sel")))
    picks = []
    for step in range(1, k + 1):
        sim = F.col("it.sim")
        sc = sim if step == 1 else F.lit(1.0 - d) * sim - F.lit(d) * F.col("ms")
        cand = cur.where(~F.col("sel")).select(key, "it", sc.alias("score"))
        best = cand.groupBy(key).agg(F.min_by(F.struct("it", "score"),
                                              F.struct((-F.col("score")).alias("o"), F.col("it.name").alias("n"))).alias("b"))
        chosen = cut_lineage(best.select(key, F.col("b.it").alias("ch"), F.col("b.score").alias("score")))
        picks.append(chosen.select(key, F.lit(step).alias("step"), F.struct(
            F.col("ch.name").alias("name"), F.col("ch.sim").alias("sim"), F.col("score")).alias("p")))
        j = cur.join(chosen.select(key, "ch"), key, "left")
        cur = cut_lineage(j.select(
            key, "it",
            F.when(F.col("ch").isNull(), F.col("ms")).otherwise(F.greatest("ms", pair_sim(F.col("it"), F.col("ch")))).alias("ms"),
            (F.col("sel") | (F.col("ch").isNotNull() & (F.col("it.name") == F.col("ch.name")))).alias("sel")))
    allp = picks[0]
    for p in picks[1:]:
        allp = allp.unionByName(p)
    return (allp.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "p"))).alias("s"))
            .select(key, F.col("s.p").alias("picks"), F.lit(None).cast("double").alias("next_sim")))


def ranked_keyphrases(docs: DataFrame, cfg: KeyBertConfig | None = None) -> DataFrame:
    """(doc_id, rank, phrase, sim) in KeyBERT's output order."""
    cfg = cfg or KeyBertConfig()
    if cfg.use_mmr and not cfg.use_maxsum and cfg.min_df == 1:
        return tfidf_mmr(docs, cfg)
    cands = tfidf_candidates(docs, cfg, cfg.nr_candidates if cfg.use_maxsum else None)
    if cfg.use_maxsum:
        return maxsum_select(cands, cfg.top_k, cfg.nr_candidates)
    if cfg.use_mmr:
        return mmr_select(cands, cfg.top_k, cfg.diversity, ["terms", "norm", "tn"], term_pair_sim).drop("score")
    w = Window.partitionBy("doc_id").orderBy(F.col("sim").desc(), F.col("phrase"))
    return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_k)
            .select("doc_id", "rank", "phrase", "sim"))


def maxsum_select(cands: DataFrame, top_n: int, nr_candidates: int) -> DataFrame:
    """KEY6 over TF-IDF candidates: (doc_id, rank, phrase, sim)."""
    return MS.maxsum_select(cands, top_n, nr_candidates, term_pair_sim, ["terms", "norm", "tn"])


def extract(docs: DataFrame, cfg: KeyBertConfig | None = None) -> DataFrame:
    """KEY1 ``KeyBertExtractor.extract`` for every document: (doc_id,
    keywords) in selection order, KWD5-post-processed; blank documents ``[]``."""
    cfg = cfg or KeyBertConfig()
    with scratch():
        r = ranked_keyphrases(docs, cfg)
        lists = (r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("s"))
                 .select("doc_id", postprocess(F.col("s.phrase"), cfg.lowercase, cfg.min_len, cfg.max_len,
                                               cfg.dedupe).alias("keywords")))
        return cut_lineage(docs.select("doc_id").join(lists, "doc_id", "left")
                           .select("doc_id", F.coalesce("keywords", empty_strs()).alias("keywords")))


def embedding_mmr(vectors: DataFrame, k: int = 5, d: float = 0.6, group: str = "label",
                  key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """KEY4(c) + KEY5 on a caller's vector table: per group, the group mean
    is the "document"; MMR picks ``k`` diverse members.  Cosines of dense
    vectors can be negative, so the tier bound uses floor -1.  The mean is a
    per-(group, dimension) aggregate (partial sums before the shuffle), so a
    group holding a third of the rows costs no more than any other."""
    v = vectors.select(group, F.col(key).cast("string").alias("name"),
                       F.transform(vec, lambda x: x.cast("double")).alias("vec"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda z, x: z + x * x)))
    dims = (v.select(group, F.posexplode("vec").alias("pos", "x"))
            .groupBy(group, "pos").agg(F.avg("x").alias("m")))
    mean = (dims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
            .select(group, F.col("s.m").alias("mvec")))
    mean = mean.withColumn("mnorm", F.sqrt(F.aggregate("mvec", F.lit(0.0), lambda z, x: z + x * x)))
    j = v.join(mean, group)
    sim = F.aggregate(F.zip_with("vec", "mvec", lambda x, y: x * y), F.lit(0.0), lambda z, t: z + t) / (
        F.col("norm") * F.col("mnorm"))
    c = j.select(group, "name", F.round(sim, SIM_DIGITS).alias("sim"), "vec", "norm")
    return mmr_select(c, k, d, ["vec", "norm"], dense_pair_sim, key=group, name="name", sim_floor=-1.0,
                      tiers=GROUP_TIERS)


#: Words whose vectors every task has; the others come to the documents by a join.
HEAD = 4096


def _word_vectors(docs: DataFrame, cfg: KeyBertConfig, vector_size: int, min_count: int, seed: int, partitions: int | None):
    """KEY4(b): MLlib ``Word2Vec`` trained on the corpus.  Returns (doc_id, ws,
    near): one row per id with the words of each of its texts and the vectors
    of its distinct words outside the head, and the head: its words and vectors.
    Training is spread over ``partitions`` tasks (the default parallelism), each
    round averaging their vectors, with more rounds for more partitions.  The
    word-vector table is written before it is joined; its numbers are the
    model's, which are floats."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    words = docs.select("doc_id", F.coalesce(_words(F.col("text"), cfg.stopwords), empty_strs()).alias("w"))
    partitions = partitions or docs.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=vector_size, minCount=min_count, seed=seed, numPartitions=partitions,
                     maxIter=min(partitions, MAX_ROUNDS), inputCol="w", outputCol="v").fit(words)
    vecs = model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector", "float32").alias("wv"))
    vecs = written(vecs, "word-vectors")
    texts = words.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list("w").alias("ws"))
    own = texts.select("doc_id", F.explode(F.array_distinct(F.flatten("ws"))).alias("term"))
    df_ = written(own.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "word-df")
    head = vecs.join(df_, "term").orderBy(F.col("df").desc(), "term").limit(HEAD).select("term", "wv").collect()
    # At most HEAD words: a proven size bound, so they are broadcast.
    common = docs.sparkSession.createDataFrame([(r["term"],) for r in head], "term string")
    near = (own.join(F.broadcast(common), "term", "left_anti").join(vecs, "term")
            .groupBy("doc_id").agg(F.collect_list(F.struct("term", "wv")).alias("near")))
    t = texts.join(near, "doc_id", "left").select("doc_id", "ws", F.coalesce("near", F.array().cast("array<struct<term: string, wv: array<float>>>")).alias("near"))
    return t, ({r["term"]: i for i, r in enumerate(head)}, np.array([r["wv"] for r in head], dtype=np.float32).reshape(-1, vector_size))


class _Dense:
    """KEY2 and KEY4(b) of a batch: the distinct n-grams of every document in
    phrase order; vectors are made document by document."""

    def __init__(self, batch: pa.RecordBatch, cfg: KeyBertConfig, head: tuple):
        lo, hi = cfg.ngram_range
        place, common = head
        copy_o, copies = B.parts(batch["ws"])
        tok_o, toks = B.parts(copies)
        _, own = B.parts(batch["near"])
        code, _, term_of, terms = B.numbered(pa.concat_arrays([toks, own.field("term")]))
        term = term_of[code] if len(code) else code
        self.tok, near = term[:len(toks)], term[len(toks):]
        n, self.n, self.names = max(len(terms), 1), batch.num_rows, pa.array(terms, pa.string())
        # one row more, of zeros: the places behind a phrase's end
        self.vec = np.zeros((len(terms) + 1, common.shape[1]), dtype=np.float32)
        self.has = np.zeros(len(terms) + 1, dtype=bool)
        in_head = [(i, place[x]) for i, x in enumerate(terms) if x in place]
        if in_head:
            at, source = np.array(in_head).T
            self.vec[at], self.has[at] = common[source], True
        if len(near):
            _, flat = B.parts(own.field("wv"))
            self.vec[near], self.has[near] = flat.to_numpy(zero_copy_only=False).reshape(-1, common.shape[1]), True
        copy = B.owner(tok_o)
        self.tok_doc = B.owner(copy_o)[copy]
        _, dense = np.unique(self.tok_doc * n + self.tok, return_inverse=True)
        start, first, out = np.arange(len(self.tok)), dense, []
        for sz in range(1, hi + 1):
            if sz > 1:
                last = start + sz - 1
                go = last < len(self.tok)
                go[go] = copy[last[go]] == copy[start[go]]
                start, dense, last = start[go], dense[go], last[go]
                _, dense = np.unique(dense * max(len(first), 1) + first[last], return_inverse=True)
            if sz >= lo:
                _, one = np.unique(dense, return_index=True)
                full = np.full((len(one), hi), -1, dtype=np.int64)
                for i in range(sz):
                    full[:, i] = self.tok[start[one] + i]
                out.append((self.tok_doc[start[one]], full))
        doc, words = (np.concatenate(x) for x in zip(*out, strict=True))
        some = self.has[words].any(axis=1)
        doc, words = doc[some], words[some]
        order = np.lexsort((*words.T[::-1], doc))
        self.doc, self.words = doc[order], words[order]

    def documents(self):
        """(row, places of its candidates, their similarities, vectors, norms)."""
        ends = np.searchsorted(self.doc, np.arange(self.n + 1))
        tok_ends = np.searchsorted(self.tok_doc, np.arange(self.n + 1))
        for row in range(self.n):
            a, b = ends[row], ends[row + 1]
            if a == b:
                continue
            tok = self.tok[tok_ends[row]:tok_ends[row + 1]]
            tok = tok[self.has[tok]]
            whole = self.vec[tok].astype(np.float64).mean(axis=0)
            words = self.words[a:b]
            vec = self.vec[words].astype(np.float64).sum(axis=1) / self.has[words].sum(axis=1)[:, None]
            norm = np.sqrt((vec * vec).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = B.rounded(vec @ whole / (norm * np.sqrt(whole @ whole)), SIM_DIGITS)
            good = np.isfinite(sim)
            yield row, np.arange(a, b)[good], sim[good], vec[good], norm[good]

    def phrases(self, at: np.ndarray) -> pa.Array:
        return phrase_names(self.names, self.words[at])


def _dense_mmr(sim: np.ndarray, vec: np.ndarray, norm: np.ndarray, k: int, d: float):
    """KEY5 over all candidates of a document: picks and their scores."""
    near, free, picks, scores = np.zeros(len(sim)), np.ones(len(sim), dtype=bool), [], []
    for step in range(min(k, len(sim))):
        score = sim if step == 0 else (1.0 - d) * sim - d * near
        j = int(np.argmax(np.where(free, score, -np.inf)))
        picks.append(j)
        scores.append(float(score[j]))
        free[j] = False
        near = np.maximum(near, B.rounded(vec @ vec[j] / (norm * norm[j]), SIM_DIGITS))
    return picks, scores


def word2vec_candidates(docs: DataFrame, cfg: KeyBertConfig | None = None, vector_size: int = 32,
                        min_count: int = 2, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """KEY4(b): a document and a candidate are the mean vectors of their words.
    Returns (doc_id, phrase, sim, vec, norm) for ``mmr_select`` with
    ``dense_pair_sim``."""
    cfg = cfg or KeyBertConfig()
    t, head = _word_vectors(docs, cfg, vector_size, min_count, seed, partitions)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Dense(batch, cfg, head)
        found = [*c.documents()]
        doc = np.array([r for r, at, *_ in found for _ in at], dtype=np.int64)
        at, sim, vec, norm = (np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in range(1, 5))
        lists = B.in_lists(np.full(len(at), vector_size), pa.array(vec.ravel()))
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc)), c.phrases(at.astype(np.int64)), pa.array(sim), lists, pa.array(norm)], ["doc_id", "phrase", "sim", "vec", "norm"])

    return B.map_batches(t, rows, B.typed(t, "phrase string, sim double, vec array<double>, norm double"))


def word2vec_mmr(docs: DataFrame, cfg: KeyBertConfig | None = None, k: int = 20, d: float = 0.6, vector_size: int = 32,
                 min_count: int = 2, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """KEY4(b) + KEY5: (doc_id, rank, phrase, sim, score), ``mmr_select`` over
    ``word2vec_candidates`` where the candidates are made; no vector of a
    candidate leaves its batch."""
    cfg = cfg or KeyBertConfig()
    t, head = _word_vectors(docs, cfg, vector_size, min_count, seed, partitions)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Dense(batch, cfg, head)
        out = []
        for row, at, sim, vec, norm in c.documents():
            picks, scores = _dense_mmr(sim, vec, norm, k, d)
            out += [(row, i + 1, at[p], sim[p], s) for i, (p, s) in enumerate(zip(picks, scores, strict=True))]
        row, rank, at, sim, score = zip(*out, strict=True) if out else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), c.phrases(np.array(at, dtype=np.int64)), pa.array(sim, pa.float64()), pa.array(score, pa.float64())],
            ["doc_id", "rank", "phrase", "sim", "score"])

    return B.map_batches(t, rows, B.typed(t, "rank int, phrase string, sim double, score double"))
