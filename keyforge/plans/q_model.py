"""Registered queries: splits and batches (SPL*), model-input encoding
(ENC*), split sizes and token accounting (AGG8-AGG10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.functions import prompts as PR
from keyforge.functions import text as T
from keyforge.operators import encode as EN
from keyforge.operators import metrics as M
from keyforge.operators import splits as S
from keyforge.plans import duck as D
from keyforge.plans import oracle_ctes as O
from keyforge.plans.oracle_ctes import gold_cte, kw_pairs_cte
from keyforge.plans.registry import register
from keyforge.session import written
from keyforge.sources import fixtures as FX
from keyforge.sources.tables import by_doc, documents

SEED = 42


def dataset(spark, sf):
    """The prepared dataset: cleaned text + keyword list, rows without
    keywords dropped (TXT1, TXT3, FLT1)."""
    raw = FX.kw_raw(by_doc(documents(spark, sf, ("doc_id", "text", "source"))))
    ds = raw.select("doc_id", T.clean_text(F.col("text")).alias("text"), T.to_keywords(F.col("key")).alias("keywords"))
    return ds.where(F.size("keywords") > 0)


DATASET_SQL = gold_cte() + f""",
ds AS (SELECT g.doc_id, {D.clean_text('k.text')} AS text, g.ref AS keywords
       FROM gold g JOIN kw_raw k USING (doc_id) WHERE len(g.ref) > 0)"""

HASH = "md5(CAST(doc_id AS VARCHAR) || ':' || '42')"


def _ranked_sql(src: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {HASH}, doc_id) AS rn, count(*) OVER () AS n FROM {src}"


@register("spl1_exact_split", "WITH " + DATASET_SQL + f""",
r AS ({_ranked_sql('ds')})
SELECT doc_id, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train'
                    WHEN rn <= n - ceil(0.5 * ceil(0.2 * n)) THEN 'validation' ELSE 'test' END AS split
FROM r""")
def spl1_exact_split(spark, sf):
    return S.three_way_split(dataset(spark, sf).select("doc_id"), seed=SEED)


@register("spl1_hash_split", f"""
WITH h AS (SELECT doc_id, {HASH} AS hx FROM documents),
u AS (SELECT doc_id, list_reduce(list_transform(string_split(substr(hx, 1, 8), ''),
        lambda c: strpos('0123456789abcdef', c) - 1)::BIGINT[], lambda a, b: a * 16 + b)::DOUBLE / 4294967296.0 AS u FROM h)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u""")
def spl1_hash_split(spark, sf):
    return S.hash_split(documents(spark, sf, ("doc_id",)), seed=SEED).select("doc_id", "split")


@register("spl2_two_step_split", "WITH " + DATASET_SQL + f""",
r AS ({_ranked_sql('ds')})
SELECT doc_id, CASE WHEN rn <= (n - ceil(0.2 * n)) - ceil(0.1 * (n - ceil(0.2 * n))) THEN 'train'
                    WHEN rn <= n - ceil(0.2 * n) THEN 'valid' ELSE 'test' END AS split
FROM r""")
def spl2_two_step_split(spark, sf):
    return S.three_way_split(dataset(spark, sf).select("doc_id"), seed=SEED, test_size=0.2, second=0.1,
                             names=("train", "valid", "test"), second_from="train")


@register("agg8_split_sizes", "WITH " + DATASET_SQL + f""",
r AS ({_ranked_sql('ds')}),
s AS (SELECT CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train'
                  WHEN rn <= n - ceil(0.5 * ceil(0.2 * n)) THEN 'validation' ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n FROM s GROUP BY split""")
def agg8_split_sizes(spark, sf):
    return M.split_sizes(S.three_way_split(dataset(spark, sf).select("doc_id"), seed=SEED))


@register("spl3_spl4_batches", f"""
WITH r AS ({_ranked_sql('(SELECT doc_id FROM documents)')}),
b AS (SELECT doc_id, (rn - 1) // 64 AS batch_id, n FROM r)
SELECT doc_id, batch_id::BIGINT AS batch_id FROM b WHERE batch_id < n // 64 AND batch_id = 3""")
def spl3_spl4_batches(spark, sf):
    b = S.batches(documents(spark, sf, ("doc_id",)), 64, seed=SEED)
    return S.select_batch(b, 3).select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("spl3_batch_count", f"""
WITH r AS ({_ranked_sql('(SELECT doc_id FROM documents)')}),
b AS (SELECT doc_id, (rn - 1) // 64 AS batch_id, n FROM r)
SELECT batch_id::BIGINT AS batch_id, count(*) AS n_rows FROM b WHERE batch_id < n // 64 GROUP BY batch_id""")
def spl3_batch_count(spark, sf):
    b = S.batches(documents(spark, sf, ("doc_id",)), 64, seed=SEED)
    return b.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("spl5_caps", "WITH " + DATASET_SQL + f""",
r AS ({_ranked_sql('ds')}),
s AS (SELECT doc_id, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train'
                  WHEN rn <= n - ceil(0.5 * ceil(0.2 * n)) THEN 'validation' ELSE 'test' END AS split FROM r)
SELECT doc_id, split FROM s
QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= CASE WHEN split = 'train' THEN 300 ELSE 40 END""")
def spl5_caps(spark, sf):
    s = S.three_way_split(dataset(spark, sf).select("doc_id"), seed=SEED)
    return S.cap_per_group(s, {"train": 300, "validation": 40, "test": 40})


@register("spl5_first_n", """
SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 200""")
def spl5_first_n(spark, sf):
    return S.first_n(documents(spark, sf, ("doc_id", "lang")), 200)


@register("spl6_inference_batches", f"""
WITH r AS ({_ranked_sql('(SELECT doc_id FROM documents)')})
SELECT (rn - 1) // 16 AS batch_id, count(*) AS n_rows FROM r GROUP BY ALL""")
def spl6_inference_batches(spark, sf):
    b = S.batches(documents(spark, sf, ("doc_id",)), 16, seed=SEED, drop_remainder=False)
    return b.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- encoding ------------------------------------------------------------

VOCAB_SQL = """
voc_c AS (SELECT term, count(*) AS cnt FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term),
vocab AS (SELECT term, (row_number() OVER (ORDER BY cnt DESC, term) + 2)::INT AS id FROM voc_c)"""


def _vocab(spark, sf):
    return EN.build_vocab(documents(spark, sf), "text")


def encode_sql(name: str, src: str, col: str, max_len: int | None) -> str:
    cut = f"WHERE pos < {max_len}" if max_len is not None else ""
    return f"""
{name}_t AS (SELECT doc_id, unnest(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+')) AS term,
                    unnest(range(len(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+')))) AS pos FROM {src}),
{name}_j AS (SELECT t.doc_id, t.pos, coalesce(v.id, 2) AS id FROM {name}_t t LEFT JOIN vocab v USING (term) {cut}),
{name}_a AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM {name}_j GROUP BY doc_id),
{name} AS (SELECT s.doc_id, coalesce(a.ids, []::INT[]) AS ids FROM {src} s LEFT JOIN {name}_a a USING (doc_id))"""


def ids_str(c: str) -> str:
    return f"array_to_string({c}, ' ')"


def _ids(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@register("enc1_vocabulary", "WITH " + VOCAB_SQL + " SELECT term, id FROM vocab")
def enc1_vocabulary(spark, sf):
    return _vocab(spark, sf)


PAIRS_SQL = DATASET_SQL + f""",
pairs AS (SELECT doc_id, {D.q(PR.SEQ2SEQ_PREFIX)} || {D.strip("coalesce(text, '')")} AS input_text,
                 array_to_string(list_filter(list_transform(keywords, lambda ka: {D.strip('ka')}), lambda kb: kb <> ''), '; ') AS target_text
          FROM ds),""" + VOCAB_SQL + "," + encode_sql("src", "pairs", "input_text", 1024) + "," + encode_sql("tgt", "pairs", "target_text", 128)


def _pairs(spark, sf):
    """Written once: both sides are read twice, by their words and by their distinct words."""
    inp, tgt = PR.seq2seq_pair(F.col("text"), F.col("keywords"))
    return written(dataset(spark, sf).select("doc_id", inp.alias("input_text"), tgt.alias("target_text"), F.size("keywords").alias("n_kw")), "pairs")


def _pairs_encoded(spark, sf, pairs=None):
    pairs = _pairs(spark, sf) if pairs is None else pairs
    vocab = _vocab(spark, sf)
    src = EN.encode(pairs, "input_text", vocab, max_len=1024, out="input_ids")
    tgt_ids = EN.encode(pairs, "target_text", vocab, max_len=128, out="label_ids")
    return src.join(tgt_ids, "doc_id")


def _batched(e, size: int):
    """``e`` in batches of the seeded order.  Its rows are written first, since
    both the ranks of its ids and the batches are made of them."""
    return S.batches(written(e, "encoded"), size, seed=SEED, drop_remainder=False)


@register("enc2_enc3_enc4_encode", "WITH " + PAIRS_SQL + f""",
lab AS (SELECT doc_id, CASE WHEN len(ids) = 0 OR ids[-1] <> 1 THEN list_append(ids, 1) ELSE ids END AS l FROM tgt)
SELECT s.doc_id, len(s.ids)::BIGINT AS n_input, {ids_str('s.ids')} AS input_ids,
       {ids_str('list_transform(l, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels
FROM src s JOIN lab USING (doc_id)""")
def enc2_enc3_enc4_encode(spark, sf):
    e = _pairs_encoded(spark, sf)
    labels = EN.mask_pad_labels(EN.append_eos(F.col("label_ids")))
    return e.select("doc_id", F.size("input_ids").cast("bigint").alias("n_input"), _ids("input_ids").alias("input_ids"),
                    F.array_join(labels.cast("array<string>"), " ").alias("labels"))


def _batch_sql(bs: int) -> str:
    return f"""
rb AS (SELECT doc_id, (row_number() OVER (ORDER BY {HASH}, doc_id) - 1) // {bs} AS batch_id FROM ds)"""


@register("enc5_collate", "WITH " + PAIRS_SQL + "," + _batch_sql(8) + f""",
lab AS (SELECT doc_id, CASE WHEN len(ids) = 0 OR ids[-1] <> 1 THEN list_append(ids, 1) ELSE ids END AS l FROM tgt),
j AS (SELECT s.doc_id, b.batch_id, s.ids, lab.l FROM src s JOIN lab USING (doc_id) JOIN rb b USING (doc_id)),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m, max(len(l)) OVER (PARTITION BY batch_id) AS ml FROM j)
SELECT doc_id, batch_id::BIGINT AS batch_id,
  {ids_str('list_concat(ids, list_transform(range(m - len(ids)), lambda z: 0))')} AS input_ids,
  {ids_str('list_concat(list_transform(range(len(ids)), lambda z: 1), list_transform(range(m - len(ids)), lambda z: 0))')} AS attention_mask,
  {ids_str('list_transform(list_concat(l, list_transform(range(ml - len(l)), lambda z: 0)), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels
FROM w""")
def enc5_collate(spark, sf):
    e = _pairs_encoded(spark, sf).select("doc_id", "input_ids", EN.append_eos(F.col("label_ids")).alias("labels"))
    b = _batched(e, 8)
    c = EN.collate(b, "batch_id", "input_ids", "labels")
    return c.select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"), _ids("input_ids").alias("input_ids"),
                    _ids("attention_mask").alias("attention_mask"), _ids("labels").alias("labels"))


def _width_sql(longest: str, mult: int = 8) -> str:
    return f"(CASE WHEN {longest} % {mult} = 0 THEN {longest} ELSE (({longest} + {mult - 1}) // {mult}) * {mult} END)"


# Prompt-completion rows: prompt (PRM2), target labels, full text (PRM6) and
# tagged prompt (PRM7), tokenised with the word vocabulary.
CHAT_SQL = DATASET_SQL + f""",
ex AS (SELECT doc_id, {D.q(PR.SYSTEM_PREAMBLE + chr(10) + chr(10) + 'DOCUMENT:' + chr(10))} || {D.strip("coalesce(text, '')")}
            || chr(10) || chr(10) || {D.q(PR.RESPONSE_TAG)} AS p, array_to_string(keywords, '; ') AS t FROM ds),
ex2 AS (SELECT doc_id, p || (CASE WHEN t <> '' AND NOT ends_with(p, ' ') THEN ' ' ELSE '' END) || t || ' </s>' AS full_text,
               CASE WHEN ends_with({D.strip('p')}, {D.q(PR.RESPONSE_TAG)}) THEN p
                    ELSE regexp_replace(p, {D.q(f'[{T.WS}]+$')}, '') || ' ' || {D.q(PR.RESPONSE_TAG)} END AS tagged
        FROM ex),""" + VOCAB_SQL + "," + encode_sql("fe", "ex2", "full_text", 2048) + "," + encode_sql("te", "ex2", "tagged", 2048) + "," + _batch_sql(4)


def _chat_encoded(spark, sf):
    ds = dataset(spark, sf)
    p, t = PR.chat_example(F.col("text"), F.col("keywords"))
    ex = ds.select("doc_id", p.alias("p"), t.alias("t"))
    ex2 = written(ex.select("doc_id", PR.training_text(F.col("p"), F.col("t"), eos=" </s>").alias("full_text"),
                            PR.tagged_prompt(F.col("p")).alias("tagged")), "prompts")
    vocab = _vocab(spark, sf)
    fe = EN.encode(ex2, "full_text", vocab, max_len=2048, out="ids")
    te = EN.encode(ex2, "tagged", vocab, max_len=2048, out="tag_ids")
    return fe.join(te, "doc_id")


@register("enc6_enc7_prompt_mask", "WITH " + CHAT_SQL + f""",
j AS (SELECT f.doc_id, b.batch_id, f.ids, len(t.ids) AS tag_len FROM fe f JOIN te t USING (doc_id) JOIN rb b USING (doc_id)),
w AS (SELECT *, {_width_sql('max(len(ids)) OVER (PARTITION BY batch_id)')} AS width FROM j),
p AS (SELECT doc_id, batch_id, list_concat(ids, list_transform(range(width - len(ids)), lambda z: 0)) AS pids,
             least(tag_len, width) AS tag_len, len(ids) AS seq_len FROM w)
SELECT doc_id, batch_id::BIGINT AS batch_id, {ids_str('pids')} AS input_ids,
  {ids_str('list_transform(pids, lambda x, i: CASE WHEN i - 1 >= tag_len AND i - 1 < seq_len THEN x ELSE -100 END)')} AS labels,
  seq_len::BIGINT AS total_tokens,
  len(list_filter(list_transform(pids, lambda x, i: CASE WHEN i - 1 >= tag_len AND i - 1 < seq_len THEN x ELSE -100 END), lambda y: y <> -100))::BIGINT AS supervised_tokens
FROM p""")
def enc6_enc7_prompt_mask(spark, sf):
    e = _chat_encoded(spark, sf)
    b = _batched(e.select("doc_id", "ids", F.size("tag_ids").alias("tag_len"), F.size("ids").alias("seq_len")), 4)
    p = EN.pad_batch(b, "batch_id", "ids", 2048, 8)
    p = p.withColumn("tag_len", F.least(F.col("tag_len"), F.size("ids")))
    lab = EN.prompt_mask_labels(F.col("ids"), F.col("tag_len"), F.col("seq_len"))
    out = p.select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"), _ids("ids").alias("input_ids"),
                   lab.alias("labels"), F.col("seq_len").cast("bigint").alias("total_tokens"))
    return out.select("doc_id", "batch_id", "input_ids", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
                      "total_tokens", M.supervised_tokens("labels").cast("bigint").alias("supervised_tokens"))


@register("enc8_pretokenized", "WITH " + PAIRS_SQL + "," + _batch_sql(8) + f""",
j AS (SELECT s.doc_id, b.batch_id, s.ids AS ids,
             CASE WHEN len(d.keywords) >= 8 THEN t.ids ELSE NULL END AS lab
      FROM src s JOIN tgt t USING (doc_id) JOIN rb b USING (doc_id) JOIN ds d USING (doc_id)),
k AS (SELECT *, coalesce(lab, list_transform(range(len(ids)), lambda z: -100)) AS lab2 FROM j),
w AS (SELECT *, {_width_sql('max(len(ids[1:2048])) OVER (PARTITION BY batch_id)')} AS in_w,
                {_width_sql('max(len(lab2[1:2048])) OVER (PARTITION BY batch_id)')} AS lab_w FROM k),
p AS (SELECT doc_id, batch_id, list_concat(ids[1:2048], list_transform(range(greatest(in_w - len(ids[1:2048]), 0)), lambda z: 0)) AS pin,
             list_concat(lab2[1:2048], list_transform(range(greatest(lab_w - len(lab2[1:2048]), 0)), lambda z: -100)) AS plab, in_w, lab_w FROM w)
SELECT doc_id, batch_id::BIGINT AS batch_id, {ids_str('pin')} AS input_ids,
  {ids_str('list_transform(pin, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)')} AS attention_mask,
  {ids_str('CASE WHEN lab_w < in_w THEN list_concat(plab, list_transform(range(in_w - lab_w), lambda z: -100)) ELSE plab[1:in_w] END')} AS labels
FROM p""")
def enc8_pretokenized(spark, sf):
    pairs = _pairs(spark, sf)
    e = _pairs_encoded(spark, sf, pairs)
    e = e.join(pairs.select("doc_id", "n_kw"), "doc_id").withColumn("labels", F.when(F.col("n_kw") >= 8, F.col("label_ids")))
    b = _batched(e, 8)
    ids, mask, lab = EN.fit_labels("input_ids", "labels", "batch_id", 2048, 8)
    return b.select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"),
                    F.array_join(ids.cast("array<string>"), " ").alias("input_ids"),
                    F.array_join(mask.cast("array<string>"), " ").alias("attention_mask"),
                    F.array_join(lab.cast("array<string>"), " ").alias("labels"))


@register("enc9_apply_all_splits", "WITH " + PAIRS_SQL + f""",
r AS ({_ranked_sql('ds')}),
sp AS (SELECT doc_id, CASE WHEN rn <= n - ceil(0.2 * n) THEN 'train'
                  WHEN rn <= n - ceil(0.5 * ceil(0.2 * n)) THEN 'validation' ELSE 'test' END AS split FROM r)
SELECT sp.split, count(*) AS n_rows, sum(len(s.ids))::BIGINT AS input_tokens,
       sum(len(CASE WHEN len(t.ids) = 0 OR t.ids[-1] <> 1 THEN list_append(t.ids, 1) ELSE t.ids END))::BIGINT AS label_tokens
FROM sp JOIN src s USING (doc_id) JOIN tgt t USING (doc_id) GROUP BY sp.split""")
def enc9_apply_all_splits(spark, sf):
    """ENC9 ``apply``: format -> tokenise over every split at once (one table
    with a ``split`` column), source columns dropped."""
    e = _pairs_encoded(spark, sf)
    sp = S.three_way_split(dataset(spark, sf).select("doc_id"), seed=SEED)
    t = e.join(sp, "doc_id").select("split", "input_ids", EN.append_eos(F.col("label_ids")).alias("labels"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum(F.size("input_ids")).cast("bigint").alias("input_tokens"),
                                  F.sum(F.size("labels")).cast("bigint").alias("label_tokens"))


@register("agg9_notebook_metrics", "WITH " + PAIRS_SQL + "," + _batch_sql(8) + "," + kw_pairs_cte(with_gold=False) + f""",
j AS (SELECT s.doc_id, b.batch_id, s.ids FROM src s JOIN rb b USING (doc_id)),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM j),
g AS (SELECT avg(len(list_filter(list_concat(ids, list_transform(range(m - len(ids)), lambda z: 0)), lambda x: x <> 0))) AS gen_len FROM w),
t AS (SELECT {O.rouge_tokens('pred')} AS pt,
             {O.rouge_tokens('ref')} AS rt FROM kw_pairs),
r AS (SELECT avg({O.rouge1('pt', 'rt')}) AS r1,
             avg({O.rougeL('pt', 'rt')}) AS rl FROM t)
SELECT round_even(r1 * 100, 4) AS rouge1, round_even(rl * 100, 4) AS rougeL, round_even(gen_len, 4) AS gen_len FROM r, g""")
def agg9_notebook_metrics(spark, sf):
    """AGG9 ``compute_metrics``: ROUGE x 100 and the mean non-pad length of
    the padded id rows, rounded half-even to 4 places."""
    e = _pairs_encoded(spark, sf).select("doc_id", "input_ids", F.array().cast("array<int>").alias("labels"))
    b = _batched(e, 8)
    c = EN.collate(b, "batch_id", "input_ids", "labels")
    g = c.agg(F.avg(M.generated_length("input_ids")).alias("gen_len"))
    pairs = FX.kw_pairs(by_doc(documents(spark, sf, ("doc_id", "text", "source"))))
    r = M.rouge_per_doc(pairs, use_stemmer=False).agg(F.avg("rouge1").alias("r1"), F.avg("rougeL").alias("rl"))
    # Two one-row aggregates, joined on a constant key.
    both = r.withColumn("_k", F.lit(1)).join(g.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.bround(F.col("r1") * 100, 4).alias("rouge1"), F.bround(F.col("rl") * 100, 4).alias("rougeL"),
                       F.bround("gen_len", 4).alias("gen_len"))
