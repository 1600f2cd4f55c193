"""Registered queries: listing, pairing and concatenation of document and key
tables (SRC2, JOIN1, SRC2c, SRC2d, SET1) in table form.  Every document has a text side; key files
exist for the labelled documents only, so counts differ per dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyforge.plans.oracle_ctes import kw_raw_cte
from keyforge.plans.registry import register
from keyforge.sources import fixtures as FX
from keyforge.sources import ingest as IG
from keyforge.sources.tables import documents, table


def _sides(spark, sf):
    docs = documents(spark, sf, ("doc_id", "text", "source"))
    name = F.format_string("doc_%08d", F.col("doc_id"))
    txt = docs.select(F.col("source").alias("dataset"), name.alias("name"), "text")
    labelled = table(spark, sf, "labels").select("doc_id")
    raw = FX.kw_raw(docs).join(labelled, "doc_id", "left_semi")
    key = raw.select(F.col("dataset"), name.alias("name"), "key")
    return txt, key


SIDES_SQL = kw_raw_cte() + """,
txt AS (SELECT source AS dataset, printf('doc_%08d', doc_id) AS name, text FROM documents),
keyf AS (SELECT dataset, printf('doc_%08d', doc_id) AS name, key FROM kw_raw WHERE doc_id IN (SELECT doc_id FROM labels)),
tr AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY name) AS rn, count(*) OVER (PARTITION BY dataset) AS n_txt FROM txt),
kr AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY name) AS rn, count(*) OVER (PARTITION BY dataset) AS n_key FROM keyf)"""


@register("join1_positional_pairs", "WITH " + SIDES_SQL + """
SELECT tr.dataset, tr.rn::BIGINT AS rn, tr.name AS txt_name, kr.name AS key_name, md5(kr.key) AS key_md5
FROM tr JOIN kr USING (dataset, rn) WHERE tr.rn <= least(tr.n_txt, kr.n_key, 1000)""")
def join1_positional_pairs(spark, sf):
    txt, key = _sides(spark, sf)
    p = IG.pair_positional(txt, key, 1000)
    return p.select("dataset", F.col("rn").cast("bigint").alias("rn"), "txt_name", "key_name",
                    F.md5("key").alias("key_md5"))


@register("src2d_pair_report", "WITH " + SIDES_SQL + """,
a AS (SELECT dataset, count(*) AS n_txt FROM txt GROUP BY dataset),
b AS (SELECT dataset, count(*) AS n_key FROM keyf GROUP BY dataset)
SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(n_txt, 0) AS n_txt, coalesce(n_key, 0) AS n_key,
       least(coalesce(n_txt, 0), coalesce(n_key, 0), 1000) AS pairs,
       least(coalesce(n_txt, 0), coalesce(n_key, 0), 1000) = 0 AS skipped,
       coalesce(n_txt, 0) <> coalesce(n_key, 0) AS count_mismatch
FROM a FULL JOIN b USING (dataset)""")
def src2d_pair_report(spark, sf):
    txt, key = _sides(spark, sf)
    return IG.pair_report(txt, key, 1000)


@register("join1_stem_pairs", "WITH " + SIDES_SQL + """,
paired AS (SELECT dataset, count(*) AS n_paired FROM txt JOIN keyf USING (dataset, name) GROUP BY dataset),
um AS (SELECT dataset, count(*) AS n_unmatched FROM txt WHERE NOT EXISTS
         (SELECT 1 FROM keyf k WHERE k.dataset = txt.dataset AND k.name = txt.name) GROUP BY dataset)
SELECT coalesce(p.dataset, u.dataset) AS dataset, coalesce(n_paired, 0) AS n_paired, coalesce(n_unmatched, 0) AS n_unmatched
FROM paired p FULL JOIN um u USING (dataset)""")
def join1_stem_pairs(spark, sf):
    txt, key = _sides(spark, sf)
    paired, unmatched = IG.pair_by_stem(txt, key)
    a = paired.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_paired"))
    b = unmatched.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_unmatched"))
    j = a.join(b, "dataset", "full")
    return j.select("dataset", F.coalesce("n_paired", F.lit(0)).alias("n_paired"),
                    F.coalesce("n_unmatched", F.lit(0)).alias("n_unmatched"))


@register("src2_manifest", "WITH " + SIDES_SQL + """
SELECT tr.dataset, tr.rn::BIGINT AS rn, tr.name AS txt_name, kr.name AS key_name
FROM tr JOIN kr USING (dataset, rn) WHERE tr.rn <= 40""")
def src2_manifest(spark, sf):
    """SRC2 / SRC2c: which files are read, from their names alone."""
    txt, key = _sides(spark, sf)
    m = IG.manifest(txt.select("dataset", "name"), key.select("dataset", "name"), 40)
    return m.select("dataset", F.col("rn").cast("bigint").alias("rn"), "txt_name", "key_name")


@register("set1_concatenated", "WITH " + SIDES_SQL + """
SELECT tr.dataset, md5(tr.text) AS text_md5, md5(kr.key) AS key_md5
FROM tr JOIN kr USING (dataset, rn) WHERE tr.rn <= least(tr.n_txt, kr.n_key, 1000)""")
def set1_concatenated(spark, sf):
    """SET1: the tables of two lists of datasets (those whose names sort before
    src15, and the others), each paired by itself, as one."""
    txt, key = _sides(spark, sf)
    early = F.col("dataset") < "src15"
    parts = [IG.pair_positional(txt.where(side), key.where(side), 1000) for side in (early, ~early)]
    return IG.concatenated(*parts).select("dataset", F.md5("text").alias("text_md5"), F.md5("key").alias("key_md5"))
