"""Registered queries against their DuckDB oracle on the smallest tables."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from keyforge.sources.tables import TABLES
from tests.conftest import SF

FAST = ["kw_raw_fixture", "txt1_clean_text", "txt3_to_keywords", "kwd2_normalize_kw_string", "kwd5_postprocess",
        "agg1_f1_keywords", "agg4_rouge_scores", "prs4_parse_answer", "prm4_prm5_refine_prompt", "chk1_word_chunks",
        "spl1_exact_split", "enc2_enc3_enc4_encode", "enc5_collate", "join1_positional_pairs", "yak1_yake_extract",
        "trk1_textrank_extract", "key1_key5_keybert_mmr", "ref1_refine"]


def norm(v):
    if isinstance(v, float):
        return f"{v:.6f}" if not math.isnan(v) else "NaN"
    return "NULL" if v is None else str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns) == digest(drows, dcols)


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert len(qs) >= 60
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.count() == 5
