"""The stages of the pipeline together, each held against a plain version on its own input."""

from __future__ import annotations

import base64
import collections
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from keyforge.llm import mixing, quality_rules, secret_scan
from keyforge.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import exact_components


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_pipeline_end_to_end(spark, tmp_path):
    sf = str(tmp_path / "tables")
    given = table(spark, SF, "documents")
    prose = [r.text for r in given.where("length(text) > 800").orderBy("doc_id").limit(40).collect()]
    secrets = [f"{t[::-1]} password = 'hunter2{k:06d}' and AKIAABCDEFGHIJ{k:06d}" for k, t in enumerate(prose)]
    made = spark.createDataFrame([(10 ** 6 + k, t, "en", "made", len(t)) for k, t in enumerate(secrets)], given.schema)
    given.union(made).write.parquet(f"{sf}/documents.parquet")
    docs = table(spark, sf, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality_rules", "minhash_neardup", "secret_scan", "source_mixing", "byte_bpe"]
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages.append(docs)
    first, second, third, fourth, fifth = stages
    assert all(s.columns == columns for s in stages[:4])
    raw = table(spark, sf, "documents").collect()
    # quality rules: the verdict of the operator, nothing else changed
    kept = {r.doc_id for r in quality_rules.document_quality(table(spark, sf, "documents")).where("kept").collect()}
    assert counted(first.collect()) == counted(r for r in raw if r.doc_id in kept)
    # near duplicates: the smallest id of each component by brute force
    rows = [(r.doc_id, r.text) for r in first.collect()]
    least = {i for i, _, c in exact_components(rows, 5, 80) if i == c}
    assert counted(second.collect()) == counted(r for r in first.collect() if r.doc_id in least)
    # secrets: the same documents, none with a base secret left
    assert {r.doc_id for r in third.collect()} == least
    left = secret_scan.document_secrets(third).where("n_assign + n_access + n_hex > 0").count()
    found = secret_scan.document_secrets(second).where("n_assign + n_access + n_hex > 0").count()
    assert found > 0 and left == 0
    # mixing: each document as often as the operator's counts say
    size = {r.doc_id: r["size"] for r in mixing.mix(third).collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(third).collect()}
    times = collections.Counter(r.doc_id for r in fourth.collect())
    assert {i: times[i] * n for i, n in size.items()} == taken
    # tokens: as the library's, with all other columns kept
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in fourth.collect():
        ids = np.array(own.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id, r.lang, r.source, r.n_chars, ids.tobytes(), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    out = ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter((*r[:4], bytes(r[4]), *r[5:]) for r in fifth.select(*out).collect()) == want
    assert counted(corpus_pipeline.run(spark, sf).drop("token_ids").collect()) == counted(fifth.drop("token_ids").collect())
