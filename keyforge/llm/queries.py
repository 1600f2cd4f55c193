"""The registered queries of this package and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from keyforge.llm import (
    alignment, bpe, conversations, html_text, licences, mixing, neardup, oracles, pieces, quality_model, quality_rules, secret_scan, shards, vector_search,
)
from keyforge.llm.common import table


def op1_license_scan(spark, sf_dir):
    return licences.document_licences(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secret_scan(spark, sf_dir):
    return secret_scan.document_secrets(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    return quality_model.document_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.document_quality(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark, sf_dir):
    return shards.document_shards(table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_sentencepiece(spark, sf_dir):
    return pieces.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_html_extraction, op3_byte_bpe, op4_secret_scan, op5_quality_classifier, op6_source_mixing,
    op7_quality_rules, op8_nearest_neighbours, op9_sharding, op10_minhash_neardup, op11_sentencepiece, op12_token_alignment,
    op13_conversation_repair)} | {"pipeline": corpus_pipeline.run}
ORACLE = dict(oracles.ORACLE)
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
