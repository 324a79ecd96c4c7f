"""Registered queries of the llm operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from hubrisk.llm import decontaminate as D
from hubrisk.llm import fingerprints as G
from hubrisk.llm import hard_negatives as H
from hubrisk.llm import jaccard_join as J
from hubrisk.llm import licenses as L
from hubrisk.llm import lm as M
from hubrisk.llm import packing as P
from hubrisk.llm import quality_rules as Q
from hubrisk.llm import secrets as S
from hubrisk.llm import source_divergence as V
from hubrisk.llm import suffix_dedup as X
from hubrisk.llm import url_templates as U
from hubrisk.llm import warc as W
from hubrisk.llm.common import Registry, need, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    return Q.quality_rules(docs).select("doc_id", *Q.COUNTS, "base_failed", "failed_rules", "kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.secret_scan(need(table(spark, sf_dir, "documents"), "doc_id", "text")).select(*S.RESULT_NAMES)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.round_trip(need(table(spark, sf_dir, "pages"), "page_id", "url", "html"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    return D.leaks(docs, need(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = need(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")
    return U.url_filter(need(table(spark, sf_dir, "pages"), "page_id", "url"), U.table_labels(labels))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dedup(need(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    return M.lm_score(docs, (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.license_scan(need(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.jaccard_components(need(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op9_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.jaccard_links(need(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "text")
    return P.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fingerprints(need(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.mine(need(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"), H.table_label())


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.divergence(need(table(spark, sf_dir, "documents"), "text", "lang", "source"))


QUERIES: Registry = {f.__name__: f for f in (
    op1_quality_rules, op2_secret_scan, op3_warc_archive, op4_decontamination, op5_url_filters, op6_suffix_array_dedup,
    op7_lm_score, op8_license_scan, op9_ngram_jaccard_join, op9_ngram_jaccard_links,
    op10_packing, op11_document_fingerprints, op12_hard_negatives, op13_source_divergence)}

ORACLES: dict[str, str] = {"op1_quality_rules": Q.oracle_sql(), "op3_warc_archive": W.oracle_sql(),
                           "op9_ngram_jaccard_join": J.oracle_sql(), "op11_document_fingerprints": G.oracle_sql(),
                           "op12_hard_negatives": H.oracle_sql(), "op13_source_divergence": V.oracle_sql()}
