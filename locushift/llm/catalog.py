"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe_codec, byte_bpe, dual_tree_kmeans, html_extract, mix_sources, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, url_filter, weighted_fingerprint
from .common import table
from .oracles import ORACLES


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_weighted_fingerprints(spark, sf_dir):
    return weighted_fingerprint.report(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark, sf_dir):
    return simhash_dedup.report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op5_url_filters(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_mix_sources(spark, sf_dir):
    return mix_sources.report(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op7_bpe_codec(spark, sf_dir):
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op9_html_extract(spark, sf_dir):
    return html_extract.report(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_dual_tree_clusters(spark, sf_dir):
    return dual_tree_kmeans.report(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark, sf_dir):
    from public_tokenizers import PATTERN

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), PATTERN, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_weighted_fingerprints, op2_simhash_dedup, op3_quality_classifier, op4_quality_rules, op5_url_filters, op6_mix_sources, op7_bpe_codec, op8_substring_dedup, op9_html_extract, op10_suffix_dedup, op11_dual_tree_clusters, op12_byte_bpe)}

__all__ = ["ORACLES", "QUERIES"]
