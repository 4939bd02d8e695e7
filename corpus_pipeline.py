"""A corpus pipeline: each stage reads what its predecessor wrote.

Quality rules, SimHash near-dedup, substring dedup, mixing to target weights, BPE encoding. All stages but the last
return the columns of ``documents``; the last returns each document's ids. SQL can't express SimHash and BPE, so
``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

from locushift.llm import bpe_codec, mix_sources, quality_rules, simhash_dedup, substring_dedup
from locushift.llm.catalog import tokenizer_path
from locushift.llm.common import materialize


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash_dedup.keep_one(docs)


def substrings(spark, docs, sf_dir):
    """Passages that occur elsewhere, too, are cut out of every text."""
    return substring_dedup.dedup(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them."""
    return mix_sources.mix(docs)


def encoding(spark, docs, sf_dir):
    """doc_id, ids, n_tokens and the digests of ids and decoded text."""
    return bpe_codec.encode_documents(docs, tokenizer_path(), most_pieces=100_000)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("substring dedup", substrings), ("mixing", mixing), ("bpe encoding", encoding)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
