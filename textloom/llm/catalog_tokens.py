"""Queries of the tokenizing operators; SQL cannot express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from textloom.functions.runtime import scratch, table
from textloom.llm import byte_bpe, token_counts, token_files


def vocabulary(name):
    """Where a vocabulary file lies."""
    return public_tokenizers.path(name)


def op3_token_files(spark, sf_dir):
    path = scratch(spark, "token-ids")
    token_files.write_token_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end=2)
    return token_files.checksums(spark, path)


def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_token_counts(spark, sf_dir, limit=512):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {"op3_token_files": op3_token_files, "op7_byte_bpe": op7_byte_bpe, "op9_token_counts": op9_token_counts}
