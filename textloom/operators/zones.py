"""Zone-weighted ranking: a word's weight in a document adds up the zones that hold it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import Profile, tokens

#: Weights of body, author and genre.
WEIGHTS = (0.2, 0.3, 0.3)


def zone_postings(docs: DataFrame, zones: list[tuple[str, Profile]]) -> DataFrame:
    """word, doc_id, zone: each once; zone k is the k-th (column, profile)."""
    frames = [tokens(docs, profile, text=column).withColumn("zone", F.lit(k)) for k, (column, profile) in enumerate(zones)]
    return reduce(DataFrame.unionByName, frames).select("word", "doc_id", "zone").distinct()


def weighted(zoned: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """word, doc_id, weight: added in single precision, in the order of zones."""
    total = F.lit(0).cast("float")
    for k, w in enumerate(weights):
        total = total + F.when(F.bool_or(F.col("zone") == k), F.lit(w).cast("float")).otherwise(F.lit(0).cast("float"))
    return zoned.groupBy("word", "doc_id").agg(total.alias("weight"))


def rank(zoned: DataFrame, word: str, weights: tuple[float, ...] = WEIGHTS, case_sensitive: bool = False) -> DataFrame:
    """doc_id, weight of the documents with the word, heaviest first; the word is lowered
    unless ``case_sensitive``."""
    word = word if case_sensitive else word.lower()
    hits = weighted(zoned.where(F.col("word") == word), weights)
    return hits.select("doc_id", "weight").orderBy(F.desc("weight"), "doc_id")


def bits(zoned: DataFrame, zones: int) -> DataFrame:
    """word, doc_id, zones (array<boolean>): the nested view."""
    has = [F.bool_or(F.col("zone") == k) for k in range(zones)]
    return zoned.groupBy("word", "doc_id").agg(F.array(*has).alias("zones"))
