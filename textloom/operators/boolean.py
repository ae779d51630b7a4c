"""Boolean retrieval over a normalized inverted index.

The index is ``postings(word, doc_id)``, distinct. A document set is a one-column frame
``(doc_id)``; set operators are set operations on such frames. Lookups filter postings by
literal words, which reaches Parquet when the index is stored sorted by word.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import spread
from textloom.functions.tokens import SIMPLE, Profile, document_words, tokens


class RetrievalIndex(Protocol):
    """What any boolean index offers."""

    def add(self, more: DataFrame) -> RetrievalIndex: ...
    def lookup(self, word: str) -> DataFrame: ...
    def all_of(self, *words: str) -> DataFrame: ...
    def any_of(self, *words: str) -> DataFrame: ...
    def name(self, doc_id: int) -> DataFrame: ...
    def size(self) -> DataFrame: ...


def postings(words: DataFrame) -> DataFrame:
    """word, doc_id: each pair once."""
    return words.select("word", "doc_id").distinct()


def biwords(docs: DataFrame, profile: Profile = SIMPLE) -> DataFrame:
    """word, doc_id of pairs of neighbours, as ``first second``, within a document."""
    array = spread(docs.select("doc_id", "text")).select("doc_id", profile.array(F.col("text")).alias("w"))
    pairs = F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))
    )
    return postings(array.select("doc_id", F.explode(F.array_distinct(pairs)).alias("word")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def complement(documents: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents that are not in the set."""
    return documents.select("doc_id").join(docs, "doc_id", "left_anti")


class BooleanIndex:
    """Words to document sets, over ``documents(doc_id, name)``."""

    def __init__(self, words: DataFrame, documents: DataFrame, pairs: DataFrame | None = None, case_sensitive: bool = False):
        self.postings, self.documents, self.pairs = words, documents, pairs
        self.case_sensitive = case_sensitive

    @classmethod
    def build(cls, docs: DataFrame, profile: Profile = SIMPLE, **options) -> BooleanIndex:
        """Index ``docs(doc_id, text[, name])``, with pairs of neighbours for phrases."""
        names = docs.select("doc_id", F.col("name") if "name" in docs.columns else F.col("doc_id").cast("string").alias("name"))
        return cls(postings(document_words(docs, profile)), names, biwords(docs, profile), **options)

    def _key(self, word: str) -> str:
        return word if self.case_sensitive else word.lower()

    def add(self, more: DataFrame) -> BooleanIndex:
        """The index with further (word, doc_id) rows; adding one again changes nothing."""
        return BooleanIndex(postings(self.postings.unionByName(postings(more))), self.documents, self.pairs, self.case_sensitive)

    def lookup(self, word: str) -> DataFrame:
        return self.postings.where(F.col("word") == self._key(word)).select("doc_id")

    def all_of(self, *words: str) -> DataFrame:
        """Documents with every word; none for no words."""
        return self._all(self.postings, {self._key(w) for w in words})

    @staticmethod
    def _all(words: DataFrame, wanted: set[str]) -> DataFrame:
        if not wanted:
            return words.select("doc_id").limit(0)
        hits = words.where(F.col("word").isin(sorted(wanted)))
        return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")

    def any_of(self, *words: str) -> DataFrame:
        """Documents with any of the words; none for no words."""
        return self.postings.where(F.col("word").isin(sorted({self._key(w) for w in words}))).select("doc_id").distinct()

    def none_of(self, *words: str) -> DataFrame:
        return complement(self.documents, self.any_of(*words))

    def phrase(self, text: str) -> DataFrame:
        """Documents with every pair of neighbours of the phrase; none for one word."""
        words = [self._key(w) for w in text.split(" ") if w]
        return self._all(self.pairs, {f"{a} {b}" for a, b in zip(words, words[1:])})

    def name(self, doc_id: int) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id)

    def names(self, docs: DataFrame) -> DataFrame:
        """doc_id, name of a document set."""
        return self.documents.join(docs, "doc_id", "left_semi")

    def size(self) -> DataFrame:
        """n: number of distinct words."""
        return self.postings.agg(F.count_distinct("word").alias("n"))


def fill_stats(docs: DataFrame, profile: Profile = SIMPLE) -> DataFrame:
    """doc_id, words, bytes of each document; a document without words has 0."""
    counted = tokens(docs, profile).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return sizes.join(counted, "doc_id", "left").select("doc_id", F.coalesce("words", F.lit(0)).alias("words"), "bytes")


def fill_totals(docs: DataFrame, profile: Profile = SIMPLE) -> DataFrame:
    """words, dictionary, bytes: one row over all documents."""
    words = tokens(docs, profile).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("dictionary"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))
    return counted.join(F.broadcast(size))


def nested(words: DataFrame) -> DataFrame:
    """word, doc_ids: the index with one row a word."""
    return words.groupBy("word").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
