"""BM25 ranking with idf = log10(N / df) in single precision, K = 2, B = 0.75.

The index is two frames, tf(doc_id, word, tf) and lengths(doc_id, dl), and a number.
A query filters tf by its literal terms first, so only matching documents are scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize
from textloom.functions.tokens import STRICT, Profile, counted_terms, term_frequencies, tokens
from textloom.sources.store import load, save

K, B = 2.0, 0.75
#: Terms of a query up to which they are counted in columns.
FEW_TERMS = 100


def inverse_frequencies(tf: DataFrame, documents: int) -> DataFrame:
    """word, df, idf."""
    per = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return per.withColumn("idf", F.log10(F.lit(float(documents)) / F.col("df")).cast("float"))


def lengths(tf: DataFrame) -> DataFrame:
    """doc_id, dl; documents without words have no row."""
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


@dataclass
class Bm25Index:
    """Frames of an index; ``documents`` counts all documents, with words or not."""

    tf: DataFrame
    lengths: DataFrame
    documents: int
    texts: tuple[DataFrame, Profile] | None = None

    @classmethod
    def build(cls, docs: DataFrame, profile: Profile = STRICT) -> Bm25Index:
        """Plans over ``docs``: each query tokenizes it anew, once. ``store`` does so once for all."""
        length = tokens(docs, profile).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))
        return cls(term_frequencies(docs, profile), length, docs.count(), (docs, profile))

    @classmethod
    def store(cls, docs: DataFrame, path: str, profile: Profile = STRICT) -> Bm25Index:
        """Tokenize once and write the index; terms are sorted, so that a query reads few."""
        tf = materialize(counted_terms(docs, profile))
        save(tf.select("doc_id", "word", "tf"), f"{path}/tf", "word", ranges=True)
        save(tf.where("head").select("doc_id", "dl"), f"{path}/lengths")
        save(docs.agg(F.count(F.lit(1)).alias("documents")), f"{path}/documents")
        return cls.load(docs.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(*(load(spark, f"{path}/{name}") for name in ("tf", "lengths")), load(spark, f"{path}/documents").first()[0])

    def counted(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """(doc_id, word, tf, dl of the documents with one of the terms; doc_id, dl of all).

        Texts that are not stored are read once: a row a document, with a count for each term.
        """
        if self.texts is None or not 0 < len(terms) <= FEW_TERMS:
            return self.tf.where(F.col("word").isin(terms)).join(self.lengths, "doc_id"), self.lengths
        each = [F.count_if(F.col("word") == t).alias(f"tf{i}") for i, t in enumerate(terms)]
        once = materialize(tokens(*self.texts).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"), *each))
        pairs = F.array(*[F.struct(F.lit(t).alias("word"), F.col(f"tf{i}").alias("tf")) for i, t in enumerate(terms)])
        hits = once.where("doc_id is not null").select("doc_id", "dl", F.inline(pairs)).where("tf > 0")
        return hits, once.select("doc_id", "dl")

    def query(self, text: str, k: int | None = None, case_sensitive: bool = False) -> DataFrame:
        """doc_id, score of documents that score above 0, best first.

        Terms are lowered unless ``case_sensitive``; one that is given twice counts twice. A
        term of all documents counts 0.
        """
        times = Counter(t for t in (text if case_sensitive else text.lower()).split(" ") if t)
        asked = F.create_map(*[F.lit(x) for pair in times.items() for x in pair]) if times else None
        hits, dl = self.counted(sorted(times))
        idf = inverse_frequencies(hits, self.documents)
        mean = dl.agg(F.avg("dl").alias("avgdl"))
        scored = hits.join(F.broadcast(idf), "word").join(F.broadcast(mean))
        tf = F.col("tf").cast("double")
        part = F.col("idf").cast("double") * (tf * (K + 1)) / (tf + K * (1 - B + B * F.col("dl") / F.col("avgdl")))
        weight = asked[F.col("word")] if times else F.lit(0)
        ranked = scored.groupBy("doc_id").agg(F.sum(part * weight).alias("score")).where("score > 0")
        ranked = ranked.orderBy(F.desc("score"), "doc_id")
        return ranked.limit(k) if k else ranked
