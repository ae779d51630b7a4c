"""BM25 top-k for tables of queries, with block maxima that leave most postings unread.

Documents are dealt to blocks by ranges of their ids. The index stores a row a document, of which
the tf parts of words and the largest part of each asked word in each block are made. Of a query, the sum of its words'
maxima bounds every score in a block. The blocks with the largest bounds are scored first;
the k-th score found there is a threshold, and blocks whose bound lies below it are never
scored. Ties at the threshold are scored, so results equal those of a full scan.

Any number of queries is one plan: of many terms, a hot word is joined by (word, block), which splits it.
Bounds are one row for each query and block that holds one of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from textloom.functions.runtime import materialize, small_enough
from textloom.functions.tokens import STRICT, Profile, counted_documents
from textloom.operators.bm25 import B, K, inverse_frequencies
from textloom.operators.vectors import DENSE, FEW_TERMS, ROWS, Few, gathered, terms
from textloom.sources.store import load, save

#: Ids in a block, and digits of a score; what differs less counts as a tie.
BLOCK, DIGITS = 64, 6


def parsed(queries: DataFrame, query_id: str, text: str, case_sensitive: bool = False) -> DataFrame:
    """query_id, word, times: the terms of each query; null and empty queries have none."""
    asked = F.col(text) if case_sensitive else F.lower(text)
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(F.split(asked, " ")).alias("word")).where("word <> ''")
    return words.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class BlockMaxIndex:
    """Frames documents(doc_id, words, tfs, dl, block) and words(word, idf), and the mean length.

    ``postings`` (word, block, doc_id, part) and ``blocks`` (word, block, top) are made of the stored documents.
    """

    documents: DataFrame
    words: DataFrame
    mean: float

    @classmethod
    def store(cls, docs: DataFrame, path: str, profile: Profile = STRICT) -> BlockMaxIndex:
        """Tokenize ``docs`` (doc_id, an integer, and text) once and write the index, a row a document."""
        save(counted_documents(docs, profile), f"{path}/documents")
        rows = load(docs.sparkSession, f"{path}/documents").select(F.explode("words").alias("word"))
        save(inverse_frequencies(rows, docs.count()).select("word", "idf"), f"{path}/words", "word")
        return cls.load(docs.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockMaxIndex:
        length = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        rows = load(spark, f"{path}/documents").withColumn("dl", length)
        mean = rows.agg(F.avg("dl")).first()[0] or 1.0
        rows = rows.where("doc_id is not null").withColumn("block", F.floor(F.col("doc_id") / BLOCK))
        return cls(rows, load(spark, f"{path}/words"), mean)

    @property
    def postings(self) -> DataFrame:
        n = F.col("pair.tfs").cast("double")
        part = n * (K + 1) / (n + K * (1 - B + B * F.col("dl") / F.lit(self.mean)))
        pairs = self.documents.select("block", "doc_id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("pair"))
        return pairs.select(F.col("pair.words").alias("word"), "block", "doc_id", part.alias("part"))

    @property
    def blocks(self) -> DataFrame:
        return self.postings.groupBy("word", "block").agg(F.max("part").alias("top"))

    def weighted(self, terms: DataFrame) -> DataFrame:
        """query_id, word, weight: what a tf part of the word counts in the query."""
        return terms.join(self.words, "word").select("query_id", "word", (F.col("times") * F.col("idf").cast("double")).alias("weight"))

    def bounds(self, weighted: DataFrame) -> DataFrame:
        """query_id, block, bound: no document of the block scores more."""
        # Only words that are asked for are shuffled.
        asked = self.postings.join(small_enough(weighted.select("word").distinct(), FEW_TERMS), "word", "left_semi")
        tops = asked.groupBy("word", "block").agg(F.max("part").alias("top"))
        found = weighted.join(tops, "word").groupBy("query_id", "block")
        # A little above, as sums in another order may differ in their last digits.
        return found.agg((F.sum(F.col("weight") * F.col("top")) * (1 + 1e-9) + 10.0**-DIGITS).alias("bound"))

    def scored(self, weighted: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score above 0, of the ``wanted`` (query_id, block): the ``k`` best of each query at least.

        Queries of up to ``FEW_TERMS`` terms are sent to all tasks and scored where a document lies, of
        which only what may be among the best is handed on. More are joined with postings.
        """
        if weighted.count() > FEW_TERMS:
            asked = weighted.join(wanted.select("query_id", "block"), "query_id")
            parts = asked.join(self.postings, ["word", "block"])
            score: Column = F.round(F.sum(F.col("weight") * F.col("part")), DIGITS)
            return parts.groupBy("query_id", "doc_id").agg(score.alias("score")).where("score > 0")
        spark, mean = weighted.sparkSession, self.mean
        held = gathered(weighted.withColumnRenamed("query_id", "doc_id")).toArrow()
        ids, *lists = (pa.chunked_array(c.chunks, c.type).combine_chunks() for c in held.columns)
        few = spark.sparkContext.broadcast(Few(ids, lists, None))
        asked = wanted.groupBy("block").agg(F.collect_list("query_id").alias("asked"))
        # A row for each block, with a number for each wanted pair.
        asked = F.broadcast(asked) if wanted.count() <= FEW_TERMS else asked
        rows = self.documents.join(asked, "block").select("doc_id", "words", "tfs", "dl", "asked")
        own = self.documents.schema["doc_id"].dataType

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = few.value
            m = len(queries.ids)
            step = max(1, min(ROWS, DENSE // max(m, queries.dense, 1)))
            for batch in batches:
                for lo in range(0, len(batch), step):
                    doc, words, tfs, dl, asked = batch.slice(lo, step).columns
                    of, found, n = terms(words, tfs, None)
                    part = n * (K + 1) / (n + K * (1 - B + B * dl.to_numpy()[of] / mean))
                    at = pc.index_in(found, queries.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
                    score = queries.dots(of, at, part, len(doc))
                    open_ = np.zeros(score.shape, bool)
                    query = pc.index_in(asked.flatten(), queries.ids).to_numpy()
                    open_[np.repeat(np.arange(len(doc)), pc.list_value_length(asked).to_numpy()), query] = True
                    score[~open_] = 0
                    # What differs less than digits are rounded may tie.
                    least = np.partition(score, len(doc) - k, axis=0)[len(doc) - k] if k < len(doc) else np.zeros(m)
                    row, query = np.nonzero((score > 0) & (score >= least - 2 * 10.0**-DIGITS))
                    yield pa.record_batch([queries.ids.take(pa.array(query)), doc.take(pa.array(row)), pa.array(score[row, query])], ["query_id", "doc_id", "score"])

        made = StructType().add("query_id", weighted.schema["query_id"].dataType).add("doc_id", own).add("score", DoubleType())
        return rows.mapInArrow(best, made).withColumn("score", F.round("score", DIGITS)).where("score > 0")

    def search(self, terms: DataFrame, k: int = 10, first: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, score, rank of the k best; query_id, block of the blocks scored).

        ``terms`` as from ``parsed``. ``first`` blocks a query are scored for its threshold.
        """
        weighted = materialize(self.weighted(terms))
        bounds = materialize(self.bounds(weighted))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        seeds = bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= (first or k)).select("query_id", "block")
        seeds = materialize(seeds)
        early = materialize(_best(self.scored(weighted, seeds, k), k))
        reached = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(reached, "query_id", "left").where("least is null or bound >= least").select("query_id", "block")
        rest = materialize(rest.join(seeds, ["query_id", "block"], "left_anti"))
        # A document lies in one block, so no pair is scored twice.
        late = self.scored(weighted, rest, k)
        return _best(early.drop("rank").unionByName(late), k), seeds.unionByName(rest)
