"""Batched index build: word ids, buckets by first letter, postings, statistics, lookup.

What the build leaves to Spark is sorting, partial aggregation, spilling and merging:
postings are one grouped aggregate. Batches remain as an operator of their own, since
their shape can be observed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.ordering import chunked_row_number
from textloom.functions.runtime import materialize, parts
from textloom.functions.tokens import LATIN, Profile, distinct_words

#: Last letters of the buckets, and bytes of a batch and of a big file.
BUCKETS = (("a", "d"), ("e", "g"), ("h", "p"), ("q", "z"))
BATCH_BYTES, BIG_BYTES = 150_000_000, 50_000_000
#: Range of document ids of a stored posting block.
BLOCK_IDS = 1 << 18


def bucket_names() -> list[str]:
    return [f"{a}-{z}" for a, z in BUCKETS]


def bucket_of(word: str) -> str:
    """The bucket of a literal word, for pruning; the first one for other letters."""
    letter = word[:1].lower()
    return next((f"{a}-{z}" for a, z in BUCKETS if a <= letter <= z), bucket_names()[0])


def bucket(word: Column) -> Column:
    """The bucket of a word by its first letter."""
    letter = F.lower(F.substring(word, 1, 1))
    out = None
    for (a, z), name in zip(BUCKETS, bucket_names()):
        hit = letter.between(a, z)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(bucket_names()[0])


def batches(files: DataFrame, batch_bytes: int = BATCH_BYTES, big_bytes: int = BIG_BYTES) -> DataFrame:
    """doc_id, bytes, big, batch of files (doc_id, bytes): small batches are numbered first.

    A batch takes files in order of id until it has ``batch_bytes``; big files are batched
    apart. Where a batch ends depends on all files before, so each of the two lists is one
    stream of narrow rows, read in order with two numbers of state.
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, big = 0, 0, None
        for part in rows:
            out = []
            for size, is_big in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if is_big != big:
                    held, number, big = 0, 0, is_big
                out.append(number)
                held += size
                if held >= batch_bytes:
                    held, number = 0, number + 1
            yield pa.record_batch([*part.columns, pa.array(out, pa.int64())], ["doc_id", "bytes", "big", "batch"])

    sized = files.select("doc_id", "bytes", (F.col("bytes") >= big_bytes).alias("big"))
    streams = sized.repartition(2, "big").sortWithinPartitions("big", "doc_id")
    numbered = streams.mapInArrow(cut, "doc_id long, bytes long, big boolean, batch long")
    smalls = numbered.where("NOT big").agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("first_big"))
    number = F.col("batch") + F.when(F.col("big"), F.col("first_big")).otherwise(F.lit(0))
    return numbered.join(F.broadcast(smalls)).select("doc_id", "bytes", "big", number.alias("batch"))


def lexicon(words: DataFrame) -> DataFrame:
    """word, word_id: dense ids from 1 in order of the words."""
    distinct = materialize(words.select("word").distinct().withColumn("_chunk", F.substring("word", 1, 2)))
    numbered = chunked_row_number(distinct, [], "_chunk", [F.col("word")], "word_id")
    return numbered.select("word", (F.col("word_id") + 1).alias("word_id"))


def inverted(words: DataFrame) -> DataFrame:
    """word, bucket, df, doc_ids: ascending distinct documents of each word."""
    grouped = words.groupBy("word").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    return grouped.select("word", bucket(F.col("word")).alias("bucket"), F.size("doc_ids").cast("long").alias("df"), "doc_ids")


def batch_words(docs: DataFrame, batched: DataFrame, profile: Profile = LATIN, key: str = "batch") -> DataFrame:
    """word, doc_id, batch: each distinct word of each text, and its text's batch.

    Texts are dealt by ``key`` into parts of a bounded number of bytes before they are cut: they
    are far fewer and smaller than their words, and what is grouped by it and more stays there.
    """
    texts = docs.select("doc_id", "text")
    met = texts.join(batched.select("doc_id", "batch"), "doc_id")
    n = parts(texts)
    met = met.repartition(key) if n is None else met.repartition(n, key)
    return met.select(F.explode(distinct_words(profile)).alias("word"), "doc_id", "batch")


def build_stats(docs: DataFrame, words: DataFrame, batched: DataFrame) -> DataFrame:
    """kilobytes, batches, mapped (posting rows of all batches), unique_words: one row.

    ``words`` as from ``batch_words``.
    """
    in_batch = words.groupBy("word", "batch").agg(F.lit(1).alias("one"))
    per_word = in_batch.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    mapped = per_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mapped"), F.count(F.lit(1)).alias("unique_words"))
    size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))
    whole = docs.agg(F.floor(size / 1000).cast("long").alias("kilobytes"))
    made = batched.agg(F.count_distinct("batch").alias("batches"))
    return whole.join(F.broadcast(made)).join(F.broadcast(mapped))


def posting_blocks(words: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """word, bucket, block, df, doc_ids: ascending distinct documents of a word in a range of
    ``block_ids`` ids. However many documents a word has, no row has more."""
    block = F.floor(F.col("doc_id") / block_ids).cast("long").alias("block")
    grouped = words.groupBy("word", block).agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    return grouped.select("word", bucket(F.col("word")).alias("bucket"), "block", F.size("doc_ids").cast("long").alias("df"), "doc_ids")


@dataclass
class StoredIndex:
    """An index on disk: ``files``, ``lexicon``, ``postings`` in blocks, partitioned by
    bucket, and ``log``, one row about the build."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame, path: str, profile: Profile = LATIN) -> StoredIndex:
        """Tokenize ``docs(doc_id, text[, name])`` once and write the tables."""
        began = time.monotonic()
        sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
        batched = materialize(batches(sizes))
        words = materialize(batch_words(docs, batched, profile, "doc_id"))
        mapped = time.monotonic()
        names = docs.select("doc_id", F.col("name") if "name" in docs.columns else F.col("doc_id").cast("string").alias("name"))
        names.write.mode("overwrite").parquet(f"{path}/files")
        # Lists have far fewer rows than words: ids and ranges are taken from them.
        blocks = materialize(posting_blocks(words))
        ids = materialize(lexicon(blocks))
        ids.sort("word").write.mode("overwrite").parquet(f"{path}/lexicon")
        lists = blocks.join(ids, "word")
        # Sorted by word in each bucket, so that statistics prune row groups.
        spread = lists.repartitionByRange("bucket", "word").sortWithinPartitions("bucket", "word")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        log = build_stats(docs, words, batched)
        took = {"map_seconds": mapped - began, "reduce_seconds": time.monotonic() - mapped}
        log.withColumns({k: F.lit(round(v, 3)) for k, v in took.items()}).write.mode("overwrite").parquet(f"{path}/log")
        return cls(docs.sparkSession, path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def query(self, word: str, case_sensitive: bool = False) -> DataFrame:
        """doc_id, name of the documents with a word; only the word's bucket is opened."""
        word = word if case_sensitive else word.lower()
        hit = self.read("postings").where((F.col("bucket") == bucket_of(word)) & (F.col("word") == word))
        return self.read("files").join(hit.select(F.explode("doc_ids").alias("doc_id")), "doc_id", "left_semi")


def segments(words: DataFrame) -> DataFrame:
    """batch, bucket, word, doc_ids: what each batch spills to each bucket.

    ``words`` as from ``batch_words``.
    """
    return words.groupBy("batch", bucket(F.col("word")).alias("bucket"), "word").agg(
        F.sort_array(F.collect_set("doc_id")).alias("doc_ids")
    )


def merge(spilled: DataFrame) -> DataFrame:
    """bucket, word, doc_ids: segments of all batches merged."""
    return spilled.groupBy("bucket", "word").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids")
    )
