"""Quality selection by importance resampling of hashed n-grams.

Two generative models over hashed word unigrams and bigrams are counted: the target's from
documents labelled good, the raw corpus' from all documents. A document's weight is the
ratio of its likelihoods under the two. With ``length`` it is that of a document of so many
n-grams with the same mean log ratio, so that documents of any length compare; without, it
is the plain ratio of the whole document, whose logarithm grows with its length. Adding Gumbel noise to the log
weights and taking the ``k`` largest samples documents without replacement in proportion
to their weights.

The models are one number a hash bucket, whatever the corpus' size; they are counted where
texts are scanned and added up by bucket. The target model is fitted on at most
``max_labelled`` good documents, those with the least hash of their id. The ``k`` largest
are found by numbering rows in chunks of their key, without sorting all rows in one place.

Defined results: a text without words has no weight and is never taken; a null id gets the
noise of its own kind; rows with equal ids have equal noise and are judged one by one; ties
go to the smaller id; without good labels all weights are equal; an empty table gives an
empty result; labels that are null, or of ids not in the corpus, count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.ordering import chunked_row_number, quantile_chunks
from textloom.functions.runtime import materialize
from textloom.llm.pieces import Bounded

#: Hash buckets, standard length of a document, and hashes of words that a worker keeps.
BUCKETS, LENGTH, KEPT = 65_536, 100, 200_000

_word_hash = Bounded(lambda w: xxhash.xxh3_64_intdigest(w), KEPT)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and pairs of words."""
    words = (text or "").encode("utf-8").split()
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h, pairs]) >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition: bucket, raw, target. Input: text, good."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        found = [features(text) for text in batch.column(0).to_pylist()]
        for k, rows in enumerate((found, [f for f, good in zip(found, batch.column(1).to_pylist()) if good])):
            if rows:
                totals[k] += np.bincount(np.concatenate(rows), minlength=BUCKETS)
    seen = np.nonzero(totals[0])[0]
    yield pa.record_batch(
        [pa.array(seen.astype(np.int32)), pa.array(totals[0, seen]), pa.array(totals[1, seen])],
        ["bucket", "raw", "target"],
    )


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log of the target's over the raw probability of each bucket, each plus one."""
    marked = docs.join(F.broadcast(good), docs["doc_id"] == good["_good"], "left")
    counted = marked.select("text", F.col("_good").isNotNull().alias("good")).mapInArrow(
        _count, "bucket int, raw long, target long"
    )
    model = np.ones((2, BUCKETS))
    for row in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        model[:, row[0]] += row[1:]
    if model[1].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(model[1] / model[1].sum()) - np.log(model[0] / model[0].sum())


def weigh(docs: DataFrame, ratios: np.ndarray, length: int | None = LENGTH) -> DataFrame:
    """doc_id, n_grams, log_weight (null without words) of every row; ``length`` as in
    ``resample``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([float(w[f].sum()) * (length / len(f) if length else 1.0) if len(f) else None for f in found], pa.float64()),
                ],
                ["doc_id", "n_grams", "log_weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    max_labelled: int = 20_000,
    seed: int = 11,
    length: int | None = LENGTH,
) -> DataFrame:
    """doc_id, n_grams, log_weight, rank (from 0), kept of every row of ``docs``.

    ``labels`` has doc_id and quality (1: good). ``share`` of the rows with words are kept;
    by default the share of good ones among the labelled documents. ``length`` is the number
    of n-grams to which log weights are scaled; None takes the plain ratio of likelihoods.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if share is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = known.where("quality = 1").select(F.col("doc_id").alias("_good"))
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(max_labelled)
    weighed = weigh(docs, log_ratios(docs, good), length)
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) + 0.5) / float(2**52)
    key = F.log(-F.log(unit)) - F.col("log_weight")
    weighed = materialize(weighed.withColumn("_key", key))
    worded = weighed.where("_key IS NOT NULL")
    k = round(share * worded.count())
    chunked = weighed.withColumn("_chunk", F.when(F.col("_key").isNull(), 2**20).otherwise(quantile_chunks(worded, "_key")))
    ranked = chunked_row_number(chunked, [], "_chunk", [F.col("_key"), F.col("doc_id").asc_nulls_first()], "rank")
    kept = F.col("_key").isNotNull() & (F.col("rank") < k)
    return ranked.select("doc_id", "n_grams", "log_weight", "rank", kept.alias("kept"))
