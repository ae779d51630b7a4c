"""Streaming ingestion of documents into stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.tokens import SIMPLE, Profile, tokens
from textloom.operators.indexbuild import bucket


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, text: Parquet files that arrive in a folder."""
    reader = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_postings(docs: DataFrame, path: str, checkpoint: str, profile: Profile = SIMPLE) -> StreamingQuery:
    """Append word, doc_id rows, partitioned by bucket; a batch that is replayed overwrites
    its own folder, so each document is indexed once. Stops when all input is read."""

    def write(part: DataFrame, batch: int) -> None:
        words = tokens(part, profile).distinct()
        words = words.withColumn("bucket", bucket(words["word"]))
        words.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
