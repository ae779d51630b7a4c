"""A corpus pipeline of five stages, from raw documents to token ids.

``STAGES`` names them in order. A stage takes (spark, docs, sf_dir) and returns the frame
that is written and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.

Defined results. Null, empty and blank texts fail the quality rules and go there, as do null
texts in any later stage's own input: they stay in ``line_dedup`` and ``minhash_near_dedup``,
are never taken by ``mix_sources`` and have no ids in ``byte_bpe``. Rows with null ids are
documents of their own. Of rows with the same id, each is judged by the rules; line dedup
takes rows equal in id and text for one document; one row of each id leaves near-dedup. Very
long texts are read whole in every stage. Other columns pass untouched through the first four
stages, an empty table through all. Tables between the stages lie in the shared folder and
are deleted when the session's JVM ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.runtime import scratch, table
from textloom.llm import byte_bpe, line_dedup, mixing, near_dup, quality_rules
from textloom.llm.catalog_tokens import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host is not rejected."""
    return quality_rules.keep_passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, of 50 words or more, that an earlier place has."""
    return line_dedup.drop_repeated_lines(docs, min_words=50).withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of one document of each group of near copies: five words, similarity 0.8."""
    return near_dup.one_of_each_id(near_dup.drop_near_duplicates(docs, width=5, similarity=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each) and the hash of the decoded text."""
    both = byte_bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))
    return both.select(
        "doc_id",
        (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        F.col("packed_ids").alias("ids"),
        F.sha2("decoded", 256).alias("text_sha256"),
    )


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: Byte-pair merges are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, with a Parquet table in between."""
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
