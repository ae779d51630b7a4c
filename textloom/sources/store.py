"""Saving and loading index frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, path: str, sort_by: str | list[str] | None = None, mode: str = "overwrite", ranges: bool = False) -> None:
    """Write an index frame, compressed; sorted in files by columns that lookups filter.

    Rows are dealt by the first of them, whose statistics of pages leave the rest of a file unread.
    ``ranges`` deals them by ranges instead, which shuffles fewer bytes, but has to sample them first
    and so computes all of ``df`` once more: for materialized frames.
    """
    keys = [sort_by] if isinstance(sort_by, str) else sort_by
    out = df
    if keys:
        out = (df.repartitionByRange(*keys) if ranges else df.repartition(keys[0])).sortWithinPartitions(*keys)
    out.write.mode(mode).option("compression", "zstd").parquet(path)


def append(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Add rows to a saved frame."""
    save(df, path, sort_by, mode="append")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
