"""Shuffled shards from a Feistel permutation over global row numbers.

Rows are numbered 0 to N - 1 in ascending order of ``doc_id``. A keyed permutation of
that range sends row r to p(r); the shard is ``p mod shards`` and the slot inside it
``p div shards``. So shard sizes differ by at most one row, slots have no gaps, and either
direction is computed from N and the key alone, without a stored order.

The permutation is an alternating Feistel network on a grid of ``a * b >= N`` cells with
``a * b - N < a``. Cells outside the range are left by walking the cycle: apply the
network again until the cell is below N. How many steps that takes at most is computed
from the fewer than sqrt(N) + 1 cells outside, so no row is left over.

DataFrame functions only; ids, sizes and checksums move, never texts. Defined results:
a null text has 16 bytes and the checksum of nothing; null ids come first; rows with equal
ids are ordered by size and checksum, and those equal in all three are interchangeable; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ordering import chunked_row_number, quantile_chunks
from textloom.functions.runtime import materialize

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest grid of about square shape with at least ``n`` cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _noise(x: Column, turn: Column, key: str) -> Column:
    """32 bits that depend on a half, the round and the key."""
    digest = F.md5(F.concat_ws(":", F.lit(key), turn.cast("string"), x.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def feistel(x: Column, n: int, key: str) -> Column:
    """The network's cell for cell ``x``; a bijection of the grid."""
    a, b = grid(n)

    def turn(s: Column, j: Column) -> Column:
        even = j % 2 == 0
        left = F.when(even, (s["l"] + _noise(s["r"], j, key)) % a).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + _noise(s["l"], j, key)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    turns = F.array(*[F.lit(j) for j in range(ROUNDS)])
    return F.aggregate(turns, start, turn, lambda s: s["l"] * b + s["r"])


def longest_walk(spark, n: int, key: str) -> int:
    """Steps that the slowest cell outside ``0..n-1`` needs to come inside.

    Cells that never do form cycles of their own, which no row enters; there are at most
    as many steps as cells outside.
    """
    a, b = grid(n)
    outside = a * b - n
    if n == 0 or not outside:
        return 0
    tries = min(16, outside)
    while True:
        def step(s: Column, _: Column) -> Column:
            moved = F.struct(feistel(s["x"], n, key).alias("x"), (s["k"] + 1).alias("k"))
            return F.when(s["x"] < n, s).otherwise(moved)

        start = F.struct(F.col("id").alias("x"), F.lit(0).alias("k"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, step)
        out = spark.range(n, a * b).select(walked.alias("s"))
        came = F.col("s.x") < n
        top = out.agg(F.max(F.when(came, F.col("s.k"))).alias("k"), F.bool_and(came).alias("all")).first()
        if top["all"] or tries == outside:
            return top["k"] or 0
        tries = min(2 * tries, outside)


def permute(x: Column, n: int, key: str, walk: int) -> Column:
    """Cell of row number ``x`` after the permutation of ``0..n-1``."""
    first = feistel(x, n, key)
    if not walk:
        return first
    again = lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, again)


def shard_rows(docs: DataFrame, shards: int = 40, key: str = "shuffle-1") -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for every row of ``docs``."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    slim = materialize(slim)
    n = slim.count()
    chunked = slim.withColumn("_chunk", quantile_chunks(slim, "doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    numbered = chunked_row_number(chunked, [], "_chunk", order, "row").drop("_chunk")
    placed = numbered.withColumn("_p", permute(F.col("row"), n, key, longest_walk(docs.sparkSession, n, key)))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row",
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
    )
