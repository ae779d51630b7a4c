"""Connected components by contraction and alternating large and small stars.

First edges are dealt to partitions of about ``EDGES`` and each is contracted by itself: its edges become one
for each node, to the least node that it reaches inside the partition. One partition alone is
done with that, so few edges cost one task, and not rounds of shuffles with files and tasks
for each shuffle partition, however little these hold.

Several partitions go through rounds. Each points every node's larger neighbours, then the
node and its smaller neighbours, at the least node around; rounds end when nothing changes.
The number of rounds grows with the logarithm of a component's size, edges never outnumber
the first ones much, and a node with very many neighbours is only ever grouped by a minimum,
with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize
from textloom.llm.pieces import tidy

#: Edges in a partition, about.
EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition as one for each node u to the least node v that it reaches."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    with tidy():
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(top.setdefault(u, u)), find(top.setdefault(v, v))
                top[max(a, b)] = min(a, b)
        pairs = [(x, least) for x in top if (least := find(x)) != x]
        for part in (pairs[i : i + 10_000] for i in range(0, len(pairs), 10_000)):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    """``edges`` in ``parts`` partitions of about the same size, however few they came in."""
    return edges.coalesce(1) if parts == 1 else edges.repartition(parts, "u", "v")


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the links (a, b)."""
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a <> b").distinct())
    count = edges.count()
    # Edges do not grow in number, so few partitions suffice for few of them.
    parts = count // EDGES + 1
    edges = materialize(_dealt(edges, parts).mapInArrow(_contract, "u long, v long"))
    before, now = None, (count,)
    while parts > 1 and now != before:
        edges = materialize(_small_star(_large_star(edges.coalesce(parts))).coalesce(parts))
        # The set of edges is compared by its size and the combined hash of its rows.
        before, now = now, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
