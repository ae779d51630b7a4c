"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product. Vectors are scaled by the largest norm and get one more
coordinate that completes them to norm 1; queries are scaled to norm 1 with a 0 there. Then
the largest inner product is the least Euclidean distance, which p-stable hashing serves.

``tables`` hash tables have ``width`` projections each, cut into slots; a bucket is a
combination of slots. A query visits its own bucket and, in the order of their estimated
success, ``probes - 1`` buckets with slots shifted by one: the estimate of a shift is the
squared distance of the projection from the border crossed, and sets of shifts come from a
heap in order of their sums. Candidates of all tables are merged and ranked by the exact
inner product in double precision.

Buckets are gathered in cells of about ``CELL`` vectors; a query goes once to each cell in
which it visits buckets, and brings back only its best ``k`` there. Cells that hold many
more, because vectors crowd in a few buckets, are split by vector, and their queries go to
every part; those with very many queries are split by query as well: no cap is set on a bucket. Equal vectors are indexed once, with their ``k + 1``
smallest distinct ids; further ids can never be among the best ``k``. Wherever a best ``k``
is cut off, distinct ids are counted, each with its best score.

Projections and probes are chosen for the wanted recall: at most ``ASKED`` sampled queries are
compared with all vectors in one scan, and the least number of probes is taken that meets
``wanted`` of what is really nearest, so the choice follows the size and the crowding of the
table. Where no number of probes does, all queries are compared with all vectors.

A query that finds fewer than ``k`` in its buckets is compared with all vectors, a block of
queries with a block of vectors in a task, so the result always has ``k`` rows or all there are.

Scores are inner products of the vectors as they stand, in double precision; one that is
beyond doubles is infinite.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no inner product, so each length is
searched by itself (lengths are a few numbers, fetched once); rows with equal ids are one item with
several vectors, which scores the best that is found; ties go to the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize

#: Vectors in a cell, about; queries in a block that is compared with all vectors.
CELL, BLOCK = 50_000, 2_000
#: Numbers of probes and of projections to choose from.
PROBES, WIDTHS = (4, 8, 16, 24, 32, 48, 64, 96), (6, 8, 10)
#: Queries whose real neighbours the choice is made for, and vectors that show the share visited.
ASKED, SAMPLE = 100, 4_000
_FOUND = "query_id long, vec_id long, score double"


class Hasher:
    """The tables' projections; the same for the same shape and seed."""

    def __init__(self, dimension: int, tables: int, width: int, slot: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dimension + 1, width))
        self.b = rng.random((tables, 1, width)) * slot
        self.weights = rng.integers(1, 2**63, width, np.int64).astype(np.uint64) | np.uint64(1)
        self.slot = slot

    def project(self, points: np.ndarray) -> np.ndarray:
        """(tables, points, width): projections in slots."""
        return (points @ self.a + self.b) / self.slot

    def bucket(self, table: int, slots: np.ndarray) -> np.ndarray:
        """64-bit number of a bucket, by its table and slots."""
        mixed = (slots.astype(np.int64).astype(np.uint64) * self.weights).sum(axis=-1, dtype=np.uint64)
        mixed = (mixed ^ np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(29))


def shifts(offset: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of slot shifts (-1, 0, 1), likeliest first; the first is none.

    ``offset`` is where each projection lies in its slot, from 0 to 1.
    """
    width = len(offset)
    score = np.concatenate([offset**2, (1 - offset) ** 2])
    order = np.argsort(score, kind="stable")
    cost = score[order]
    out = np.zeros((1, width), np.int64)
    rows = [out[0]]
    heap = [(cost[0], (0,))]
    while heap and len(rows) < most:
        total, chosen = heapq.heappop(heap)
        coordinate = [order[c] % width for c in chosen]
        if len({*coordinate}) == len(coordinate):
            row = np.zeros(width, np.int64)
            row[coordinate] = [1 if order[c] >= width else -1 for c in chosen]
            rows.append(row)
        last = chosen[-1]
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(rows)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows, none of them zero, scaled to norm 1 without squaring very large or small numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_DOUBLES = pa.list_(pa.float64())
_MEMBER = "cell int, query_id long, buckets array<long>, ids array<long>, embedding array<double>"
_MEMBER_ARROW = pa.schema(
    [
        ("cell", pa.int32()),
        ("query_id", pa.int64()),
        ("buckets", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int64())),
        ("embedding", _DOUBLES),
    ]
)


def _enter(hasher: Hasher, cells: int, largest: float):
    """Index rows: a vector in each table. Input: embedding, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0)) / largest
            rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
            spots = np.floor(hasher.project(np.column_stack([x, rest])))
            for t, slots in enumerate(spots):
                bucket = hasher.bucket(t, slots)
                yield pa.record_batch(
                    [
                        pa.array((bucket % np.uint64(cells)).astype(np.int32)),
                        pa.nulls(batch.num_rows, pa.int64()),
                        pa.array(bucket.view(np.int64)[:, None].tolist(), pa.list_(pa.int64())),
                        batch.column(1),
                        batch.column(0).cast(_DOUBLES),
                    ],
                    schema=_MEMBER_ARROW,
                )

    return run


def _ask(hasher: Hasher, cells: int, probes: int):
    """Query rows: a query for each cell that it visits, with the buckets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            x = np.column_stack([_unit(x), np.zeros(len(x))])
            spots = hasher.project(x)
            slots = np.floor(spots)
            out = []
            raw = batch.column(1).to_pylist()
            for i, query in enumerate(batch.column(0).to_pylist()):
                visited: dict[int, list[int]] = {}
                for t in range(len(spots)):
                    moves = shifts(spots[t, i] - slots[t, i], probes)
                    for bucket in hasher.bucket(t, slots[t, i] + moves):
                        visited.setdefault(int(bucket % np.uint64(cells)), []).append(int(bucket.view(np.int64)))
                out += [
                    {"cell": c, "query_id": query, "buckets": b, "ids": None, "embedding": raw[i]}
                    for c, b in visited.items()
                ]
            yield pa.RecordBatch.from_pylist(out, schema=_MEMBER_ARROW)

    return run


def best(query: int, q: np.ndarray, rows: np.ndarray, x: np.ndarray, ids: list, k: int) -> list[tuple]:
    """(query, id, score) of the best ``k`` distinct ids among vectors ``x[rows]``, ties by id."""
    rough = x[rows] @ q
    # One more than k, as the query itself may be among them, and all that tie; more of
    # them while vectors share ids, so that these are fewer.
    take = k + 1
    while True:
        near, edge, slack = rows, -np.inf, 0.0
        if take < len(rows):
            edge = np.partition(rough, len(rough) - take)[len(rough) - take]
            slack = 1e-9 * max(1.0, abs(edge))
            near = rows[rough >= edge - slack]
        found: dict[int, float] = {}
        for r, s in zip(near, (x[near] * q).sum(axis=1)):
            for i in ids[r]:
                if i != query and s > found.get(i, -np.inf):
                    found[i] = s
        if len(near) == len(rows) or sum(s >= edge - slack / 2 for s in found.values()) >= k:
            return [(query, i, -s) for s, i in _least(k, found)]
        take *= 2


def _least(k: int, found: dict[int, float]) -> list[tuple]:
    """(-score, id) of the best ``k`` of ids with their scores."""
    return heapq.nsmallest(k, ((-s, i) for i, s in found.items()))


def _search(k: int):
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        asked = pa.compute.is_valid(cell["query_id"])
        index, queries = cell.filter(pa.compute.invert(asked)), cell.filter(asked)
        out: list[tuple] = []
        if len(index) and len(queries):
            x = _vectors(index["embedding"].combine_chunks())
            ids = index["ids"].to_pylist()
            # A vector is here once for each table that put it into this cell.
            places: dict[bytes, int] = {}
            vector = np.fromiter((places.setdefault(v.tobytes(), len(places)) for v in x), np.int64, len(x))
            first = np.unique(vector, return_index=True)[1]
            x, ids = x[first], [ids[r] for r in first]
            bucket = index["buckets"].combine_chunks().flatten().to_numpy()
            order = np.argsort(bucket, kind="stable")
            ordered = vector[order]
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            place = dict(zip(names.tolist(), zip(starts.tolist(), ends.tolist())))
            points = _vectors(queries["embedding"].combine_chunks())
            for q, query, visits in zip(points, queries["query_id"].to_pylist(), queries["buckets"].to_pylist()):
                spans = [place[b] for b in visits if b in place]
                if spans:
                    seen = np.zeros(len(x), bool)
                    seen[np.concatenate([ordered[a:b] for a, b in spans])] = True
                    rows = np.flatnonzero(seen)
                    out += best(query, q, rows, x, ids, k)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            ["query_id", "vec_id", "score"],
        )

    return run


def _compare(k: int):
    """The best ``k`` of each query of a block among the vectors of a block."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asked = pa.compute.is_valid(block["query_id"])
        index, queries = block.filter(pa.compute.invert(asked)), block.filter(asked)
        out: list[tuple] = []
        if len(index) and len(queries):
            x, ids = _vectors(index["embedding"].combine_chunks()), index["ids"].to_pylist()
            points = _vectors(queries["embedding"].combine_chunks())
            for q, query in zip(points, queries["query_id"].to_pylist()):
                out += best(query, q, np.arange(len(x)), x, ids, k)
        columns = list(zip(*out)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    return run


def _against_all(queries: DataFrame, distinct: DataFrame, asked: int, count: int, k: int) -> DataFrame:
    """query_id, vec_id, score: ``queries`` (vec_id, embedding) against all vectors, a block
    of one against a block of the other in a task."""
    left, right = -(-asked // BLOCK), -(-count // CELL)
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = distinct.select(
        every(left).alias("q"), number("embedding", right).alias("v"), F.lit(None).cast("long").alias("query_id"), "ids", "embedding"
    )
    query = queries.select(
        number("vec_id", left).alias("q"), every(right).alias("v"), F.col("vec_id").alias("query_id"),
        F.lit(None).cast("array<long>").alias("ids"), "embedding",
    )
    return index.unionByName(query).groupBy("q", "v").applyInArrow(_compare(k), _FOUND)


def _scan(asked: list[tuple[int, list[float]]], k: int):
    """The best ``k`` of each of a few queries among a task's vectors. Input: embedding, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, float]] = {query: {} for query, _ in asked}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _vectors(batch.column(0)), batch.column(1).to_pylist()
            for query, q in asked:
                found = held[query]
                for _, i, score in best(query, np.asarray(q), np.arange(len(x)), x, ids, k):
                    found[i] = max(score, found.get(i, -np.inf))
                held[query] = {i: -s for s, i in _least(k, found)}
        out = [(query, i, s) for query, found in held.items() for i, s in found.items()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*out)) or [[], [], []]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    return run


def real_neighbours(queries: DataFrame, distinct: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, its ``k`` nearest of all vectors) for ``ASKED`` queries, those with the least hash."""
    some = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    some = [tuple(r) for r in some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).collect()]
    found = distinct.select("embedding", "ids").mapInArrow(_scan(some, k), _FOUND)
    near = F.broadcast(top_k(found, k).select("query_id", "vec_id"))  # ASKED * k rows
    named = distinct.select(F.explode("ids").alias("vec_id"), "embedding").join(near, "vec_id")
    tops: dict[int, list] = {}
    for query, vector in named.groupBy("query_id", "vec_id").agg(F.min("embedding").alias("e")).select("query_id", "e").collect():
        tops.setdefault(query, []).append(vector)
    return [(np.array(vector), np.array(tops[query])) for query, vector in some if query in tops]


def choose_probes(
    x: np.ndarray, hasher: Hasher, k: int, wanted: float,
    neighbours: list[tuple[np.ndarray, np.ndarray]] | None = None, largest: float | None = None,
) -> tuple[float, float]:
    """The least number of probes, of ``PROBES``, that find ``wanted`` of the ``neighbours`` of
    sampled queries, and the share of the sample ``x`` that is then visited; infinity and all of
    it if even the most probes do not. Without ``neighbours``, the best ``k`` within ``x`` stand for them.

    ``largest`` is the norm that vectors are scaled by, the sample's largest if not given.
    """
    if neighbours is None:
        x = x / np.abs(x).max()
        x = x[np.abs(x).max(axis=1) > 1e-100]
        neighbours = []
        for q in np.linspace(0, len(x) - 1, min(len(x), ASKED)).astype(int) if len(x) > 1 else ():
            score = x @ x[q]
            score[q] = -np.inf
            neighbours.append((x[q], x[np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]]))
    if not neighbours:
        return PROBES[0], 1.0
    largest = largest or np.linalg.norm(x, axis=1).max()

    def entered(vectors: np.ndarray) -> np.ndarray:
        """(tables, vectors): the buckets that vectors are in."""
        scaled = vectors / largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        slots = np.floor(hasher.project(np.column_stack([scaled, rest])))
        return np.stack([hasher.bucket(t, each) for t, each in enumerate(slots)])

    asked = np.stack([q for q, _ in neighbours])
    spots = hasher.project(np.column_stack([_unit(asked), np.zeros(len(asked))]))
    buckets = entered(x)
    hits, seen = np.zeros(len(PROBES)), np.zeros(len(PROBES))
    for i, (_, top) in enumerate(neighbours):
        members = np.concatenate([entered(top), buckets], axis=1)
        first = np.full(members.shape[1], PROBES[-1] + 1)  # the probe at which a vector is met
        for t in range(len(spots)):
            own = np.floor(spots[t, i])
            asks = hasher.bucket(t, own + shifts(spots[t, i] - own, PROBES[-1]))
            order = np.argsort(asks, kind="stable")
            at = np.minimum(np.searchsorted(asks[order], members[t]), len(asks) - 1)
            met = np.where(asks[order][at] == members[t], order[at] + 1, PROBES[-1] + 1)
            np.minimum(first, met, out=first)
        for n, probes in enumerate(PROBES):
            hits[n] += (first[: len(top)] <= probes).mean()
            seen[n] += (first[len(top) :] <= probes).mean()
    hits, seen = hits / len(neighbours), seen / len(neighbours)
    n = next((n for n, h in enumerate(hits) if h >= wanted), None)
    return (math.inf, 1.0) if n is None else (PROBES[n], float(seen[n]))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    e = F.col("embedding")
    sound = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` distinct ids of each query."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = 8,
    width: int | None = None,
    slot: float = 2.0,
    probes: int | None = None,
    wanted: float = 0.95,
    seed: int = 7,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query``.

    ``is_query`` is a condition on ``vec_id`` and ``embedding``. Without ``probes``, the least
    number is taken that finds ``wanted`` of the real neighbours of ``ASKED`` queries; where
    none does, every query is compared with all vectors. Without ``width``, more projections
    than the least of ``WIDTHS`` are taken if they at least halve the share of a sample of
    ``SAMPLE`` vectors that is visited.
    """
    rows = usable(vectors, vec_id, embedding)
    lengths = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())
    options = (is_query, k, tables, width, slot, probes, wanted, seed)
    found = [_nearest(rows.where(F.size("embedding") == n), n, *options) for n in lengths]
    if len(found) == 1:
        return found[0]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return top_k(reduce(DataFrame.unionByName, found, empty).drop("rank"), k)


def _nearest(
    rows: DataFrame, dimension: int, is_query: Column, k: int, tables: int, width: int | None, slot: float,
    probes: int | None, wanted: float, seed: int,
) -> DataFrame:
    """The same for vectors of one length."""
    peak = rows.agg(F.max(F.greatest(F.array_max("embedding"), -F.array_min("embedding")))).first()[0]
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + (c / peak) * (c / peak))
    largest = min(peak * math.sqrt(rows.agg(F.max(squares)).first()[0]), np.finfo(np.float64).max)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = (
        rows.dropDuplicates(["vec_id", "embedding"])
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= k + 1)
        .groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    distinct = materialize(distinct)
    count = distinct.count()
    cells = max(16, -(-count * tables // CELL))
    queries = rows.where(is_query)
    hasher = Hasher(dimension, tables, width or WIDTHS[0], slot, seed)
    if probes is None:
        sample = distinct.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
        sample, real, share = np.array([r[0] for r in sample]), real_neighbours(queries, distinct, k), None
        for w in (width,) if width else WIDTHS:
            each = Hasher(dimension, tables, w, slot, seed)
            number, seen = choose_probes(sample, each, k, wanted, real, largest)
            if number < math.inf and (share is None or seen <= share / 2):
                hasher, probes, share = each, number, seen
        if probes is None:
            asked = materialize(queries.select("vec_id", "embedding"))
            return top_k(_against_all(asked, distinct, asked.count(), count, k), k)
    index = distinct.mapInArrow(_enter(hasher, cells, largest), _MEMBER)
    asked = queries.mapInArrow(_ask(hasher, cells, probes), _MEMBER)
    # Cells with many vectors, or with many queries, are split; each part meets each other.
    size = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    split = size(index, 2 * CELL, "parts").join(size(asked, 10 * BLOCK, "turns"), "cell")
    split = F.broadcast(materialize(split))  # a row for each cell, of which there is one for CELL entries
    number = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "part", "turn", "query_id", "buckets", "ids", "embedding"]
    index = index.join(split, "cell").withColumn("part", number("embedding", "parts")).withColumn("turn", every("turns"))
    asked = asked.join(split, "cell").withColumn("part", every("parts")).withColumn("turn", number("query_id", "turns"))
    members = index.select(*columns).unionByName(asked.select(*columns))
    found = members.groupBy("cell", "part", "turn").applyInArrow(_search(k), _FOUND)
    found = materialize(top_k(found, k))
    ids = distinct.select(F.explode("ids").alias("vec_id")).distinct().limit(k + 1).count()
    least = min(k, max(0, ids - 1))
    full = found.groupBy("query_id").count().where(F.col("count") >= least).select("query_id")
    short = queries.join(full, queries["vec_id"] == full["query_id"], "left_anti")
    short = materialize(short.select("vec_id", "embedding"))
    missing = short.count()
    if not missing:
        return found
    rest = top_k(_against_all(short, distinct, missing, count, k), k)
    kept = found.join(short.select("vec_id").distinct(), found["query_id"] == short["vec_id"], "left_anti")
    return kept.unionByName(rest)
