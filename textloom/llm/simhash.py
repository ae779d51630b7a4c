"""SimHash fingerprints of 64 bits, and components of those that differ in few bits.

A document's shingles, repeats included, are hashed; a bit of its fingerprint is set if more
than half of the hashes have it. Equal fingerprints are one from then on. The table of pivots
holds each fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints. Distances
differ by no more than the fingerprints do, so a pair whose rows in the table differ by more
than ``bits`` anywhere is discarded, and what survives is verified on the fingerprints.

Pairs are not looked for everywhere: of ``bits + 2`` blocks, ``bits`` differing bits leave two
alone at least, so fingerprints meet in the places named by each two blocks. A place with more
than ``CROWD`` members is cut into cells along the distances to four pivots; a cell also takes
those of the next one that are within ``bits`` of it, so that each pair still meets.

At scale: texts are read once and whole, in slices of words, and only ids and fingerprints are
shuffled. A place is searched from member to member through those not yet reached, and hands on
one link for each member reached, never all pairs; a group of many near copies is reached from
its first members. Rows of a hot fingerprint meet its class by a broadcast, of all classes if
they are counted to be few, else of the hot ones alone.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a
text of fewer words than a shingle has is one shingle. Repeated rows are documents of their
own, also such with the same id; rows with a null id have the least id they reach, or null if
there is none. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize, small_enough, spread
from textloom.llm.components import connected_components
from textloom.llm.pieces import tidy

#: Seed of the hashes, and reference fingerprints.
SEED, PIVOTS = 42, 32
#: Bytes of a text split at a time.
SLICE = 1 << 20
#: Members of a place before it is cut; pivots of a cut, their cells' width, and cuts one after another.
CROWD, CUT, WIDTH, CUTS = 20_000, 4, 8, 3
#: Classes that are broadcast, and rows from which a fingerprint is hot.
FEW_CLASSES, HOT = 1_000_000, 1_000_000

REFERENCES = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(PIVOTS)], np.uint64)


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lowered, in lists of a bounded size."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    hashed = xxhash.xxh64_intdigest
    set_bits, n, last = np.zeros(64, np.int64), 0, []
    for part in _parts(text or b""):
        ws = last + part
        if len(ws) >= width:
            hashes = [hashed(b" ".join(s), SEED) for s in zip(*[ws[i:] for i in range(width)])]
            n += len(hashes)
            for i in range(0, len(hashes), 1 << 15):
                octets = np.array(hashes[i : i + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
                set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            ws = ws[len(ws) - width + 1 :]
        last = ws
    if n == 0:
        return hashed(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                made = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64)
                yield pa.record_batch([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    narrow = spread(docs.select("doc_id", "text"))
    return narrow.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distances(fps: np.ndarray) -> np.ndarray:
    """Rows of the table of pivots."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES).astype(np.int8)


def search(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a place of distinct fingerprints that join all its members that are linked."""
    if len(fps) == 2:
        close = np.abs(distances(fps[:1]) - distances(fps[1:])).max() <= bits and np.bitwise_count(fps[0] ^ fps[1]) <= bits
        return (fps[:1], fps[1:]) if close else (fps[:0], fps[:0])
    near = distances(fps)
    order = np.argsort(near[:, 0], kind="stable")
    fps, near = fps[order], near[order]
    first = near[:, 0].astype(np.int64)
    starts, ends = np.searchsorted(first, first - bits), np.searchsorted(first, first + bits, "right")
    left = np.ones(len(fps), bool)
    a, b = [], []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        waiting = [seed]
        while waiting:
            x = waiting.pop()
            found = starts[x] + np.flatnonzero(left[starts[x] : ends[x]])
            for j in range(1, PIVOTS, 8):
                found = found[np.abs(near[found, j : j + 8] - near[x, j : j + 8]).max(axis=1, initial=0) <= bits]
            found = found[np.bitwise_count(fps[found] ^ fps[x]) <= bits]
            if len(found):
                left[found] = False
                waiting.extend(found.tolist())
                a.append(np.full(len(found), fps[x]))
                b.append(fps[found])
    if not a:
        return fps[:0], fps[:0]
    return np.concatenate(a), np.concatenate(b)


def _cells(batches: Iterator[pa.RecordBatch], level: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Members of crowded places, once for each cell that they belong to."""
    chosen = slice(level * CUT, (level + 1) * CUT)
    with tidy():
        for batch in batches:
            which, masked, cell, fp = (c.to_numpy() for c in batch.columns)
            near = distances(fp.view(np.uint64))[:, chosen].astype(np.int64)
            for both in range(1 << CUT):
                down = np.array([both >> j & 1 for j in range(CUT)])
                # A member also goes to the cell below if that one's members can be within bits.
                takes = ((near % WIDTH < bits) | (down == 0)).all(axis=1)
                at = near // WIDTH - down
                code = cell
                for j in range(CUT):
                    code = code * 16 + at[:, j] + 2
                columns = [pa.array(c[takes]) for c in (which, masked, code, fp)]
                yield pa.record_batch(columns, ["which", "masked", "cell", "fp"])


def places(fps: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """which, masked, cell, fp: distinct fingerprints by the places where they can meet."""
    edges = [64 * i // (bits + 2) for i in range(bits + 3)]
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = np.array([x | y for x, y in combinations(blocks, 2)], np.uint64).view(np.int64).tolist()
    each = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for i, m in enumerate(masks)])
    rows = fps.select(F.inline(each), "fp").select("which", "masked", F.lit(0).cast("long").alias("cell"), "fp")
    for level in range(CUTS):
        keys = ["which", "masked", "cell"]
        crowded = materialize(rows.groupBy(*keys).count().where(F.col("count") > crowd).select(*keys))
        if crowded.isEmpty():
            break
        crowded = small_enough(crowded, 100_000)
        cut = rows.join(crowded, keys, "left_semi").mapInArrow(
            lambda batches, level=level: _cells(batches, level, bits), "which int, masked long, cell long, fp long"
        )
        rows = materialize(rows.join(crowded, keys, "left_anti").unionByName(cut))
    return rows


def links(fps: DataFrame, bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints that join all within ``bits`` of one another."""
    if not 0 <= bits < WIDTH:
        raise ValueError(f"bits must be from 0 to {WIDTH - 1}")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last place's members; more may follow
        key = None

        def handed(a: list, b: list) -> pa.RecordBatch:
            both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.record_batch([pa.array(x) for x in both], ["a", "b"])

        with tidy():
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:3]], axis=1)
                fp = batch.column(3).to_numpy().view(np.uint64)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                a, b = [], []
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                    now = tuple(keys[start].tolist())
                    if now != key:
                        whole = np.concatenate(held) if held else fp[:0]
                        if len(whole) > 1:
                            x, y = search(whole, bits)
                            a.append(x), b.append(y)
                        held, key = [], now
                    held.append(fp[start:end].copy())
                yield handed(a, b)
            whole = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if len(whole) > 1:
                x, y = search(whole, bits)
                yield handed([x], [y])

    keys = ["which", "masked", "cell"]
    met = places(fps, bits, crowd).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(found, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable) of every document."""
    rows = materialize(fingerprints(docs, width))
    same = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = connected_components(links(same.select("fp"), bits)).select(F.col("node").alias("fp"), "component")
    linked = materialize(same.join(joined, "fp").select("fp", "component", "least"))
    tops = small_enough(linked.groupBy("component").agg(F.min("least").alias("top")), FEW_CLASSES)
    reached = linked.join(tops, "component").select("fp", "top")
    classes = materialize(
        same.join(reached, "fp", "left").select(F.col("fp"), F.coalesce("top", "least").alias("component_id"), "n")
    )
    if classes.count() <= FEW_CLASSES:
        out = rows.join(F.broadcast(classes.drop("n")), "fp")
    else:
        hot = small_enough(classes.where(F.col("n") > HOT).drop("n"), FEW_CLASSES)
        rest = rows.join(hot.select("fp"), "fp", "left_anti").join(classes.where(F.col("n") <= HOT).drop("n"), "fp")
        out = rows.join(hot, "fp").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
