"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

Every document's set of word shingles is hashed, and documents with equal sets become one
class at once, however many they are. A class has a signature of 128 symbols of 16 bits,
each from the least value of one hash function over the set; two sets of similarity J
agree in each symbol with probability J or a little more.

The join finds all pairs of classes whose signatures differ in at most ``DISTANCE`` (47)
symbols, without fail: the 128 symbols are split into 24 chunks, so such a pair differs
in at most one symbol in some chunk (pigeonhole, 47 < 2 * 24); each chunk is entered in
an index once for each symbol that may be wrong, keyed by the others. A pair with J of 0.8
differs in 48 or more symbols with a probability of about 2e-6, so links are not lost.

From the buckets of the index come pairs to confirm, in three rounds, so that a group of
near copies does not make all its pairs:

1. every class is paired with the least class that it shares a bucket with; a pair within
   the distance is confirmed on the full sets;
2. every member of a bucket is paired with three of it, the least, the last and the one of
   the least hash, but for those that the first round has linked with the same class; then
   the components of all links are found. The three are aggregates with partial sums, so a
   bucket that very many share is nowhere sorted or gathered;
3. members of a bucket that still lie in different components are finished apart.
   Components that meet in such a bucket form crowds; signatures are compared inside a
   crowd, in blocks and across components only, and what passes is gathered to clusters of
   near signatures. A cluster is dealt to blocks of about 500, large components having
   blocks of their own, and two blocks are compared on full sets in one task. What comes
   out is links between components, not pairs of documents. After that no pair of a bucket
   is open.

A key stands for four or five symbols, 64 bits or more, and is hashed to 64, so classes that
are not alike meet in a bucket about once in 2**64 pairs of entries, and crowds do not grow
together at random.

Everything is distributed: components come from contracted partitions of a bounded number
of links, then from joins and grouped minima, not from a driver-side union-find.

Defined results: A-Z count as a-z; a null, empty or blank text has an empty set, is linked
with nothing and is its own component; a text with fewer words than a shingle has its whole
sequence as its only shingle; rows with a null id take no part in groups and are returned
with a null component, kept; rows with equal ids are one document with the union of roles:
what is linked with any of its texts is linked with it, and each row is returned, kept if
the id is its component; an empty table gives an empty result. A class has the least of its
ids as its node, so classes with the same one share a node; ``mark``, the first half of the
set's digest, tells their sets apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize, small_enough
from textloom.llm.components import connected_components
from textloom.llm.pieces import Bounded, tidy

SYMBOLS, CHUNKS = 128, 24
DISTANCE = 2 * CHUNKS - 1
#: In the third round, members of a block when sets are compared, and when signatures are.
BLOCK, CROWD = 500, 1_000
#: Ids up to which the wanted texts are picked where they are scanned; beyond it by a join.
FEW_IDS = 1_000_000
#: Hashes of words that a Python worker keeps.
KEPT = 200_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_word_hash = Bounded(lambda w: xxhash.xxh3_64_intdigest(w), KEPT)


def forget_words() -> None:
    _word_hash.clear()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    # Lower-casing and splitting bytes touches A-Z and the six ASCII spaces only.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


_rng = np.random.default_rng(20240607)
_FACTOR = (_rng.integers(0, 2**32, SYMBOLS, np.uint32) | 1)[:, None]
_SHIFT = _rng.integers(0, 2**32, SYMBOLS, np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 symbols of 16 bits of a set that is not empty."""
    low = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):  # a block of products stays in the cache
        part = _FACTOR * low[start : start + 512]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part += _SHIFT
        part ^= part >> np.uint32(13)
        part *= np.uint32(0x297A2D39)
        np.minimum(least, part.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


_BOUNDS = [SYMBOLS * c // CHUNKS for c in range(CHUNKS + 1)]


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys, ``SYMBOLS`` for each row of signatures: a chunk without one symbol."""
    keys = np.empty((len(signatures), SYMBOLS), np.uint64)
    wide = signatures.astype(np.uint64)
    for a, b in zip(_BOUNDS, _BOUNDS[1:]):
        for wrong in range(a, b):
            key = np.full(len(wide), wrong + 1, np.uint64)
            for k in range(a, b):
                if k != wrong:
                    key = key * _U(0x9E3779B97F4A7C15) + wide[:, k]
            keys[:, wrong] = _mix(key)
    return keys


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(forget_words):
            yield from signed(batches)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, signs = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                first, second = _digest(s)
                high.append(first)
                low.append(second)
                signs.append(signature(s).tobytes() if len(s) else None)
            columns = [pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tidy():
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys = index_keys(_matrix(batch.column(1))).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(ids)], ["key", "rep"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, mark_a, mark_b) whose signatures, in the next two columns, lie within the distance."""
    for batch in batches:
        if batch.num_rows:
            differ = (_matrix(batch.column(4)) != _matrix(batch.column(5))).sum(axis=1)
            near = pa.array(differ <= DISTANCE)
            yield pa.record_batch([batch.column(k).filter(near) for k in range(4)], ["a", "b", "mark_a", "mark_b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(forget_words):
            yield from hashed(batches)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sets = [shingle_set(x.as_py(), width).view(np.int64) for x in batch.column(1)]
            marks = pa.array([_digest(s)[0] for s in sets], pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([batch.column(0), marks, lists], ["rep", "mark", "shingles"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * 100 >= (len(a) + len(b) - shared) * similarity


def _across(similarity: int):
    """Links (a, b) between components of the members of two blocks (side 0 and 1), or of
    one block; one for each two components that it joins, links implied by others left out."""

    def run(members: pa.Table) -> pa.Table:
        side = members["side"].to_numpy()
        sets = [np.array(x, np.int64) for x in members["shingles"].to_pylist()]
        signs = _matrix(members["signature"].combine_chunks())
        component = members["component"].to_numpy()
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == side.max())[0]
        top = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        out = []
        for i in left:
            other = right[component[right] != component[i]]
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            other = other[small * 100 >= large * similarity]
            other = other[(signs[other] != signs[i]).sum(axis=1) <= DISTANCE]
            for j in other.tolist():
                a, b = find(int(component[i])), find(int(component[j]))
                if a != b and _similar(sets[i], sets[j], similarity):
                    top[max(a, b)] = min(a, b)
                    out.append((int(component[i]), int(component[j])))
        columns = list(zip(*out)) or [[], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], ["a", "b"])

    return run


def _near_in_crowd(crowd: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """(rep, root) of members with a near signature in another component.

    Members that are joined by such pairs have the same root.
    """
    rep, component, size, block = (crowd[k] for k in ("rep", "component", "n", "block"))
    signs = crowd["signature"]
    kinds, counts = np.unique(component, return_counts=True)
    rest = np.nonzero(component != kinds[counts.argmax()])[0]
    label, met = np.arange(len(rep)), np.zeros(len(rep), bool)
    twofold = block.min() != block.max()
    for i in rest.tolist():
        ok = (component != component[i]) & (
            np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * crowd["similarity"]
        )
        if twofold:
            ok &= block != block[i]
        other = np.nonzero(ok)[0]
        other = other[(signs[other] != signs[i]).sum(axis=1) <= DISTANCE]
        if len(other):
            met[other] = met[i] = True
            for old in np.unique(label[other]).tolist():
                if old != label[i]:
                    label[label == old] = label[i]
    # The least member is the root, so that buckets with the same members agree on it.
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, label[met], rep[met])
    return [(int(rep[i]), int(least[label[i]])) for i in np.nonzero(met)[0]]


def _near(similarity: int):
    """Rows (crowd, left, right, block, rep, component, n, signature), two blocks in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            groups = pa.compute.binary_join_element_wise(
                *[batch.column(k).cast(pa.string()) for k in range(3)], ":"
            ).to_pylist()
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0] != groups[a]:
                    yield finish(held[1:])
                    held = []
                held = held or [groups[a]]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield finish(held[1:])

    def finish(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts).combine_chunks()
        crowd = {k: table[k].to_numpy() for k in ("rep", "component", "n", "block")}
        crowd |= {"signature": _matrix(table["signature"].combine_chunks()), "similarity": similarity}
        found = list(zip(*_near_in_crowd(crowd))) or [[], []]
        return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return run


class _Confirmer:
    """Confirms candidates on signatures, then on the full sets of their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, similarity: int):
        self.docs, self.classes, self.width, self.similarity = docs, classes, width, similarity

    def sets(self, wanted: DataFrame) -> DataFrame:
        """rep, mark, shingles of all texts of the documents in ``wanted`` (doc_id), materialized."""
        wanted = small_enough(wanted.distinct(), FEW_IDS)
        texts = self.docs.join(wanted, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
        texts = texts.dropDuplicates(["doc_id", "_text"]).select("doc_id", "text")
        return materialize(texts.mapInArrow(_sets(self.width), "rep long, mark long, shingles array<long>"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` (a, b) that are similar enough."""
        side = lambda x: self.classes.select(
            F.col("rep").alias(x), F.col("h1").alias(f"mark_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sign_{x}")
        )
        fits = F.least("n_a", "n_b").cast("long") * 100 >= F.greatest("n_a", "n_b").cast("long") * self.similarity
        near = (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where(fits)
            .select("a", "b", "mark_a", "mark_b", "sign_a", "sign_b")
            .mapInArrow(_within, "a long, b long, mark_a long, mark_b long")
        )
        near = materialize(near)
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("doc_id")))
        one = lambda x: sets.toDF(x, f"mark_{x}", f"set_{x}")
        both = near.join(one("a"), ["a", "mark_a"]).join(one("b"), ["b", "mark_b"])
        # Sizes are ints: their hundredfold would overflow.
        shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - shared
        return both.where(shared * 100 >= union * self.similarity).select("a", "b").distinct()

    def links_across(self, members: DataFrame) -> DataFrame:
        """Links (a, b) between components, of members (rep, component, crowd)."""
        full = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("blocks"))
        block = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")
        signs = self.classes.select("rep", F.col("n_shingles").alias("n"), "signature")
        signed = members.join(full, "crowd").join(signs, "rep")
        signed = signed.select("crowd", "rep", "component", "n", "signature", "blocks", block).withColumn(
            "with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        )
        crowds = signed.select(
            "crowd", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block", "rep", "component", "n", "signature"
        )
        runs = crowds.repartition("crowd", "left", "right").sortWithinPartitions("crowd", "left", "right")
        near = materialize(runs.mapInArrow(_near(self.similarity), "a long, b long").distinct())
        cluster = connected_components(near).toDF("rep", "home")
        own = members.select("rep", "component").distinct().join(cluster, "rep")
        own = materialize(own)
        blocked = materialize(own.join(_block_plan(own), ["home", "component"]).select("rep", "component", "home", _block()))
        names = blocked.select("home", "block").distinct()
        owner = lambda x: F.substring_index(x, ":", 2)
        same_owner = F.col("a").contains(":own:") & (owner("a") == owner("b"))  # component:own
        two = names.withColumnRenamed("block", "a").join(names.withColumnRenamed("block", "b"), "home").where("a <= b")
        two = materialize(two.where(~same_owner).select("a", "b"))
        blocked = blocked.select("rep", "component", "block")
        whole = (
            blocked.join(self.classes.select("rep", F.col("h1").alias("mark"), "signature"), "rep")
            .join(self.sets(blocked.select(F.col("rep").alias("doc_id"))), ["rep", "mark"])
        )
        side = lambda n, at: two.join(whole.withColumnRenamed("block", at), at).select(
            "a", "b", F.lit(n).alias("side"), "component", "signature", "shingles"
        )
        sides = side(0, "a").unionByName(side(1, "b").where("a <> b"))
        return sides.groupBy("a", "b").applyInArrow(_across(self.similarity), "a long, b long").distinct()


def _block_plan(own: DataFrame) -> DataFrame:
    """home, component, large, parts: how the members of a component are dealt to blocks."""
    sizes = own.groupBy("home", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("large", F.col("n") >= BLOCK)
    rest = sizes.groupBy("home").agg(F.sum(F.when(~F.col("large"), F.col("n"))).alias("rest"))
    held = F.when(F.col("large"), F.col("n")).otherwise(F.col("rest"))
    return sizes.join(rest, "home").select("home", "component", "large", F.ceil(held / BLOCK).alias("parts"))


def _block() -> Column:
    """Large components have blocks of their own; small ones of a bucket share blocks whole."""
    own = F.concat_ws(":", "component", F.lit("own"), "home", F.pmod(F.xxhash64("rep"), F.col("parts")))
    shared = F.concat_ws(":", "home", F.lit("all"), F.pmod(F.xxhash64("component"), F.col("parts")))
    return F.when(F.col("large"), own).otherwise(shared).alias("block")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    ``similarity`` is in percent.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(
        docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, h1 long, h2 long, signature binary")
    )
    # Equal sets have equal signatures, so any of a class will do.
    classes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    classes = materialize(classes)
    # Ids with several sets, which join the classes of these.
    several = F.expr("min(h1) <> max(h1) OR min(h2) <> max(h2)").alias("several")
    many = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(several).where("several").select("doc_id")
    many = small_enough(many, FEW_IDS)
    roles = same = None
    if not many.isEmpty():
        held = signed.join(many, "doc_id", "left_semi").select("doc_id", "h1", "h2")
        roles = materialize(held.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct())
        least = roles.groupBy("doc_id").agg(F.min("rep").alias("a"))
        same = roles.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    component = _components(classes, _Confirmer(docs, classes, width, similarity), same)
    named = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "rep").alias("component_id")
    )
    met = (signed["h1"] == named["g1"]) & (signed["h2"] == named["g2"])
    whole = signed.drop("signature").join(named, met & signed["doc_id"].isNotNull(), "left")
    component_id = F.coalesce("component_id", "doc_id")
    if roles is not None:  # for their rows without a set
        of_id = roles.join(component.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id")
        of_id = of_id.agg(F.min(F.coalesce("component", "rep")).alias("of_id"))
        whole = whole.join(small_enough(of_id, FEW_IDS), "doc_id", "left")
        component_id = F.coalesce("component_id", "of_id", "doc_id")
    return whole.select(
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"),
    )


def _components(classes: DataFrame, confirm: _Confirmer, same: DataFrame | None) -> DataFrame:
    """node, component of the representatives that are linked with any other.

    ``same`` are links (a, b) of representatives that stand for the same document.
    """
    entries = classes.select("rep", "signature").mapInArrow(_index, "key long, rep long")
    # Three members of a bucket, found with partial sums, so that no task sorts a hot bucket.
    anchors = entries.groupBy("key").agg(
        F.min("rep").alias("head"),
        F.max("rep").alias("last"),
        F.min_by("rep", F.xxhash64("rep")).alias("some"),
        F.count(F.lit(1)).alias("members"),
    )
    member = entries.join(anchors.where("head <> last"), "key").where("rep <> head")
    member = materialize(member.select("rep", "head", "last", "some", "members"))
    nearest = materialize(member.groupBy("rep").agg(F.min("head").alias("a")).select("a", F.col("rep").alias("b")))
    links = materialize(confirm.links(nearest))
    root = lambda x: links.select(F.col("b").alias(x), F.col("a").alias(f"root_{x}"))
    least = nearest.select(F.col("a").alias("least"), "b")
    other = (
        member.select(F.explode(F.array_distinct(F.array("head", "last", "some"))).alias("anchor"), "rep")
        .where("anchor <> rep")
        .select(F.least("anchor", "rep").alias("a"), F.greatest("anchor", "rep").alias("b"))
        .distinct()
        .join(least, "b")
        .where("a <> least")
        .join(root("a"), "a", "left")
        .join(root("b"), "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        .select("a", "b")
    )
    links = links.unionByName(materialize(confirm.links(other)))
    if same is not None:
        links = links.unionByName(same)
    found = connected_components(links)
    # A bucket is open if a member lies in another component than the first one does.
    meet = member.where("members > 2").select("head", "rep").distinct()
    part = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    meet = meet.join(part("head"), "head", "left").join(part("rep"), "rep", "left")
    meet = materialize(
        meet.select("head", "rep", F.coalesce("of_head", "head").alias("a"), F.coalesce("of_rep", "rep").alias("b"))
    )
    crowd = connected_components(meet.where("a <> b").select("a", "b").distinct()).toDF("component", "crowd")
    members = meet.select(F.explode(F.array(F.struct(F.col("head").alias("rep"), F.col("a").alias("component")), F.struct("rep", F.col("b").alias("component")))).alias("m"))
    open_members = materialize(members.select("m.*").distinct().join(crowd, "component"))
    if open_members.isEmpty():
        return found
    more = materialize(confirm.links_across(open_members))
    # Links between components join their least nodes, so they can stand beside the first.
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but the first document of each group, with their columns.

    Rows with the same id are one document and stay or go together, see ``one_of_each_id``;
    rows with a null id stay.
    """
    gone = small_enough(near_duplicates(docs, width, similarity).where("NOT kept").select("doc_id").distinct(), FEW_IDS)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def one_of_each_id(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each id, that with the least hash of its text; rows with a null id stay."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = small_enough(ids.where("n > 1").select("doc_id"), FEW_IDS)
    if repeated.isEmpty():
        return docs
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("row")
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
