"""How far the sources of a language differ in their words, by wide term vectors.

Terms are maximal runs of ASCII letters and characters beyond ASCII, with A-Z lowered. A
language keeps the terms that at least ``least_docs`` of its documents hold. Each kept term
becomes one wide row: an array of its counts, indexed by the source's place in the language.
Higher-order functions turn the array into smoothed shares and those into a contribution of
the term to every ordered pair of sources; grouped sums with partial sums in the map tasks
add the contributions up.

A share is ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, N all kept occurrences of the
source, V the number of kept terms; the distance of p from q is ``floor((p - q)**2 / q)``.
All arithmetic is on 64-bit integers and exact: the division by N + V is done in three steps
of three digits, which holds up to 9 * 10**15 occurrences, and ANSI mode raises beyond that.

At scale: a task counts its terms by (language, source) and hands on sums, so that a frequent
term is one row a task and source, and the shuffle carries one wide row a term and task. No
row is larger than the number of sources; contributions are emitted for ``LEFT`` sources of
the left side and ``WIDE`` of the right at a time, a row for each source of the left side,
and summed by column. The wide rows meet their language's totals by a salted join, or a
broadcast if the groups are counted to be few. The best terms of a group are first taken in
slices of it. What the operator returns for pairs is as many rows as there are ordered pairs.

Defined results: null text, language and source count as ''; a group whose documents hold no
term has rows against all other sources; a language with one source has no pairs, one without
kept terms has pairs of value 0; repeated rows are documents of their own; an empty table
gives an empty result. Other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize, spread
from textloom.llm.pieces import tidy

#: Bytes of terms stay, A-Z as a-z; all others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it hands its counts on; bytes of a text split at a time.
HELD, SLICE = 250_000, 1 << 20
#: Sources a grouped sum spreads to columns, and of the left side in one array of rows.
WIDE, LEFT = 64, 32
#: Parts of a language in the salted join, and groups up to which their totals are broadcast.
SALTS, FEW_GROUPS = 64, 50_000


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size."""
    clean = text.translate(TERM_BYTES)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, place, term, n, docs: counts of a task's documents, summed as far as they fit."""
    names = ["lang", "place", "term", "n", "docs"]
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, place), (n, docs) in counts.items():
            found = list(n)
            for part in (found[i : i + 10_000] for i in range(0, len(found), 10_000)):
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(part)),
                        pa.array([place] * len(part), pa.int64()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    names,
                )
        counts.clear()

    with tidy(counts.clear):
        for batch in batches:
            langs, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            for key, text in zip(zip(langs, places), texts):
                n, docs = counts.get(key) or counts.setdefault(key, (Counter(), Counter()))
                own: set[bytes] = set()
                for part in terms(text.as_py()):
                    n.update(part)
                    own.update(part)
                docs.update(own)
                if own and sum(len(each) for each, _ in counts.values()) > HELD:
                    yield from handed()
        yield from handed()


def groups(docs: DataFrame) -> DataFrame:
    """lang, source, place: every group, with its source's 0-based place in the language."""
    found = docs.select("lang", "source").distinct()
    order = Window.partitionBy("lang").orderBy("source")
    return found.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def wide_vectors(docs: DataFrame, named: DataFrame, widest: int, least_docs: int) -> DataFrame:
    """lang, term, counts: kept terms, with an array of ``widest`` counts by place.

    ``docs`` has lang, place, text. The pivot to columns goes over blocks of ``WIDE`` places,
    so that neither the width of a plan nor a grouped sum grows with the number of sources.
    """
    rows = spread(docs.select("lang", "place", "text")).mapInArrow(
        _count, "lang string, place long, term string, n long, docs long"
    )
    blocks, width = -(-widest // WIDE), min(widest, WIDE)
    at = F.col("place") % WIDE
    sums = F.array(*[F.sum(F.when(at == i, F.col("n")).otherwise(0)) for i in range(width)])
    keys = ["lang", "term", F.call_function("div", F.col("place"), F.lit(WIDE)).alias("block")]
    made = rows.groupBy(*keys[: 3 if blocks > 1 else 2]).agg(F.sum("docs").alias("docs"), sums.alias("counts"))
    if blocks > 1:
        parts = F.map_from_entries(F.collect_list(F.struct("block", "counts")))
        made = made.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), parts.alias("parts"))
        none = F.array_repeat(F.lit(0).cast("long"), width)
        each = F.array(*[F.coalesce(F.try_element_at("parts", F.lit(b).cast("long")), none) for b in range(blocks)])
        made = made.withColumn("counts", F.flatten(each))
    return made.where(F.col("docs") >= least_docs).select("lang", "term", "counts")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10**9 * (count + 1) / total)``, by long division."""
    div = lambda a, b: F.call_function("div", a, b)
    rest = count + 1
    out = div(rest, total)
    for _ in range(3):
        rest = (rest % total) * 1000
        out = out * 1000 + div(rest, total)
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _totals(vectors: DataFrame, named: DataFrame) -> DataFrame:
    """lang, terms, sources, totals, whole: a language's sources by place, N + V of each and of all."""
    per = vectors.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"))
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    rows = named.join(per.withColumn("place", F.col("place").cast("long")), ["lang", "place"], "left").join(kept, "lang", "left")
    rows = rows.select("lang", "place", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    held = rows.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("place", "source", "n"))).alias("held"), F.max("terms").alias("terms"), F.sum("n").alias("all")
    )
    return held.select(
        "lang",
        "terms",
        F.transform("held", lambda h: h["source"]).alias("sources"),
        F.transform("held", lambda h: h["n"] + F.col("terms")).alias("totals"),
        (F.col("all") + F.col("terms")).alias("whole"),
    )


def _cuts(column: str, size: int) -> Column:
    """An array in pieces of ``size``."""
    starts = F.sequence(F.lit(0), F.call_function("div", F.size(column) - 1, F.lit(size)).cast("int"))
    return F.transform(starts, lambda b: F.slice(column, b * size + 1, size))


def _pairs(scored: DataFrame, totals: DataFrame, widest: int) -> DataFrame:
    """lang, source, item, value: every ordered pair of sources of a language."""
    # The outer forms: plain explode has its array computed once more, in a filter below.
    left = scored.select("lang", "p", F.posexplode_outer(_cuts("p", LEFT)).alias("above", "left"))
    both = left.select("lang", "above", "left", F.posexplode_outer(_cuts("p", WIDE)).alias("beside", "right"))
    each = F.transform("left", lambda x: F.transform("right", lambda y: distance(x, y)))
    emitted = both.select("lang", "above", "beside", F.posexplode_outer(each).alias("at", "values"))
    sums = F.array(*[F.sum(F.get("values", F.lit(k))) for k in range(min(widest, WIDE))])
    summed = emitted.groupBy("lang", "above", "beside", "at").agg(sums.alias("values"))
    i, j = F.col("above") * LEFT + F.col("at"), F.col("beside") * WIDE + F.col("place")
    summed = summed.select("lang", "above", "beside", "at", F.posexplode_outer("values").alias("place", "value"))
    sums = summed.select("lang", i.alias("i"), j.alias("j"), "value")
    ends = totals.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
    ends = ends.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    joined = ends.join(sums, ["lang", "i", "j"], "left")
    return joined.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def _terms(scored: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: a group's ``top`` terms above the language's share."""
    found = F.transform("counts", lambda n, i: F.struct(n.alias("n"), F.get("p", i).alias("p"), F.get("sources", i).alias("source")))
    above = F.filter(found, lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))
    rows = scored.select("lang", "q", F.col("term").alias("item"), F.explode_outer(above).alias("x")).where("x is not null")
    rows = rows.select("lang", F.col("x.source").alias("source"), "item", distance(F.col("x.p"), F.col("q")).alias("value"))
    # The best of each slice of a group hold the best of the group.
    sliced = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(F.desc("value"), "item")
    first = rows.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= top).drop("rank")
    return _ranked(first).where(F.col("rank") <= top)


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Part ``pair`` has, for each group, every other source of its language with the summed
    distance of the group's shares from that source's; part ``term`` the ``top`` terms that
    the group holds more often than its language, with their distance. Ranks go by value
    descending, then item ascending.
    """
    clean = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named = materialize(groups(clean))
    sizes = named.agg(F.count(F.lit(1)), F.max("place")).first()
    few, widest = sizes[0] <= FEW_GROUPS, (sizes[1] or 0) + 1
    hint = F.broadcast if few else (lambda df: df)
    placed = clean.join(hint(named), ["lang", "source"])
    vectors = materialize(wide_vectors(placed, named, widest, least_docs))
    totals = materialize(_totals(vectors, named))
    if few:
        met = vectors.join(F.broadcast(totals), "lang")
    else:
        salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
        spreaded = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = vectors.withColumn("_salt", salt).join(spreaded, ["lang", "_salt"])
    counts = F.slice("counts", 1, F.size("totals"))
    scored = met.select(
        "lang", "term", "sources", counts.alias("counts"),
        F.zip_with(counts, "totals", share).alias("p"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x), F.col("whole")).alias("q"),
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(_pairs(scored, totals, widest)).withColumn("part", F.lit("pair")).select(columns)
    return pairs.unionByName(_terms(scored, top).withColumn("part", F.lit("term")).select(columns))
