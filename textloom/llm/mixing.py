"""Mixing sources to target weights by systematic sampling.

The targets share the corpus' words among the sources by weight; a source gets at most
``max_copies`` times what it has, and the excess goes to the others by weight. Since the
capped sources are those with the smallest size for their weight, the final shares come
from prefix sums over sources in that order, without iterating.

Each document of a source expects ``target / source size`` copies. Documents are laid out
along their source in order of size, the expected copies are added up from the start, one
random offset per source is added, and a document is emitted once for each integer that
its stretch contains. The order by size keeps a source's words near its target: whatever
the offset, they differ by less than the largest document's size times a small factor.

The prefix sum over equal steps is the row number times the step, and row numbers come
from (source, size class, spread) chunks, so a source with a third of all rows is not
numbered in one task. DataFrame functions only; texts are not shuffled for the plan.

Defined results: a null text has size 0; a document or source of size 0 takes nothing;
null sources are one source and come last; rows with equal ids count as documents of their
own; those that tie in size and id are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.ordering import chunked_row_number
from textloom.functions.runtime import fresh, materialize, small_enough
from textloom.llm.text import word_count

#: Chunks of equal size class into which a source's rows are spread.
SPREAD = 256
#: Rows of a plan, of some 60 bytes each, up to which it is sent to all tasks.
FEW_ROWS = 300_000


def _offset(source: Column, seed: str) -> Column:
    """The source's offset in [0, 1): 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0


def size_class(size: Column, doc_id: Column) -> Column:
    """Chunk number: sizes in classes of a 16th of a power of two, spread by id inside."""
    spread = F.floor(F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(2147483648)) * 2654435761, F.lit(4294967296)) / (4294967296 // SPREAD))
    return (F.floor(F.log2(size + 1.0) * 16) * SPREAD + spread).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """source, source_size, target: one row a source.

    ``weights`` are dealt to the sources in code-point order, repeating, null last.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(everything) - 1) % len(weights) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    # Smallest cap for its weight first; ties do not matter, as both are capped or neither.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("heavy"),
    )
    # The level at which this source and those after it are filled.
    per = per.withColumn("level", F.col("left") / F.col("heavy"))
    per = per.withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "level")))
    per = per.withColumn("final", level.over(whole)["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix-1", max_copies: int = 3, **options) -> DataFrame:
    """The columns of ``docs`` named doc_id and source, with size, source_size, target, copies."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return _copies(materialize(slim), seed, max_copies, **options)


def _copies(slim: DataFrame, seed: str, max_copies: int, **options) -> DataFrame:
    share = targets(slim, max_copies=max_copies, **options).withColumnRenamed("source", "_s")
    chunked = slim.withColumn("_chunk", size_class(F.col("size"), F.col("doc_id")))
    order = [F.col("size"), F.col("doc_id").asc_nulls_first()]
    numbered = chunked_row_number(chunked, ["source"], "_chunk", order, "_row").drop("_chunk")
    joined = numbered.join(share, numbered["source"].eqNullSafe(share["_s"])).drop("_s")
    step = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    at = joined.withColumn("_step", step).withColumn("_u", _offset(F.col("source"), seed))
    crossed = F.floor((F.col("_row") + 1) * F.col("_step") + F.col("_u")) - F.floor(F.col("_row") * F.col("_step") + F.col("_u"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(crossed, F.lit(max_copies)))
    return at.withColumn("copies", copies.cast("long")).drop("_row", "_step", "_u")


def mix_documents(docs: DataFrame, max_copies: int = 3, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    The plan is joined back by id, source and size. It holds no texts; a plan of few rows is
    sent to all tasks, so that texts stay where they are scanned, and a larger one is joined
    by a shuffle. Rows that share all three may get different numbers of copies: these rows
    alone are put in order of a hash of their text and dealt what the plan takes of them.
    """
    names = ["doc_id", "source", "size", "rows", "times", "own", "copy", *(f"least_{c}" for c in range(1, max_copies + 1))]
    name = {n: fresh(docs, f"_of_{n}") for n in names}
    at_least = [F.col(name[f"least_{c}"]) for c in range(1, max_copies + 1)]
    keys = [F.col(c).alias(name[c]) for c in ("doc_id", "source", "size")]
    some = [F.count_if(F.col("copies") >= c).alias(name[f"least_{c}"]) for c in range(1, max_copies + 1)]
    plan = plan_mix(docs, max_copies=max_copies, **options).groupBy(*keys)
    plan = materialize(plan.agg(F.count(F.lit(1)).alias(name["rows"]), *some).where(at_least[0] > 0))
    single = F.col(name["rows"]) == 1
    once = plan.where(single).select(*[name[c] for c in ("doc_id", "source", "size")], sum(at_least).cast("int").alias(name["times"]))
    often = plan.where(~single)
    size = fresh(docs, "_words")
    whole = docs.withColumn(size, word_count(F.col("text")))

    def same(side: DataFrame) -> Column:
        ids = whole["doc_id"].eqNullSafe(side[name["doc_id"]]) & whole["source"].eqNullSafe(side[name["source"]])
        return ids & (whole[size] == side[name["size"]])

    def repeat(rows: DataFrame) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(1), F.col(name["times"])))
        return rows.withColumn(name["copy"], copies).select(*[whole[c] for c in docs.columns])

    once = small_enough(once, FEW_ROWS)
    taken = repeat(whole.join(once, same(once)))
    if often.isEmpty():
        return taken
    often = small_enough(often, FEW_ROWS)
    order = Window.partitionBy(*[name[c] for c in ("doc_id", "source", "size")]).orderBy(F.xxhash64(whole["text"]))
    dealt = whole.join(often, same(often)).withColumn(name["own"], F.row_number().over(order))
    dealt = dealt.withColumn(name["times"], sum((F.col(name["own"]) <= c).cast("int") for c in at_least))
    return taken.unionByName(repeat(dealt.where(F.col(name["times"]) > 0)))
