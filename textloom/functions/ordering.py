"""Row numbers over a total order without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_row_number(
    df: DataFrame, groups: list[str], chunk: str, order: list[Column], name: str
) -> DataFrame:
    """Add ``name``: the row's 0-based position in its group, in order of (chunk, *order).

    Only the rows of one (group, chunk) are sorted together; the numbers of rows before a
    chunk come from prefix sums over the counts of chunks, one row for each. The caller
    picks chunks so that none holds more than a small share of the rows. ``df`` is read
    twice and should be materialized. Nulls in ``groups`` and ``chunk`` form own groups.
    Rows that tie in ``order`` are numbered in any order.
    """
    keys = [*groups, chunk]
    within = Window.partitionBy(*keys).orderBy(*order)
    before = Window.partitionBy(*groups).orderBy(F.col(chunk).asc_nulls_first())
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.sum("_rows").over(before) - F.col("_rows"))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_start")
    )
    numbered = df.withColumn(name, F.row_number().over(within) - 1)
    same = F.lit(True)
    for k in keys:
        same = same & numbered[k].eqNullSafe(starts[f"_of_{k}"])
    return (
        numbered.join(starts, same)
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_start", *[f"_of_{k}" for k in keys])
    )


def quantile_chunks(df: DataFrame, column: str, fan: int = 32) -> Column:
    """A chunk number from 0 to ``fan * fan``, ascending in a numeric ``column``, null in 0.

    The bounds are approximate quantiles (``fan * fan - 1`` numbers, whatever the size of
    the table), fetched once, so the chunk of a row does not depend on how the table is
    read again.
    """
    steps = [i / (fan * fan) for i in range(1, fan * fan)]
    got = df.agg(F.percentile_approx(column, steps, 100_000)).first()[0] or []
    bounds = sorted(got)
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    x = F.col(column)
    # F.expr keeps the literals of the bounds one constant each.
    heads = F.array(*[F.lit(p[0]) for p in parts])
    rows = F.array(*[F.array(*[F.lit(v) for v in p]) for p in parts])
    coarse = F.size(F.filter(heads, lambda b: b <= x))
    fine = F.size(F.filter(F.get(rows, F.greatest(coarse - 1, F.lit(0))), lambda b: b <= x))
    return F.when(x.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * fan + fine)
