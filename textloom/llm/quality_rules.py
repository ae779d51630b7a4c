"""Quality rules judged by host.

Every document is measured against a few rules. The failures of each rule are counted by
host, each host's failure rates are shrunk towards the corpus with a beta prior that is
fitted to all hosts by moments, and a host whose shrunk rate of any rule is above
``max_rate`` is rejected with all its documents. A document is kept if it passes the base
rules and its host is not rejected.

DataFrame functions only. Texts never leave the scan: the measures are a few numbers a
document, which are materialized once, counted by host with partial sums, and joined back.

Defined results: a null text has no words and fails the base; null hosts are one host of
their own; rows with the same or a null ``doc_id`` are judged one by one; an empty table
gives an empty result. Columns of the input with the names of measures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize, small_enough
from textloom.llm.text import SPACES, words

SYMBOLS = "#*$%&|<>"

#: Rules by name, over the measures, written so that Spark and DuckDB read them alike.
BASE = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
}
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "long_words": "n_words > 0 AND word_chars > 12 * n_words",
}
#: Hosts up to which their verdicts are sent to all tasks; beyond it they are joined.
FEW_HOSTS = 100_000
#: Bounds of the prior's weight, in documents.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1e6


def repeated_words(word: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the array.

    Windows are sorted together with their places, so the cost is n log n for any text;
    texts without an equal pair of windows skip the sort.
    """
    count = F.size(word)
    windows = F.transform(
        F.slice(word, 1, F.greatest(count - 2, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get(word, i + 1), F.lit(" "), F.get(word, i + 2)),
    )
    places = F.sort_array(
        F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), w.alias("w"), i.alias("i")))
    )

    def pick(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda s, k: F.coalesce(s["w"] == F.get(ordered, k - 1)["w"], F.lit(False))
            | F.coalesce(s["w"] == F.get(ordered, k + 1)["w"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    # aggregate() over a one-element array binds a value that is used more than once.
    bind = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return F.when(count < 4, 0).otherwise(
        F.when(F.size(F.array_distinct(windows)) == count - 2, 0).otherwise(
            bind(places, lambda p: bind(pick(p), covered))
        )
    )


def measures(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the measures of every whole text, one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    parts = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words(text).alias("_words"),
        lines.alias("_lines"),
    )
    return parts.select(
        "doc_id",
        "host",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, max_rate: float) -> DataFrame:
    """host, host_ok: one row a host. The prior is one row, whatever the number of hosts."""
    counted = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.expr(f"CAST({rule} AS INT)")).alias(f"bad_{k}") for k, rule in RULES.items()],
    )
    stats = [F.sum("docs").alias("n")]
    for k in RULES:
        rate = F.col(f"bad_{k}") / F.col("docs")
        stats += [
            F.sum(f"bad_{k}").alias(f"sum_{k}"),
            (F.avg(rate * rate) - F.avg(rate) * F.avg(rate)).alias(f"var_{k}"),
        ]
    prior = counted.agg(*stats).select(F.lit(0).alias("_one"), "*")
    joined = counted.withColumn("_one", F.lit(0)).join(F.broadcast(prior), "_one")
    ok = F.lit(True)
    for k in RULES:
        mean = F.col(f"sum_{k}") / F.col("n")
        spread = F.greatest(F.col(f"var_{k}"), F.lit(1e-9))
        weight = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT))
        ok = ok & ((F.col(f"bad_{k}") + mean * weight) / (F.col("docs") + weight) <= max_rate)
    return joined.select("host", ok.alias("host_ok"))


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, measures, base_failed, host_ok, kept for every row of ``docs``."""
    measured = materialize(measures(docs, host))
    verdict = small_enough(host_verdicts(measured, max_rate).withColumnRenamed("host", "_host"), FEW_HOSTS)
    base = " OR ".join(f"({rule})" for rule in BASE.values())
    return (
        measured.join(verdict, measured["host"].eqNullSafe(verdict["_host"]))
        .withColumn("base_failed", F.expr(base))
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
        .drop("_host")
    )


def keep_passing(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; works row by row, not by ids.

    The measures are computed again beside the whole row, so that neither texts are
    shuffled nor ids have to be unique.
    """
    verdict = host_verdicts(materialize(measures(docs, host)), max_rate)
    good = small_enough(verdict.where("host_ok").select(F.col("host").alias("_host")), FEW_HOSTS)
    return docs.where(passes_base(F.col("text"))).join(
        good, docs[host].eqNullSafe(good["_host"]), "left_semi"
    )


def passes_base(text: Column) -> Column:
    """Whether a text passes the base rules."""

    def judge(w: Column) -> Column:
        return (F.size(w) >= 50) & (100 * repeated_words(w).cast("long") <= 50 * F.size(w).cast("long"))

    return F.get(F.transform(F.array(words(text)), judge), F.lit(0))
