"""Small string functions of the wildcard indexes and the dictionary encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, char: str) -> Column:
    """How often a character is in a string."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def replace_between(text: Column, first: int, last: int, by: str) -> Column:
    """Replace the characters from 0-based ``first`` to ``last``, both included."""
    return F.overlay(text, F.lit(by), F.lit(first + 1), F.lit(last - first + 1))


def rotate_left(text: Column, steps: Column | int = 1) -> Column:
    """Move the first ``steps`` characters to the end."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return F.concat(F.substring(text, steps + 1, F.length(text)), F.substring(text, F.lit(1), steps))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    most = F.least(F.length(a), F.length(b))
    differs = F.filter(
        F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)),
    )
    return F.substring(a, F.lit(1), F.coalesce(F.get(differs, F.lit(0)) - 1, most))
