"""Words as maximal runs of characters other than the six ASCII white-space ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """array<string> of all words of a text; a null or blank text has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", none).otherwise(F.split(trimmed, SPACE))


def word_count(text: Column) -> Column:
    """long: number of words of a text, 0 of a null one; no array of words is made."""
    trimmed = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(trimmed, WORD + SPACE.replace("+", "*"), F.lit("w"))).cast("long")
