"""FB2 e-books: body, author and genre text by XPath, and the zones made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import dealt, spread
from textloom.functions.tokens import AUTHOR, GENRE, STRICT, tokens

#: Zones in order, with their path and profile. Paths of the format.
ZONES = (
    ("body", "/FictionBook/body//text()", STRICT),
    ("author", "/FictionBook/description/title-info/author/*/text()", AUTHOR),
    ("genre", "/FictionBook/description/title-info/genre/text()", GENRE),
)


def parts(xml: Column, path: str) -> Column:
    """Texts at a path of a book, one a line."""
    return F.concat_ws("\n", F.xpath(xml, F.lit(path)))


def parse_books(books: DataFrame, xml: str = "xml") -> DataFrame:
    """doc_id, body, author, genre of books (doc_id, xml)."""
    return books.select("doc_id", *[parts(F.col(xml), path).alias(zone) for zone, path, _ in ZONES])


def _zones(parsed: DataFrame, deal=spread) -> list[DataFrame]:
    frames = []
    for k, (zone, _, profile) in enumerate(ZONES):
        # A line of a genre is a genre of its own; the profile splits blanks and underscores.
        lines = parsed.select("doc_id", F.explode(F.split(zone, "\n")).alias(zone)) if profile is GENRE else parsed
        frames.append(tokens(lines, profile, text=zone, deal=deal).select("doc_id", F.lit(k).alias("zone"), "word"))
    return frames


def book_words(parsed: DataFrame) -> DataFrame:
    """doc_id, zone (0 body, 1 author, 2 genre), word."""
    return reduce(DataFrame.unionByName, _zones(parsed))


def book_frequencies(books: DataFrame, xml: str = "xml") -> DataFrame:
    """doc_id, zone, word, tf of books (doc_id, xml).

    Books are dealt by id into parts of a bounded size, and words are counted where they are cut.
    """
    parsed = parse_books(dealt(books.select("doc_id", xml), "doc_id"), xml)
    counted = [f.groupBy("doc_id", "zone", "word").agg(F.count(F.lit(1)).alias("tf")) for f in _zones(parsed, lambda df: df)]
    return reduce(DataFrame.unionByName, counted)
