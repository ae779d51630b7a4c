"""Wildcard retrieval: a pattern is parsed on the driver and becomes a column predicate; a
table of patterns is parsed by column expressions.

Three indexes answer them: the vocabulary itself (prefix and reversed word, as a trie would),
its 3-grams, and its rotations. All are frames built from ``vocabulary(word, reversed)``.
Prefix predicates are ``startswith``, which Parquet files sorted by the column prune by
their statistics; suffix predicates become prefixes of the reversed word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ordering import chunked_row_number
from textloom.functions.runtime import materialize

#: Fixed value: marks the ends of words in grams and rotations.
MARK = "\x03"


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Starts:
    text: str


@dataclass(frozen=True)
class Ends:
    text: str


@dataclass(frozen=True)
class Between:
    start: str
    end: str


Pattern = Word | Starts | Ends | Between
_LETTER = r"[^\W\d_]"
#: In order of choice; what follows a match is not looked at, but for the character after it.
_FORMS = (
    (re.compile(rf"({_LETTER}*)(?!{_LETTER})(?!\*)"), Word),
    (re.compile(rf"({_LETTER}+)\*({_LETTER}+)(?!{_LETTER})(?!\*)"), Between),
    (re.compile(rf"({_LETTER}+)\*(?!{_LETTER})"), Starts),
    (re.compile(rf"\*({_LETTER}+)(?!{_LETTER})(?!\*)"), Ends),
)


def parse(pattern: str) -> Pattern:
    """The form of a pattern with at most one star; ValueError if it has none."""
    for form, kind in _FORMS:
        if found := form.match(pattern):
            return kind(*found.groups())
    raise ValueError(f"not a wildcard pattern: {pattern!r}")


#: The letters of ``parse`` for column expressions: letters and numbers other than digits.
LETTERS = r"\p{L}\p{Nl}\p{No}"
#: Form, regular expression, groups of its first and last text, in order of choice.
FORMS = (
    ("Word", rf"^([{LETTERS}]*)([^{LETTERS}*]|\z)", 1, 0),
    ("Between", rf"^([{LETTERS}]+)\*([{LETTERS}]+)([^{LETTERS}*]|\z)", 1, 2),
    ("Starts", rf"^([{LETTERS}]+)\*([^{LETTERS}]|\z)", 1, 0),
    ("Ends", rf"^\*([{LETTERS}]+)([^{LETTERS}*]|\z)", 0, 1),
)


def parsed(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add form, first, last: what ``parse`` finds, for a table of patterns and without Python.

    ``first`` is the whole word or how words start, ``last`` how they end, '' where the form
    has none. A pattern of no form has form ``error`` and nulls; so has a null pattern.
    """
    text = F.col(pattern)

    def chosen(value) -> Column:
        out = F.lit(None).cast("string")
        for form in reversed(FORMS):
            out = F.when(text.rlike(form[1]), value(form)).otherwise(out)
        return out

    part = lambda at: lambda f: F.regexp_extract(text, f[1], f[at]) if f[at] else F.lit("")
    form = F.coalesce(chosen(lambda f: F.lit(f[0])), F.lit("error"))
    return patterns.select("*", form.alias("form"), chosen(part(2)).alias("first"), chosen(part(3)).alias("last"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, reversed: each distinct word."""
    return words.select("word").distinct().withColumn("reversed", F.reverse("word"))


def predicate(pattern: Pattern) -> Column:
    """The condition on (word, reversed); prefix and suffix may overlap."""
    word, backwards = F.col("word"), F.col("reversed")
    match pattern:
        case Word(text):
            return word == text
        case Starts(text):
            return word.startswith(text)
        case Ends(text):
            return backwards.startswith(text[::-1])
        case Between(start, end):
            return word.startswith(start) & backwards.startswith(end[::-1])
    raise TypeError(pattern)


def search(vocab: DataFrame, pattern: str | Pattern, case_sensitive: bool = False) -> DataFrame:
    """word: the words of the vocabulary that match."""
    if isinstance(pattern, str):
        pattern = parse(pattern if case_sensitive else pattern.lower())
    return vocab.where(predicate(pattern)).select("word")


def delete(vocab: DataFrame, *words: str) -> DataFrame:
    """The vocabulary without exactly these words."""
    return vocab.where(~F.col("word").isin(list(words)))


def docs_of(words: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id: documents with any word of a word set."""
    return postings.join(words, "word", "left_semi").select("doc_id").distinct()


def first_docs(postings: DataFrame) -> DataFrame:
    """word, doc_id with the first document of each word only (compatible mode)."""
    return postings.groupBy("word").agg(F.min("doc_id").alias("doc_id"))


# Word sets are frames (word).
def word_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def word_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def word_order(words: DataFrame) -> DataFrame:
    """position, word: a word set in order of its words, from 0, without a global sort."""
    chunked = materialize(words.select("word", F.substring("word", 1, 2).alias("_chunk")))
    return chunked_row_number(chunked, [], "_chunk", [F.col("word")], "position").select("position", "word")


def word_total(words: DataFrame) -> DataFrame:
    """words, characters: size of a word set and length of all its words."""
    return words.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("characters"))


# 3-grams


def grams_of(word: Column) -> Column:
    """array<string>: marked grams at both ends and all 3-grams in between.

    Words of one or three characters have the word between two marks only.
    """
    n = F.length(word)
    mark = F.lit(MARK)
    inner = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(word, i, F.lit(3)))
    ends = lambda k: (F.concat(mark, F.substring(word, 1, k)), F.concat(F.substring(word, -k, k), mark))
    head, tail = ends(2)
    return (
        F.when(n > 3, F.concat(F.array(head), inner, F.array(tail)))
        .when(n == 2, F.array(head, tail))
        .otherwise(F.array(F.concat(mark, word, mark)))
    )


def gram_index(vocab: DataFrame) -> DataFrame:
    """gram, word: each pair once."""
    return vocab.select(F.explode(F.array_distinct(grams_of(F.col("word")))).alias("gram"), "word")


def _windows(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def gram_search(grams: DataFrame, vocab: DataFrame, pattern: str | Pattern, compat: bool = False, case_sensitive: bool = False) -> DataFrame:
    """word: candidates that hold all grams of the pattern, checked against it.

    Parts of fewer than two characters find nothing. The gram index has no windows of
    3-letter words; they are taken from the vocabulary, unless ``compat`` leaves them out.
    """
    if isinstance(pattern, str):
        pattern = parse(pattern if case_sensitive else pattern.lower())
    if isinstance(pattern, Word):
        return gram_word(grams, vocab, pattern.text, compat)
    start = pattern.text if isinstance(pattern, Starts) else getattr(pattern, "start", None)
    end = pattern.text if isinstance(pattern, Ends) else getattr(pattern, "end", None)
    if any(part is not None and len(part) < 2 for part in (start, end)):
        return vocab.select("word").limit(0)
    needed = set()
    if start is not None:
        needed |= {MARK + start[:2], *_windows(start)}
    if end is not None:
        needed |= {end[-2:] + MARK, *_windows(end)}
    held = grams.where(F.col("gram").isin(sorted(needed))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = held.where(F.col("n") == len(needed)).select("word")
    if not compat:
        found = found.union(vocab.where(F.length("word") == 3).select("word"))
    return found.withColumn("reversed", F.reverse("word")).where(predicate(pattern)).select("word")


def gram_word(grams: DataFrame, vocab: DataFrame, word: str, compat: bool = False) -> DataFrame:
    """word: the word itself if it is in the vocabulary.

    ``compat``: if the index has its first gram and all its windows, of whichever words.
    """
    if not compat:
        return vocab.where(F.col("word") == word).select("word")
    if len(word) < 2:
        return vocab.select("word").limit(0)
    needed = {MARK + word[:2], *_windows(word)}
    there = grams.where(F.col("gram").isin(sorted(needed))).agg(F.count_distinct("gram").alias("n"))
    return there.where(F.col("n") == len(needed)).select(F.lit(word).alias("word"))


# Rotations


def rotation_index(vocab: DataFrame) -> DataFrame:
    """rotation, word: all rotations of the marked word."""
    marked = F.concat("word", F.lit(MARK))
    turns = F.transform(
        F.sequence(F.lit(0), F.length("word")),
        lambda i: F.concat(F.substring(marked, i + 1, F.length(marked)), F.substring(marked, F.lit(1), i)),
    )
    return vocab.select(F.explode(turns).alias("rotation"), "word")


def rotation_search(rotations: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """word: matches of a pattern with one or two stars; prefix and suffix never overlap.

    The pattern is lowered unless ``case_sensitive``. With two stars the middle part may be anywhere in the word. Without a star nothing is
    found; more than two stars are a ValueError.
    """
    parts = (pattern if case_sensitive else pattern.lower()).split("*")
    if len(parts) > 3:
        raise ValueError(f"more than two stars: {pattern!r}")
    if len(parts) == 1:
        return rotations.select("word").limit(0)
    key = parts[-1] + MARK + parts[0]
    found = rotations.where(F.col("rotation").startswith(key))
    if len(parts) == 3:
        found = found.where(F.col("word").contains(parts[1]))
    return found.select("word").distinct()


def rotation_size(rotations: DataFrame) -> DataFrame:
    """n: number of rotations."""
    return rotations.agg(F.count(F.lit(1)).alias("n"))


def rotation_predicate(pattern: str) -> Column:
    """The same condition on (word, reversed), for a vocabulary without rotations."""
    parts = pattern.split("*")
    if len(parts) not in (2, 3):
        return F.lit(False)
    start, end = parts[0], parts[-1]
    ok = F.col("word").startswith(start) & F.col("reversed").startswith(end[::-1])
    ok = ok & (F.length("word") >= len(start) + len(end))
    return ok & F.col("word").contains(parts[1]) if len(parts) == 3 else ok
