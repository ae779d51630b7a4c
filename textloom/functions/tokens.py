"""The six tokenization profiles as column expressions.

A profile splits a text at its delimiters, trims characters from the ends of tokens, drops
tokens that its predicate rejects, and lowers the rest. Word characters are given as
Unicode classes, since ``\\w`` is ASCII in Java. Of ``tokens``, splitting, trimming and testing
stay in the JVM inside generated code; it explodes first so that rejected tokens are dropped
before anything else sees them. Words are counted and told apart in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from textloom.functions.counting import counter, gatherer, lister, signs
from textloom.functions.runtime import dealt, spread

# Delimiters and the characters trimmed from tokens.
SENTENCE_DELIMITERS = r"[\r\n]|--|[ ;.,!?*:()\[\]]"
TRIMMED = "—’-“”\"'°«‹»›„‟〝_"
SIMPLE_TRIMMED = ".;,—-?!*"
WORD_CLASS = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"


@dataclass(frozen=True)
class Profile:
    """How texts become words; ``whole``: only word characters, else one at least.

    ``found`` is a regular expression whose first group finds the same words in a text, in one
    pass: splitting makes a string of each token, and trimming and testing another.
    """

    delimiters: str
    trimmed: str = ""
    whole: bool | None = None
    longest: int | None = None
    first: str | None = None
    found: str | None = None

    def accepts(self, token: Column) -> Column:
        """Whether a trimmed token is a word. Empty tokens never are."""
        ok = token != ""
        if self.whole is not None:
            ok = token.rlike(rf"^{WORD_CLASS}+\z" if self.whole else WORD_CLASS)
        if self.longest:
            ok = ok & (F.length(token) <= self.longest)
        if self.first:
            ok = ok & F.lower(F.substring(token, 1, 1)).rlike(self.first)
        return ok

    def trim(self, token: Column) -> Column:
        return F.btrim(token, F.lit(self.trimmed)) if self.trimmed else token

    def array(self, text: Column) -> Column:
        """array<string>: the words of a text, in order."""
        if self.found:
            return F.transform(F.regexp_extract_all(text, F.lit(self.found), F.lit(1)), F.lower)
        trimmed = F.transform(F.split(text, self.delimiters), self.trim)
        return F.transform(F.filter(trimmed, self.accepts), F.lower)


def _found(first: str) -> str:
    """The words of up to 30 word characters that ``first`` begins, between delimiters and what is trimmed."""
    trimmed = "[" + "".join(f"\\{c}" if c in "-^[]" else c for c in TRIMMED) + "]*"
    ends = r"[\r\n ;.,!?*:()\[\]]"
    return rf"(?:^|(?<={ends})|(?<=--)){trimmed}({first}(?:{WORD_CLASS}{{0,28}}{_KEPT})?){trimmed}(?={ends}|--|\z)"


#: A word character that is not trimmed, and one whose lower case begins with a Latin letter.
_KEPT, _LATIN = WORD_CLASS[:-1] + "&&[^_]]", r"[a-zA-Z\u0130\u212A]"

STRICT = Profile(SENTENCE_DELIMITERS, TRIMMED, whole=True, longest=30, found=_found(_KEPT))
LOOSE = Profile(SENTENCE_DELIMITERS, TRIMMED, whole=False)
SIMPLE = Profile(r"[\r\n ]", SIMPLE_TRIMMED, whole=False)
LATIN = Profile(SENTENCE_DELIMITERS, TRIMMED, whole=True, longest=30, first="^[a-z]", found=_found(_LATIN))
AUTHOR = Profile(r"[ \r\n]", TRIMMED)
GENRE = Profile(r"[ _]")


def _narrow(docs: DataFrame, text: str, doc_id: str, deal=spread) -> DataFrame:
    """doc_id, text, dealt to all cores; streams stay as they are."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow if docs.isStreaming else deal(narrow)


def _words(narrow: DataFrame, profile: Profile) -> DataFrame:
    if profile.found:
        parts = F.regexp_extract_all("text", F.lit(profile.found), F.lit(1))
        return narrow.select("doc_id", F.explode(parts).alias("token")).select("doc_id", F.lower("token").alias("word"))
    # Trimmed before they are exploded: a filter below would trim once more for each test.
    trimmed = F.transform(F.split("text", profile.delimiters), profile.trim)
    parts = narrow.select("doc_id", F.explode(trimmed if profile.trimmed else F.split("text", profile.delimiters)).alias("token"))
    return parts.where(profile.accepts(F.col("token"))).select("doc_id", F.lower("token").alias("word"))


def distinct_words(profile: Profile, text: str = "text") -> Column:
    """array<string>: each distinct word of a text."""
    array = profile.array(F.col(text))
    if profile.found:  # Fewer tokens are lowered.
        array = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(profile.found), F.lit(1))), F.lower)
    return F.array_distinct(array)


def _arrow(made: StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in made.fields])


def _counted(narrow: DataFrame, profile: Profile, merged: bool, listed: bool = False) -> DataFrame:
    """doc_id, word, tf, dl, head of doc_id, text; if ``listed``, word, doc_ids, tfs."""
    own = narrow.schema["doc_id"].dataType
    made = StructType().add("doc_id", own).add("word", StringType()).add("tf", LongType()).add("dl", LongType()).add("head", BooleanType())
    run = counter(profile, signs(narrow.sparkSession, WORD_CLASS), _arrow(made), merged)
    if listed:
        made = StructType().add("word", StringType()).add("doc_ids", ArrayType(own)).add("tfs", ArrayType(LongType()))
        run = lister(run, _arrow(made))
    return narrow.mapInArrow(run, made)


def document_words(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, doc_id: each distinct word of each text, told apart where the text is read.

    No row is shuffled for it. Only rows with equal ids can give a pair more than once.
    """
    if docs.isStreaming:
        return _narrow(docs, text, doc_id).select(F.explode(distinct_words(profile)).alias("word"), "doc_id")
    return _counted(_narrow(docs, text, doc_id), profile, False).select("word", "doc_id")


def tokens(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id", deal=spread) -> DataFrame:
    """doc_id, word: one row for each word of each text; null texts have none."""
    return _words(_narrow(docs, text, doc_id, deal), profile)


def _by_id(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    narrow = _narrow(docs, text, doc_id, lambda df: dealt(df, "doc_id"))
    return narrow.sortWithinPartitions("doc_id")


def counted_terms(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, word, tf, dl, head: how often each word is in each document, beside the number of
    its words; ``head`` is true in one row of each document.

    Texts are dealt by id and sorted by it, so that rows with equal ids are counted together.
    """
    return _counted(_by_id(docs, text, doc_id), profile, True)


def counted_lists(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, doc_ids, tfs: the documents of a word in a part of them, ascending, and how often it is in each.

    The same as ``term_frequencies`` in far fewer rows: a word has a list for each part that it is in,
    made where words are counted. Parts have a bounded size, so lists do too.
    """
    return _counted(_by_id(docs, text, doc_id), profile, True, listed=True)


def counted_documents(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, words, tfs: the distinct words of a document and how often each is in it.

    The same as ``term_frequencies`` in a row for each document that has words.
    """
    narrow = _by_id(docs, text, doc_id)
    own = narrow.schema["doc_id"].dataType
    each = StructType().add("doc_id", own).add("word", StringType()).add("tf", LongType()).add("dl", LongType()).add("head", BooleanType())
    made = StructType().add("doc_id", own).add("words", ArrayType(StringType())).add("tfs", ArrayType(LongType()))
    run = counter(profile, signs(narrow.sparkSession, WORD_CLASS), _arrow(each), True)
    return narrow.mapInArrow(gatherer(run, _arrow(made)), made)


def unlisted(lists: DataFrame) -> DataFrame:
    """doc_id, word, tf of ``counted_lists``."""
    pairs = lists.select("word", F.explode(F.arrays_zip("doc_ids", "tfs")).alias("pair"))
    return pairs.select(F.col("pair.doc_ids").alias("doc_id"), "word", F.col("pair.tfs").alias("tf"))


def term_frequencies(docs: DataFrame, profile: Profile, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, word, tf: how often each word is in each document."""
    if docs.isStreaming:
        return tokens(docs, profile, text, doc_id).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    return counted_terms(docs, profile, text, doc_id).select("doc_id", "word", "tf")
