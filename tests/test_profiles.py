import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import counting
from textloom.functions import tokens as T
from textloom.functions.strings import common_prefix, occurrences, replace_between, rotate_left


def words(spark, profile, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.word for r in T.tokens(df, profile).collect()]
    array = df.select(profile.array(F.col("text")).alias("w")).first().w
    assert text is None or array == got
    return got


def test_strict(spark):
    assert words(spark, T.STRICT, "a---b «Hello» foo_ don't") == ["a", "b", "hello", "foo"]
    assert words(spark, T.STRICT, "x" * 31 + " " + "y" * 30) == ["y" * 30]
    assert words(spark, T.STRICT, "tab\tinside Ünïcode\r\nÉté") == ["ünïcode", "été"]
    assert words(spark, T.STRICT, None) == [] and words(spark, T.STRICT, "") == []


@pytest.mark.parametrize("profile", [T.STRICT, T.LATIN])
def test_words_found_in_one_pass_are_those_of_split_tokens(spark, profile):
    draw = random.Random(5)
    signs = list("\r\n ;.,!?*:()[]---\t'") + list(T.TRIMMED) + list("aZé_9\u0130\u212a\u0301ΑΣ\U00010400\U0001d7ce")
    texts = ["".join(draw.choices(signs, k=draw.randrange(1, 40))) for _ in range(20_000)]
    texts += ["".join(draw.choices("ab_-", k=draw.randrange(28, 36))) for _ in range(3_000)]
    texts += [f"{chr(c)} {chr(c)}a b{chr(c)}c" for c in range(1, 0x3100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = replace(profile, found=None)
    other = df.select("text", profile.array(F.col("text")).alias("a"), split.array(F.col("text")).alias("b")).where("a <> b")
    assert other.limit(3).collect() == [] and profile.found


@pytest.mark.parametrize("profile", [T.STRICT, T.LOOSE, T.LATIN, T.GENRE])
def test_words_counted_in_batches_are_those_of_tokens(spark, monkeypatch, profile):
    """Rows with equal ids, across slices too, are one document; the JVM only deals and sorts texts."""
    draw = random.Random(7)
    signs = list("\r\n ;.,!?*:()[]---\t'") + list(T.TRIMMED) + list("aZé_9\u0130\u212a\u0301ΑΣ\U00010400\U0001d7ce")
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(3_000)] + [None, "", "--"]
    texts += ["".join(draw.choices("ab_-", k=draw.randrange(28, 36))) for _ in range(300)]
    # Among them letters that Java 17 and Python 3.13 do not agree on.
    texts += [f"{chr(c)} {chr(c)}a b{chr(c)}c" for c in [*range(1, 0x3100, 3), 0x870, 0x1734, 0x10D50]]
    rows = [(None if i % 50 == 0 else i // 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = T.tokens(df, profile).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    got = T.term_frequencies(df, profile)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert got.exceptAll(plain).count() == 0 == plain.exceptAll(got).count()
    lengths = T.counted_terms(df, profile).where("head").select("doc_id", "dl")
    want = plain.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    assert lengths.exceptAll(want).count() == 0 == want.exceptAll(lengths).count()
    pairs = df.select(F.explode(T.distinct_words(profile)).alias("word"), "doc_id")
    found = T.document_words(df, profile)
    assert found.exceptAll(pairs).count() == 0 == pairs.exceptAll(found).count()


@pytest.mark.parametrize("size", [1, 30, 1 << 24])
def test_words_counted_in_slices_of_any_size(monkeypatch, size):
    monkeypatch.setattr(counting, "SLICE", size)
    schema = pa.schema([("doc_id", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("dl", pa.int64()), ("head", pa.bool_())])
    ids, texts = [None, None, 1, 1, 1, 2, 3, 4, 4], ["a b", "a", "x x", "", "x Y", ".", None, "z", "z--z"]
    batches = [pa.record_batch([pa.array(ids[i : i + 4], pa.int64()), pa.array(texts[i : i + 4], pa.string())], ["doc_id", "text"]) for i in (0, 4, 8)]
    letters = counting.Signs([97], [122], {})
    rows = [r for b in counting.counter(T.STRICT, letters, schema, True)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(map(repr, (r[:4] for r in rows))) == sorted(
        map(repr, [(None, "a", 2, 3), (None, "b", 1, 3), (1, "x", 3, 4), (1, "y", 1, 4), (4, "z", 3, 3)])
    )
    assert sorted(str(r[0]) for r in rows if r[4]) == ["1", "4", "None"]


@pytest.mark.parametrize("size", [1, 200, 1 << 26])
def test_lists_of_any_size(monkeypatch, size):
    """Lists hold each count once, in order, and no more than about ``LISTED`` bytes of counts (F23)."""
    monkeypatch.setattr(counting, "SLICE", 1)
    monkeypatch.setattr(counting, "LISTED", size)
    counts = pa.schema([("doc_id", pa.string()), ("word", pa.string()), ("tf", pa.int64()), ("dl", pa.int64()), ("head", pa.bool_())])
    schema = pa.schema([("word", pa.string()), ("doc_ids", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
    texts = pa.record_batch([pa.array([None, *"abbcd"]), pa.array(["x", "y x", "x x", "x", None, "y"])], ["doc_id", "text"])
    own = replace(T.STRICT, longest=9)  # memos are kept by profile
    run = counting.lister(counting.counter(own, counting.Signs([97], [122], {}), counts, True), schema)
    rows = [r for b in run(iter([texts])) for r in zip(*(c.to_pylist() for c in b.columns))]
    pairs = [(w, d, n) for w, ids, tfs in rows for d, n in zip(ids, tfs, strict=True)]
    assert [p for p in pairs if p[0] == "x"] == [("x", None, 1), ("x", "a", 1), ("x", "b", 3)]
    assert [p for p in pairs if p[0] == "y"] == [("y", "a", 1), ("y", "d", 1)]
    assert len(rows) == {1: 5, 200: 2, 1 << 26: 2}[size]
    assert list(run(iter([]))) == []


@pytest.mark.parametrize("profile", [T.STRICT, T.LOOSE])
def test_lists_are_the_frequencies(spark, profile):
    rows = [(None if i % 50 == 0 else f"d{i // 3}", " ".join(f"w{i % k}é" for k in range(1, i % 9))) for i in range(900)] + [("z", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    lists = T.counted_lists(df, profile)
    want, got = T.term_frequencies(df, profile), T.unlisted(lists)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.schema == want.schema
    # A word has one list for each part.
    assert lists.groupBy("word", F.spark_partition_id()).count().where("count > 1").count() == 0


def test_loose_keeps_what_holds_a_word_character(spark):
    assert words(spark, T.LOOSE, "don't '' a\tb " + "x" * 31) == ["don't", "a\tb", "x" * 31]


def test_simple_splits_at_blanks_only(spark):
    assert words(spark, T.SIMPLE, "a,b c; -- (d) ?!") == ["a,b", "c", "(d)"]


def test_latin_starts_with_a_to_z(spark):
    assert words(spark, T.LATIN, "Abc école 1abc zed") == ["abc", "zed"]


def test_author_and_genre(spark):
    assert words(spark, T.AUTHOR, "«Jane» O'Neil, \n — x") == ["jane", "o'neil,", "x"]
    assert words(spark, T.GENRE, "sci_fi Space  opera") == ["sci", "fi", "space", "opera"]


def test_strings(spark):
    df = spark.createDataFrame([("banana", "bandana"), ("", "x"), ("same", "same")], "a string, b string")
    got = df.select(
        occurrences(F.col("a"), "a").alias("n"),
        rotate_left(F.col("a")).alias("r"),
        replace_between(F.col("b"), 0, 1, "--").alias("p"),
        common_prefix(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [(3, "ananab", "--ndana", "ban"), (0, "", "--", ""), (1, "ames", "--me", "same")]
