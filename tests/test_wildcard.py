import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import wildcard as W

PARSED = {
    "": W.Word(""), "cat": W.Word("cat"), "abc def": W.Word("abc"), "don't": W.Word("don"), "123": W.Word(""),
    "ab*": W.Starts("ab"), "ab**": W.Starts("ab"), "ab*1": W.Starts("ab"), "ab1*": W.Word("ab"), "*ab": W.Ends("ab"),
    "ab*cd": W.Between("ab", "cd"), "été*": W.Starts("été"),
}


@pytest.mark.parametrize("text", PARSED)
def test_parser(text):
    assert W.parse(text) == PARSED[text]


@pytest.mark.parametrize("text", ["a*b*c", "*ab*", "*", "**"])
def test_parser_errors(text):
    with pytest.raises(ValueError):
        W.parse(text)


def vocab(spark, *words):
    return W.vocabulary(spark.createDataFrame([(w,) for w in words], "word string"))


def got(df):
    return sorted(r.word for r in df.collect())


WORDS = ("aba", "abba", "ab", "cat", "cats", "catalogue", "scat", "at", "a", "thing", "king")


def test_indexes_agree(spark):
    v = vocab(spark, *WORDS).cache()
    grams, turns = W.gram_index(v).cache(), W.rotation_index(v).cache()
    for pattern in ("ca*", "*at", "ab*ba", "ca*ue", "*ing", "cat*"):
        start, end = pattern.split("*")
        want = sorted(w for w in WORDS if w.startswith(start) and w.endswith(end))
        assert got(W.search(v, pattern)) == want
        assert got(W.gram_search(grams, v, pattern)) == want
        assert got(W.gram_search(grams, v, pattern, compat=True)) == [w for w in want if len(w) != 3]
        apart = [w for w in want if len(w) >= len(start) + len(end)]
        assert got(W.rotation_search(turns, pattern)) == apart
        assert got(v.where(W.rotation_predicate(pattern)).select("word")) == apart
    assert got(W.rotation_search(turns, "*")) == sorted(WORDS)
    assert got(W.rotation_search(turns, "cat")) == []
    assert got(W.rotation_search(turns, "c*a*e")) == ["catalogue"]
    with pytest.raises(ValueError):
        W.rotation_search(turns, "a*b*c*d")


def test_gram_edges(spark):
    v = vocab(spark, "cats", "cat", "at", "a")
    rows = {(r.gram.replace("\x03", "$"), r.word) for r in W.gram_index(v).collect()}
    assert rows == {
        ("$ca", "cats"), ("cat", "cats"), ("ats", "cats"), ("ts$", "cats"), ("$cat$", "cat"), ("$at", "at"), ("at$", "at"), ("$a$", "a"),
    }
    grams = W.gram_index(v)
    assert got(W.gram_search(grams, v, "c*")) == []
    assert got(W.gram_search(grams, v, "cat")) == ["cat"]
    assert got(W.gram_word(grams, v, "cats", compat=True)) == ["cats"]


def test_rotations(spark):
    assert sorted(r.rotation for r in W.rotation_index(vocab(spark, "cat")).collect()) == sorted(
        ["cat\x03", "at\x03c", "t\x03ca", "\x03cat"]
    )


def test_delete_and_case(spark):
    v = vocab(spark, "the", "then", "they")
    assert got(W.search(W.delete(v, "the"), "the*")) == ["then", "they"]
    assert got(W.search(v, "THE")) == ["the"] and got(W.search(v, "THE", case_sensitive=True)) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*1 ", max_size=6))
def test_parser_never_matches_more_than_the_text(text):
    try:
        kind = W.parse(text)
    except ValueError:
        return
    assert all(part in text for part in vars(kind).values())


def test_parsed_equals_parse(spark):
    """A table of patterns is parsed as single ones are; null and odd ones have a defined form."""
    parts = ["", "a", "tion", "\u00e9t", "\u00b2", "7", "_", "!", "*", "**"]
    patterns = [a + b + c + d for a in parts for b in ("", "*") for c in parts for d in ("", "*", "x")]

    def want(pattern):
        try:
            found = W.parse(pattern)
        except ValueError:
            return "error", None, None
        match found:
            case W.Between(a, b):
                return "Between", a, b
            case W.Ends(b):
                return "Ends", "", b
        return type(found).__name__, found.text, ""

    frame = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for row in W.parsed(frame).collect():
        assert tuple(row)[1:] == want(row.pattern), row
    none = spark.createDataFrame([(None,)], "pattern string")
    assert [tuple(r) for r in W.parsed(none).collect()] == [(None, "error", None, None)]
