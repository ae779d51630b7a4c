import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a frame of documents from (doc_id, text[, source]) rows."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"'kept as it is' AS `{name}`")
        return df

    return make


def prose(seed, n, vocabulary=400):
    """n words from a vocabulary with few frequent and many rare words."""
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary ** rng.random())}" for _ in range(n))


@pytest.fixture(scope="session")
def odd():
    """Texts at the edges: null, empty, blank, long, repeated, with odd white space."""
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (5, "One two"), (None, "null id text"),
        (None, None), (6, "x" * 30_000), (7, prose(1, 20_000)), (8, "a\x1cb\x85c\xa0d\u3000e"), (9, "<|endoftext|> end <|endoftext|>"),
        (10, "Ünïcode ßtraße İstanbul 👍🏽 日本語"), (11, "a  b\n\n c \n d"), (12, "'s 'S don't I'll"),
    ]
