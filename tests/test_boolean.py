from textloom.operators import boolean as B

DOCS = [(0, "The cat sat, the dog!"), (1, "a dog sat"), (2, ""), (3, None), (4, "dog cat")]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    x = B.BooleanIndex.build(docs)
    assert ids(x.lookup("DOG")) == [0, 1, 4]
    assert ids(x.all_of("dog", "sat", "dog")) == [0, 1]
    assert ids(x.all_of()) == [] and ids(x.any_of()) == [] and ids(x.all_of("dog", "none")) == []
    assert ids(x.any_of("cat", "a")) == [0, 1, 4]
    assert ids(x.none_of("dog")) == [2, 3]
    assert x.size().first().n == 5
    assert ids(x.phrase("the cat")) == [0] and ids(x.phrase("dog cat")) == [4] and ids(x.phrase("dog")) == []
    assert x.name(4).first().name == "4"
    assert B.BooleanIndex(x.postings, x.documents, case_sensitive=True).lookup("Dog").count() == 0


def test_laws(spark):
    x = B.BooleanIndex.build(spark.createDataFrame(DOCS, "doc_id long, text string"))
    a, b, every = x.lookup("cat"), x.lookup("sat"), x.documents
    assert ids(B.complement(every, B.complement(every, a))) == ids(a)
    left = B.complement(every, B.union(a, b))
    assert ids(left) == ids(B.intersect(B.complement(every, a), B.complement(every, b)))
    assert ids(B.difference(a, b)) == ids(B.intersect(a, B.complement(every, b))) == [4]


def test_add_is_idempotent(spark):
    x = B.BooleanIndex.build(spark.createDataFrame(DOCS, "doc_id long, text string"))
    more = spark.createDataFrame([("cat", 1), ("cat", 0), ("cat", 1)], "word string, doc_id long")
    assert ids(x.add(more).add(more).lookup("cat")) == [0, 1, 4]


def test_fill(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: (r.words, r.bytes) for r in B.fill_stats(docs).collect()}
    assert got == {0: (5, 21), 1: (3, 9), 2: (0, 0), 3: (0, 0), 4: (2, 7)}
    assert tuple(B.fill_totals(docs).first()) == (10, 5, 37)
