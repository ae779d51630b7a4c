import math

import numpy as np

from textloom.functions.tokens import AUTHOR, GENRE, STRICT, term_frequencies
from textloom.operators import blockmax, bm25, vectors, zones

DOCS = [(0, "red fish blue fish"), (1, "red dog"), (2, "blue bird sings of a red bird"), (3, "")]


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.Bm25Index.build(docs).query("fish red fish").collect()}
    words = {i: t.split() for i, t in DOCS if t}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for i, ws in words.items():
        for q in ("fish", "red", "fish"):
            df = sum(q in x for x in words.values())
            idf = float(np.float32(math.log10(4 / df)))
            tf = ws.count(q)
            want[i] = want.get(i, 0) + idf * tf * 3 / (tf + 2 * (0.25 + 0.75 * len(ws) / mean))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert bm25.Bm25Index.build(docs).query("").collect() == []
    assert len(bm25.Bm25Index.build(docs).query("red", 1).collect()) == 1


def test_bm25_query_reads_texts_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("text", F.udf(seen, "string")("text"))
    index = bm25.Bm25Index.build(docs)
    before = read.value
    got = index.query("fish red fish none").collect()
    assert [r.doc_id for r in got] == [0, 1, 2] and read.value - before == len(DOCS)


def test_block_maxima(spark, tmp_path):
    # One short document of each of a few blocks ranks far above the long ones; many tie.
    texts = [(i, "red fish" if i % 200 == 7 else "red " + "plain words of some length " * 6) for i in range(1200)]
    texts += [(2000 + i, "blue bird") for i in range(30)] + [(-5, "red"), (3000, None), (3001, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = blockmax.BlockMaxIndex.store(docs, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "Fish red fish"), (2, "blue"), (3, "absent"), (4, None), (5, ""), (6, "red")], "q long, t string")
    terms = blockmax.parsed(asked, "q", "t")
    found, read = index.search(terms, k=5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    plain = bm25.Bm25Index.build(docs)
    for q, text in (1, "fish red fish"), (2, "blue"), (6, "red"):
        rows = [(r.doc_id, round(r.score, 6)) for r in plain.query(text).collect()]
        assert got[q] == sorted(rows, key=lambda x: (-x[1], x[0]))[:5]
    assert set(got) == {1, 2, 6}
    # Blocks of postings scored, and in all, for the first query: only those with a short text.
    opened = read.where("query_id = 1").count()
    assert index.search(terms, 5, first=1)[0].where("query_id < 6").count() == 10
    assert opened < index.blocks.where("word = 'red'").count() / 2
    # The last of the five ties with later ones, whose blocks have to be opened too.
    assert [d for d, _ in got[2]] == [2000, 2001, 2002, 2003, 2004]


def test_zones(spark):
    docs = spark.createDataFrame([(0, "red red", "red", "x"), (1, "blue", "Red", "red")], "doc_id long, t string, a string, g string")
    z = zones.zone_postings(docs, [("t", STRICT), ("a", AUTHOR), ("g", GENRE)])
    assert [(r.doc_id, round(r.weight, 6)) for r in zones.rank(z, "red").collect()] == [(1, 0.6), (0, 0.5)]
    assert zones.rank(z, "none").collect() == []
    assert {(r.word, r.doc_id): r.zones for r in zones.bits(z, 3).collect()}[("red", 0)] == [True, True, False]


def test_clusters(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    v = vectors.tfidf(term_frequencies(docs, STRICT), 4)
    chosen = spark.createDataFrame([(0,), (2,)], "doc_id long")
    got = {r.doc_id: (r.leader, r.level) for r in vectors.assign(v, docs, chosen).collect()}
    assert set(got) == {1, 3} and got[3] == (0, 0.0) and got[1][1] > 0
    assert vectors.leaders(docs).count() == 2
    assigned = vectors.assign(v, docs, chosen)
    assert sum(r["size"] for r in vectors.cluster_sizes(assigned).collect()) == 2
    assert sum(len(r.members) for r in vectors.clusters(assigned).collect()) == 2


def test_dense_cosine_of_zero_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vectors.cosine(df.a, df.b).alias("c")).collect()] == [1.0, None]


def test_dense_leaders_in_blocks(spark, monkeypatch):
    """Leaders in several blocks give what one block gives."""
    import random

    from pyspark.sql import functions as F

    from textloom.operators import vectors

    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    chosen = rows.where("vec_id < 9").select("vec_id")
    want = sorted(map(tuple, vectors.assign_dense(rows, chosen).collect()))
    monkeypatch.setattr(vectors, "FEW_TERMS", 10)
    assert sorted(map(tuple, vectors.assign_dense(rows, chosen).collect())) == want and len(want) == 51
    assert rows.join(chosen, "vec_id", "left_anti").agg(F.count("vec_id")).first()[0] == 51


def _shuffled(df):
    """Exchanges that carry rows between tasks, in the plan of ``df`` after it ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in text.splitlines() if "Exchange " in x and "Broadcast" not in x and "SinglePartition" not in x]


def test_pairs_are_summed_where_documents_lie(spark):
    """Pairs of documents and leaders are never shuffled (F6 to F10)."""
    docs = spark.createDataFrame([(i, f"red w{i % 7} w{i % 5} fish{i}") for i in range(200)], "doc_id long, text string")
    v = vectors.tfidf(term_frequencies(docs, STRICT), 201)
    few = v.where("doc_id < 9")
    pairs = vectors.cosines(v.where("doc_id >= 9"), few).groupBy("a").count()
    assert not any("(a#" in x for x in _shuffled(pairs)) and len(pairs.collect()) == 191
    # The sums agree with those of plain vectors.
    held = {}
    for r in v.collect():
        held.setdefault(r.doc_id, {})[r.word] = float(np.float32(r.weight))
    size = {d: math.sqrt(sum(x * x for x in w.values())) for d, w in held.items()}
    for r in vectors.cosines(v.where("doc_id >= 9"), few).collect():
        want = sum(x * held[r.b].get(k, 0) for k, x in held[r.a].items()) / (size[r.a] * size[r.b])
        assert abs(r.cosine - want) < 1e-9


def test_words_are_counted_where_texts_are_cut(spark, tmp_path):
    """Rows of (document, word) are not shuffled, and parts of texts have a bounded size (F25, F29, F30)."""
    from textloom.functions import runtime

    spark.createDataFrame([(i % 50, "red fish Red") for i in range(100)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    tf = term_frequencies(docs, STRICT)
    assert not any("word#" in x.split("), ")[0] for x in _shuffled(tf))
    assert sorted(map(tuple, tf.where("doc_id = 3").collect())) == [(3, "fish", 2), (3, "red", 4)]
    before, runtime.PART = runtime.PART, 64
    try:
        assert runtime.dealt(docs, "doc_id").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    finally:
        runtime.PART = before


def test_dense_parts_grow_with_the_work(spark, monkeypatch):
    """Vectors are dealt by the products to make, not by the bytes of their scan (F12)."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    chosen = rows.where("vec_id < 9").select("vec_id")
    monkeypatch.setattr(vectors, "PRODUCTS", 100)
    assert vectors.assign_dense(rows, chosen).rdd.getNumPartitions() > 20


def _stored(spark, tmp_path):
    texts = [(i, f"red red w{i % 7} w{i % 5} fish{i} x{i % 11}" + " blue" * (i % 3)) for i in range(200)]
    texts += [(300 + i, "red w3 copy") for i in range(4)] + [(400, "alone"), (401, None), (402, "red")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = vectors.tfidf(term_frequencies(docs, STRICT), len(texts))
    return docs, rows, *vectors.store(docs, str(tmp_path / "vectors"))


def _pairs(frame):
    return {(r.a, r.b): round(r.cosine, 9) for r in frame.collect()}


def test_leaders_meet_stored_vectors_by_matrices(spark, tmp_path, monkeypatch):
    """Documents are assigned where they are stored: no row for a word that a document shares with a leader (F1 to F4)."""
    docs, rows, v, idf = _stored(spark, tmp_path)
    chosen = docs.where("doc_id < 9 or doc_id in (300, 302)").select("doc_id")
    best = {}
    for (a, b), level in _pairs(vectors.cosines(rows.where("doc_id >= 9 and doc_id not in (300, 302)"), rows.where("doc_id < 9 or doc_id in (300, 302)"))).items():
        best[a] = max(best.get(a, (-1, 0)), (level, -b))
    want = {a: (-b, level) for a, (level, b) in best.items()} | {400: (0, 0.0), 401: (0, 0.0)}
    for few, dense, met in (2_000_000, 4_000_000, 4_000_000), (20, 1, 3), (2_000_000, 12, 1):
        monkeypatch.setattr(vectors, "FEW_TERMS", few)
        monkeypatch.setattr(vectors, "DENSE", dense)
        monkeypatch.setattr(vectors, "MET", met)
        got = vectors.assign(v, docs, chosen, idf)
        assert {r.doc_id: (r.leader, round(r.level, 9)) for r in got.collect()} == want
    # Copies of leaders 300 and 302 go to the one with the least id.
    assert want[301] == want[303] == (300, 1.0) and want[402][0] >= 0
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and not any("word" in x.split("Exchange")[1] for x in text.splitlines() if "Exchange" in x)


def test_many_words_are_joined_with_their_idf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "FEW_TERMS", 5)
    docs, rows, v, idf = _stored(spark, tmp_path)
    assert idf is None
    got = vectors.cosines(v.where("doc_id >= 9"), v.where("doc_id < 9"))
    assert _pairs(got) == _pairs(vectors.cosines(rows.where("doc_id >= 9"), rows.where("doc_id < 9")))


def test_cosine_pairs_are_made_where_documents_are_stored(spark):
    """No term of a document is shuffled to meet those of leaders (F5)."""
    from textloom.plans import catalog

    text = catalog.cosine_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "word#" not in "".join(x for x in text.splitlines() if "Exchange" in x)


def test_queries_are_scored_where_documents_lie(spark, tmp_path, monkeypatch):
    """No row for a pair of a query and a document is shuffled, and results are those of the join (F7)."""
    texts = [(i, f"red w{i % 7} w{i % 5} fish{i % 90} " + "blue " * (i % 13)) for i in range(700)]
    index = blockmax.BlockMaxIndex.store(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(i, f"w{i % 7} blue fish{i} fish{i}") for i in range(20)], "q long, t string")
    terms = blockmax.parsed(asked, "q", "t")
    weighted = index.weighted(terms).localCheckpoint()
    wanted = index.bounds(weighted).localCheckpoint()
    few = index.scored(weighted, wanted, 5)
    text = few._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and not any("Exchange" in x and "word" in x for x in text.splitlines())
    monkeypatch.setattr(blockmax, "ROWS", 64)
    got = [sorted(map(tuple, index.search(terms, 5)[0].collect()))]
    assert index.scored(weighted, wanted, 5).count() < 20 * 700 / 2
    monkeypatch.setattr(blockmax, "FEW_TERMS", 0)
    got.append(sorted(map(tuple, index.search(terms, 5)[0].collect())))
    assert got[0] == got[1] and len(got[0]) == 100
