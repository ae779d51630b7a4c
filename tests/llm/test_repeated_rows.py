"""Operators 1 and 10 and the pipeline on tables whose ids or rows repeat."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import ann, near_dup
from tests.llm.conftest import prose
from tests.llm.test_groups import corpus, exact, groups

VECTORS = "vec_id long, embedding array<float>"

# Nearest neighbours


def test_repeated_vector_rows(spark):
    """Places among the best are for distinct ids, however often their rows repeat."""
    rows = [(i, [1.0, 0.5]) for i in range(1, 31) for _ in range(2)] + [(0, [0.5, 1.0])] * 3
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect())
    want = exact({**{i: [[1.0, 0.5]] for i in range(1, 31)}, 0: [[0.5, 1.0]]}, [0, 20], 20)
    assert got == [(q, n + 1, i, s) for q in (0, 20) for n, (i, s) in enumerate(want[q])]


def test_id_with_many_vectors(spark):
    """An id with more vectors than places takes one place, and others are still found."""
    near = [[1.0, 0.001 * j] for j in range(60)]
    rows = [(1, v) for v in near] + [(i, [0.001 * i, -1.0]) for i in range(2, 40)] + [(20, [1.0, 0.0])]
    vectors = {1: near, **{i: [[0.001 * i, -1.0]] for i in range(2, 40)}}
    vectors[20] = [*vectors[20], [1.0, 0.0]]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 20).collect())
    assert len(got) == 20 and [r[1] for r in got] == list(range(1, 21)) and len({r[2] for r in got}) == 20
    assert (got[0][2], got[0][3]) == exact(vectors, [20], 20)[20][0]


def test_best_counts_ids():
    x = np.array([[10.0 - i] for i in range(10)]).repeat(8, axis=0)
    ids = [[i // 8] for i in range(80)]
    got = ann.best(99, np.array([1.0]), np.arange(80), x, ids, 4)
    assert got == [(99, i, 10.0 - i) for i in range(4)]


def test_cell_holds_a_vector_of_all_tables():
    """In one cell each of 30 vectors stands in 8 tables; the best 20 ids come out of it."""
    rng = np.random.default_rng(3)
    x = (1 + 0.001 * rng.standard_normal((30, 4))).astype(np.float32)
    hasher = ann.Hasher(4, 8, 1, 50.0, 7)
    vectors = pa.array(x.tolist(), pa.list_(pa.float32()))
    index = list(ann._enter(hasher, 1, 3.0)(iter([pa.record_batch([vectors, pa.array([[i] for i in range(30)], pa.list_(pa.int64()))], ["embedding", "ids"])])))
    asked = list(ann._ask(hasher, 1, 3)(iter([pa.record_batch([pa.array([0]), vectors[:1]], ["vec_id", "embedding"])])))
    found = ann._search(20)(pa.Table.from_batches([*index, *asked])).to_pylist()
    score = x.astype(float) @ x[0].astype(float)
    want = sorted(range(1, 30), key=lambda i: (-score[i], i))[:20]
    assert [r["vec_id"] for r in found] == want

# Near duplicates


def check_groups(got, rows, width):
    want = groups(rows, width, 80)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, top, i == top) for i, (_, top) in want.items()}


def test_ids_with_several_texts(documents):
    """An id with several texts is linked with what any of them is near to."""
    a, b, c, d = (prose(700 + i, 120) for i in range(4))
    rows = [(5, a), (5, b), (6, a + " tail"), (7, b + " tail"), (8, c), (8, ""), (9, d)]
    rows += [(3, c), (12, d), (12, prose(710, 90)), (10, prose(710, 90) + " tail"), (13, prose(711, 90))]
    check_groups(near_dup.near_duplicates(documents(rows), 2, 80).collect(), rows, 2)


def test_crowds_with_several_texts(documents, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "CROWD", 5)
    rows = [r for r in corpus() if r[0] >= 200]
    rows += [(200 + i, prose(800 + i, 100)) for i in range(0, 80, 7)] + [(450 + i, prose(800 + i, 100) + " tail") for i in range(0, 80, 7)]
    rows += rows[:20]
    check_groups(near_dup.near_duplicates(documents(rows), 2, 80).collect(), rows, 2)


# Pipeline


def test_pipeline_keeps_one_row_of_an_id(spark, documents):
    a, b, c = (prose(720 + i, 120) for i in range(3))
    rows = [(1, a), (1, a), (2, b), (2, b), (2, b), (3, a + " tail"), (3, a + " tail"), (4, c), (None, c), (None, c), (None, None)]
    docs = documents(rows, "row n gone")
    near = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "")
    assert near.columns == docs.columns
    got = [(r.doc_id, r.text) for r in near.collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (4, c), (None, c), (None, c), (None, None)], key=repr)
    two = documents([(5, a), (5, b), (6, c)], "row n gone")
    least = min((a, b), key=lambda t: two.sparkSession.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    assert {(r.doc_id, r.text) for r in near_dup.one_of_each_id(two).collect()} == {(5, least), (6, c)}


def test_doubles_lengths_and_extremes(spark):
    """Scores are exact on doubles, very large and very small ones, and each length apart."""
    rng = np.random.default_rng(4)
    rows = [(i, (np.array([1.25, 0.5]) + 1e-9 * i).tolist()) for i in range(40)]
    rows += [(100, [1e300, 1.0]), (101, [1e-300, 1e-300]), (102, rng.random(3).tolist()), (120, rng.random(3).tolist())]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, cell string, rank string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for i, v in rows:
        by.setdefault(len(v), {})[i] = [v]
    want = []
    for held in by.values():
        for q in (q for q in held if q % 20 == 0):
            score = {i: float((np.array(v[0]) * np.array(held[q][0])).sum()) for i, v in held.items() if i != q}
            best = sorted(score, key=lambda i: (-score[i], i))[:20]
            want += [(q, n + 1, i, score[i]) for n, i in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_recall_on_the_given_vectors(spark):
    """Recall of the 20 best by brute force, through the buckets, at the chosen probes."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect() if r.embedding is not None}
    ids = sorted(x)
    m = np.array([x[i] for i in ids])
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in found:
        score = m @ x[q]
        order = [ids[j] for j in np.argsort(-score, kind="stable") if ids[j] != q][:20]
        hits.append(len(found[q] & set(order)) / 20)
    assert np.mean(hits) >= 0.9 and all(len(f) == 20 for f in found.values())


def test_fewer_probes_where_vectors_cluster():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32)) * 3
    clustered = centres[rng.integers(0, 60, 3000)] + 0.1 * rng.standard_normal((3000, 32))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    hasher = ann.Hasher(32, 8, 6, 1.0, 7)
    few, seen = ann.choose_probes(unit(clustered), hasher, 20, 0.95)
    many, all_seen = ann.choose_probes(unit(rng.standard_normal((3000, 32))), hasher, 20, 0.95)
    assert few < many and seen < min(0.3, all_seen)


def test_probes_follow_real_neighbours(spark, monkeypatch):
    """Crowded vectors: few probes find what is nearest of all; where none do, all are compared."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.standard_normal((300, 16)))
    x = unit(centres[rng.integers(0, 300, 6000)] + 0.05 * rng.standard_normal((6000, 16)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    asked = range(0, 6000, 20)
    score = x[list(asked)] @ x.T
    score[np.arange(len(score)), list(asked)] = -np.inf
    want = {q: set(np.argsort(-s)[:20].tolist()) for q, s in zip(asked, score)}

    def recall():
        got = ann.nearest(rows, F.col("vec_id") % 20 == 0).collect()
        assert len(got) == 20 * len(want)
        return np.mean([r.vec_id in want[r.query_id] for r in got])

    assert recall() >= 0.9
    monkeypatch.setattr(ann, "PROBES", (1,))
    monkeypatch.setattr(ann, "WIDTHS", (40,))
    assert recall() == 1.0
