"""Operators 1, 2, 5 and 10 against brute force, held-out labels and edges."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions.runtime import materialize
from textloom.llm import ann, components, line_dedup, near_dup, resampling
from textloom.llm.components import connected_components
from tests.llm.conftest import prose

CLASHES = "rep key component h1 signature _key _cut _ranges start stop rank n_grams kept"

# Near duplicates


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) or frozenset([tuple(ws)])


def groups(rows, width, percent):
    """doc_id to (set size, least id reachable), comparing all pairs."""
    sets = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            sets[i].append(shingles(t, width))
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = find(a), find(b)
                        top[max(p, q)] = min(p, q)
    return {i: ({len(s) for s in sets[i]}, find(i)) for i in ids}


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def corpus():
    """Unrelated texts, copies, groups of near copies around a base, and chains of edits."""
    rows = [(i, prose(i, 60 + i)) for i in range(60)]
    rows += [(100 + i, prose(7, 67)) for i in range(30)]
    base = prose(500, 120)
    rows += [(200 + i, edited(base, i, 0.01 * (i % 9))) for i in range(80)]
    chain = prose(501, 200)
    for i in range(25):
        chain = edited(chain, 900 + i, 0.02)
        rows.append((300 + i, chain))
    rows += [(400, "ONE"), (401, "one"), (402, "two words"), (403, "Two  WORDS"), (404, "x y z"), (405, "É é"), (406, "é é")]
    return rows


@pytest.mark.parametrize("width, percent", [(2, 80), (5, 80), (3, 60)])
def test_groups_by_brute_force(documents, width, percent):
    rows = corpus()
    got = near_dup.near_duplicates(documents(rows, CLASHES), width, percent).collect()
    want = groups(rows, width, percent)
    assert len(got) == len(rows)
    if percent == 80:  # the signatures' distance is made for this similarity
        for r in got:
            assert ({r.n_shingles}, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    else:
        assert all(r.component_id >= want[r.doc_id][1] for r in got)


def test_blocks_and_crowds(documents, monkeypatch):
    """The third round finds the same when its blocks are tiny."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "CROWD", 5)
    rows = [r for r in corpus() if r[0] >= 200]
    want = groups(rows, 2, 80)
    got = near_dup.near_duplicates(documents(rows), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: w[1] for i, w in want.items()}


def test_near_duplicate_edges(documents, odd):
    docs = documents(odd, CLASHES)
    got = near_dup.near_duplicates(docs, 2, 80).collect()
    assert len(got) == len(odd)
    assert all(r.component_id == r.doc_id and r.kept for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    kept = near_dup.drop_near_duplicates(docs, 2, 80)
    assert kept.columns == docs.columns and kept.count() == len(odd)
    none = documents([(1, "x")]).limit(0)
    assert near_dup.near_duplicates(none).collect() == [] and near_dup.drop_near_duplicates(none).collect() == []
    copies = documents([(3, "a b c"), (1, "A b c"), (2, "a b d")])
    assert {r.doc_id for r in near_dup.drop_near_duplicates(copies, 2, 80).collect()} == {1, 2}


def test_index_finds_all_pairs_within_the_distance():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (200, near_dup.SYMBOLS), np.uint8)
    other = base.copy()
    for row in other:
        at = rng.choice(near_dup.SYMBOLS, rng.integers(0, near_dup.DISTANCE + 1), replace=False)
        row[at] = row[at] + 1 + rng.integers(0, 255, len(at)).astype(np.uint8)
    a, b = near_dup.index_keys(base), near_dup.index_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        top[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got}
    assert all(got[x] == find(x) for x in got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """Few edges are contracted in one task; several partitions go through rounds to the same end."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, 500 + i % 7) for i in range(100, 180)], "a long, b long")
    want = {(i, 0) for i in range(61)} | {(i, 100 + (i - 100) % 7) for i in range(100, 180)} | {(500 + i % 7, 100 + (i - 100) % 7) for i in range(100, 107)}
    made = []
    monkeypatch.setattr(components, "materialize", lambda df: made.append(1) or materialize(df))
    assert {tuple(r) for r in connected_components(edges).collect()} == want
    assert len(made) == 2
    monkeypatch.setattr(components, "EDGES", 30)
    assert {tuple(r) for r in connected_components(edges).collect()} == want
    assert len(made) > 5


# Line dedup


def runs_deleted(rows, most):
    """Lines of each document that a repeated run of ``most`` words holds, by brute force."""
    docs = []
    for i, t in sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, line_dedup.text_hash(r[1]))):
        docs.append((i, t, [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(t.split("\n")) if x.encode().split()]))
    seen, gone = set(), defaultdict(set)
    places = []
    for d, (_, _, lines) in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.encode().split()) for _, x in lines[a:b]) >= most:
                    places.append((d, a, b, tuple(x for _, x in lines[a:b])))
    for d, a, b, content in sorted(places, key=lambda p: p[:2]):
        if content in seen:
            gone[d] |= set(range(docs[d][2][a][0], docs[d][2][b - 1][0] + 1))
        seen.add(content)
    return {(i, t): gone[d] for d, (i, t, _) in enumerate(docs)}


def line_corpus():
    rng = random.Random(4)
    lines = [prose(i, rng.choice([1, 3, 8, 20, 45]), 50) for i in range(40)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for i in range(60)]
    long = prose(99, 60)
    rows += [(100, long), (101, "before\n" + long + "\nafter"), (102, long + " "), (103, "\n".join([long] * 3)), (99, "x " + long)]
    return rows


def test_lines_by_brute_force(documents):
    rows = line_corpus()
    docs = documents(rows, CLASHES)
    want = runs_deleted(rows, 50)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) for (i, t), gone in want.items()}
    cut = line_dedup.dedup_lines(docs, 50)
    got = {r.doc_id: r[cut.columns[-1]].text for r in cut.collect()}
    assert got == texts
    left = line_dedup.drop_repeated_lines(docs, 50)
    assert left.columns == docs.columns
    words = {r.doc_id for r in left.collect()}
    assert words == {i for i, t in texts.items() if t.split()}


def test_line_edges(documents, odd):
    docs = documents(odd, CLASHES)
    left = line_dedup.drop_repeated_lines(docs, 50)
    assert left.count() == len(odd) and sorted(map(repr, left.collect())) == sorted(map(repr, docs.collect()))
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []
    twice = documents([(1, prose(1, 60)), (1, prose(1, 60)), (1, "other " + prose(2, 60)), (2, prose(1, 60))])
    assert sorted(r.doc_id for r in line_dedup.drop_repeated_lines(twice).collect()) == [1, 1, 1]


def test_lines_are_cut_once(documents, monkeypatch):
    """One evaluation a row, of a few rows at once, whatever filter stands above it."""
    left = line_dedup.drop_repeated_lines(documents(line_corpus()), 50)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_cut_lines(") == 1
    texts = pa.array([None, "", *(f"{prose(i, 20)}\n{prose(i + 1, 9)}" for i in range(20))], pa.string())
    starts = pa.array([[i % 2] if i % 3 else None for i in range(len(texts))], pa.list_(pa.int32()))
    stops = pa.array([[1] if i % 3 else None for i in range(len(texts))], pa.list_(pa.int32()))
    starts, stops, texts = starts[3:], stops[3:], texts[3:]
    whole = line_dedup._cut_lines(texts, starts, stops)
    seen = []
    rows = line_dedup._cut_rows
    monkeypatch.setattr(line_dedup, "_cut_rows", lambda *c: seen.append(len(c[0])) or rows(*c))
    monkeypatch.setattr(line_dedup, "ROWS", 4)
    assert line_dedup._cut_lines(texts, starts, stops).equals(whole) and max(seen) == 4 and sum(seen) == len(texts)
    assert len(line_dedup._cut_lines(texts[:0], starts[:0], stops[:0])) == 0


# Resampling


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 2 = 0")
    got = resampling.resample(docs, labels.where("doc_id % 2 = 1"))
    assert got.count() == docs.count()
    rates = {r.quality: r.rate for r in got.join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.97 and rates[0] <= 0.1


def test_resampling_by_brute_force(documents, spark):
    rows = [(i, prose(i, 30)) for i in range(40)] + [(50 + i, "zz yy " * 20) for i in range(10)] + [(90, None), (91, " "), (None, "null id")]
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(50, 0), (None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    got = resampling.resample(documents(rows, CLASHES), labels, share=0.5).collect()
    buckets = {i: resampling.features(t) for i, t in rows}
    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for i, f in buckets.items():
        np.add.at(raw, f, 1)
        if i is not None and i < 20:
            np.add.at(target, f, 1)
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in got:
        f = buckets[r.doc_id]
        assert r.n_grams == len(f)
        assert r.log_weight is None if not len(f) else abs(r.log_weight - 100 * w[f].mean()) < 1e-9
    assert sorted(r.rank for r in got) == list(range(len(rows)))
    assert {r.rank for r in got if r.kept} == set(range(round(0.5 * 51)))
    assert not any(r.kept for r in got if r.doc_id in (90, 91))
    none = documents(rows).limit(0)
    assert resampling.resample(none, labels).collect() == []
    assert resampling.resample(documents(rows), labels.limit(0)).where("kept").count() == 51


def test_resampling_keys_and_edges(documents, spark):
    """Chosen rows are those of the largest Gumbel keys, computed here from a hash of ids."""
    from pyspark.sql import functions as F

    rows = [(i, prose(i, 5 + i % 40)) for i in range(300)] + [(400, ""), (401, prose(9, 60_000)), (402, "x" * 200_000)]
    rows += [(7, "other text of a repeated id"), (7, prose(7, 12)), (7, prose(7, 12))]
    labels = spark.createDataFrame([(i, i % 3 and 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    docs = documents(rows, CLASHES)
    for length in (100, None):
        got = resampling.resample(docs, labels, share=0.3, seed=5, length=length).collect()
        assert len(got) == len(rows)
        ids = spark.createDataFrame([(r.doc_id,) for r in got], "doc_id long").distinct()
        unit = {r.doc_id: ((r.h % 2**52) + 0.5) / 2.0**52 for r in ids.select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("h")).collect()}
        gumbel = {i: -np.log(-np.log(u)) for i, u in unit.items()}
        worded = [r for r in got if r.log_weight is not None]
        order = sorted(worded, key=lambda r: -(r.log_weight + gumbel[r.doc_id]))
        k = round(0.3 * len(worded))
        assert sum(r.kept for r in got) == k and not any(r.kept for r in got if r.n_grams == 0)
        least = min(r.log_weight + gumbel[r.doc_id] for r in got if r.kept)
        assert abs(least - (order[k - 1].log_weight + gumbel[order[k - 1].doc_id])) < 1e-9
    plain = {(r.doc_id, r.n_grams): r.log_weight for r in got}
    scaled = resampling.resample(docs, labels, share=0.3, seed=5).collect()
    for r in scaled:
        if r.n_grams:
            assert abs(r.log_weight * r.n_grams / 100 - plain[r.doc_id, r.n_grams]) < 1e-6 * max(1, abs(plain[r.doc_id, r.n_grams]))


# Nearest neighbours


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        scored = defaultdict(lambda: -np.inf)
        for own in vectors[q]:
            for i, vs in vectors.items():
                if i != q:
                    for v in vs:
                        scored[i] = max(scored[i], float((np.array(v, np.float32).astype(float) * np.array(own, np.float32).astype(float)).sum()))
        out[q] = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # many equal vectors
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [float("nan")]), (2004, [1.0] * 15 + [float("inf")])]
    odd += [(2005, [1.0] * 15 + [None]), (2006, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = exact({i: [v] for i, v in rows}, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += sum(s >= want[q][-1][1] - 1e-9 for _, _, s in found)
    assert hits / (20 * len(got)) >= 0.9
    copies = [f[1] for f in got[1000] if f[1] == 40 or f[1] > 1000]
    assert copies == [40, *range(1001, 1060)][: len(copies)]


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, [-1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, -4.0]), (4, [9.0, 9.0])]
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()))
    want = exact({i: [v] for i, v in rows}, [0, 20], 20)
    assert got == [(q, k + 1, i, s) for q in (0, 20) for k, (i, s) in enumerate(want[q])]
    twice = [(0, [1.0, 2.0]), (0, [-1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, -4.0]), (3, [1.0, 1.0])]
    found = ann.nearest(spark.createDataFrame(twice, schema), F.col("vec_id") % 20 == 0).collect()
    products = {(a, b): {x[0] * y[0] + x[1] * y[1] for i, x in twice if i == a for j, y in twice if j == b} for a in (0, 20) for b in (0, 20, 3)}
    assert len(found) == 4 and all(r.score in products[r.query_id, r.vec_id] for r in found)
    for few in ([], rows[:1], [(5, [0.0, 0.0])]):
        assert ann.nearest(spark.createDataFrame(few, schema), F.col("vec_id") % 20 == 0).collect() == []


def test_shifts_come_in_order():
    offset = np.array([0.1, 0.5, 0.8])
    got = ann.shifts(offset, 27)
    cost = [sum(offset[j] ** 2 if m < 0 else (1 - offset[j]) ** 2 for j, m in enumerate(row) if m) for row in got.tolist()]
    assert cost == sorted(cost) and len({tuple(r) for r in got.tolist()}) == len(got) == 27


def test_winnowing_stores_selected_lines_only():
    """Fewer fingerprints than lines; equal runs of enough words always share one."""
    rng = random.Random(8)
    line = lambda: prose(rng.random(), rng.randint(3, 14), 5_000)
    shared = [line() for _ in range(12)]
    texts = ["\n".join([*(line() for _ in range(rng.randint(0, 20))), *shared, *(line() for _ in range(9))]) for _ in range(20)]
    found = [line_dedup.fingerprints(t, 50) for t in texts]
    assert sum(map(len, found)) < 0.6 * sum(t.count("\n") + 1 for t in texts)
    assert set.intersection(*({p["print"] for p in f} for f in found))
    for text, prints in zip(texts, found):
        lines = text.split("\n")
        for p in prints:
            assert p["lines"][p["spot"]] == p["at"]
            for a, b in zip(p["windows"][::2], p["windows"][1::2]):
                assert sum(len(lines[i].split()) for i in p["lines"][a : b + 1]) >= 50 and a <= p["spot"] <= b


def test_matches_are_extended_both_ways():
    """What the first place explains comes as one run, the rest as windows with a hash."""
    import pyarrow as pa

    rng = random.Random(9)
    lines = [prose(rng.random(), 20, 5_000) for _ in range(9)]
    first, later = "\n".join(["x", *lines[:6]]), "\n".join([*lines, "y"])
    one = {p["print"]: p for p in line_dedup.fingerprints(first, 50)}
    rows = []
    for p in line_dedup.fingerprints(later, 50):
        if p["print"] in one:
            q = one[p["print"]]
            rows.append({"doc_id": 2, "text_hash": 0} | p | {"first_spot": q["spot"], "first_digests": q["digests"]})
    assert rows
    got = [r for b in line_dedup._extend(iter(pa.Table.from_pylist(rows).to_batches())) for r in b.to_pylist()]
    covered = {i for r in got if r["hash"] is None for i in range(r["start"], r["stop"] + 1)}
    assert covered and covered <= set(range(6))
    assert all(r["stop"] > 5 for r in got if r["hash"] is not None)
    a = b"".join(bytes([c]) * 16 for c in b"abcdef")
    assert line_dedup.agree(a, 2, b"".join(bytes([c]) * 16 for c in b"xbcdz"), 2) == (1, 3)
