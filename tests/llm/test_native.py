"""Operators 4, 6 and 8: oracles, brute force and edges."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import catalog, mixing, quality_rules, sharding
from tests.llm.conftest import prose

CLASHES = "_chunk _row size row host _key _own _times copies target _host kept n_words"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(compare, name):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated(ws):
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


def test_measures_by_brute_force(documents, odd):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["x\nx\n\n \nx\ny", "#* $ <b> |", "a a a a a", "a b c a b c"]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    got = quality_rules.quality_rules(documents(rows, CLASHES)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t, *_ in rows:
        ws, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        want[i].append(
            (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(ws))
        )
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_hosts(documents):
    good = [(i, prose(i, 80), "good") for i in range(40)]
    bad = [(100 + i, prose(i, 80) if i < 4 else "spam " * 60, "bad") for i in range(40)]
    mixed = [(200 + i, "short" if i < 10 else prose(i, 80), None) for i in range(40)]
    docs = documents(good + bad + mixed, CLASHES)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    assert kept == set(range(40)) | set(range(210, 240))
    passed = quality_rules.keep_passing(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept
    # A host with one failing document is shrunk towards the others, not rejected.
    lone = documents(good + [(300, "short", "new"), (301, prose(301, 90), "new")])
    assert 301 in {r.doc_id for r in quality_rules.quality_rules(lone).collect() if r.kept}


def test_empty_tables(documents):
    none = documents([(1, "x")]).limit(0)
    assert quality_rules.quality_rules(none).collect() == []
    assert quality_rules.keep_passing(none).collect() == []
    assert sharding.shard_rows(none).collect() == []
    assert mixing.plan_mix(none).collect() == [] and mixing.mix_documents(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 100, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    walk = sharding.longest_walk(spark, n, "k")
    got = spark.range(n).select(sharding.permute(F.col("id"), n, "k", walk).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    other = spark.range(n).select(sharding.permute(F.col("id"), n, "other", sharding.longest_walk(spark, n, "other")).alias("p"))
    assert n < 40 or [r.p for r in other.collect()] != [r.p for r in got]


def test_shards(documents, odd):
    rows = odd + [(1000 + i, prose(i, 5)) for i in range(200)]
    got = sharding.shard_rows(documents(rows, CLASHES), 40).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    raw = {i: (t or "").encode() for i, t in rows if i not in (None, 4)}
    assert all((r["size"], r.text_crc32) == (len(raw[r.doc_id]) + 16, zlib.crc32(raw[r.doc_id])) for r in got if r.doc_id in raw)
    assert sorted(map(repr, got)) == sorted(map(repr, sharding.shard_rows(documents(rows), 40).collect()))


def mixture(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    left = float(total)
    while left > 1e-9 and open_:
        heavy = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / heavy for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return sizes, target


def test_mixing_by_brute_force(documents):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(600)]
    rows += [(5000, None, "z"), (5001, " ", "z"), (None, prose(1, 9), "a"), (7, prose(7, 50), "a"), (7, prose(8, 50), "a")]
    docs = documents(rows, CLASHES)
    sizes, target = mixture(rows)
    plan = mixing.plan_mix(docs).collect()
    taken = Counter()
    for r in plan:
        assert 0 <= r.copies <= 3 and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r["size"]
    assert len(plan) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * 200
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    emitted = Counter()
    for r in out.collect():
        emitted[r.source] += len(words(r.text))
        assert r.size == "kept as it is"
    assert +emitted == +taken
