"""Operators 11 to 13 against SQL, brute force and edges."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import catalog_audit, components, conversations, divergence, simhash
from tests.llm.conftest import prose

# Source divergence


def test_divergence_oracle(compare):
    name = "op11_source_divergence"
    compare(catalog_audit.QUERIES[name], catalog_audit.ORACLES[name])


def divergence_rows(rows, least_docs, top):
    """The audit of (lang, source, text) rows, by dictionaries."""
    import re
    from collections import Counter

    counts, docs, named = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        clean = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", clean)
        named.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, sources in named.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(of):
            n = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (of[t] + 1) // n for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            best = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in ("pair", pairs), ("term", best):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"WIDE": 3, "LEFT": 2, "FEW_GROUPS": 0, "HELD": 50, "SLICE": 20}])
def test_divergence_edges(spark, monkeypatch, odd, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "É", None, ""]), prose(i, 30, 60) + " Ab aB é") for i in range(120)]
    rows += [("xx", "only", t) for _, t in odd] + [("yy", "p", None), ("yy", "q", ""), ("yy", "q", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("place", F.lit("x")).withColumn("p", F.lit(1))
    got = sorted(tuple(r) for r in divergence.divergence(docs, 3, 10).collect())
    assert got == divergence_rows(rows, 3, 10)
    assert divergence.divergence(docs.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text, width=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    found = [b" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps, ids, bits=3):
    """Of each row the least id among those reachable over links, comparing all pairs."""
    arr = np.array(fps, np.uint64)
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            top[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, least_reachable(fps, [i for i, _ in docs])))
    assert sorted(tuple(r) for r in catalog_audit.QUERIES["op13_simhash"](spark, sf).collect()) == want


@pytest.mark.parametrize("size", [simhash.SLICE, 7])
def test_simhash_edges(spark, documents, odd, monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)
    rows = odd + [(20, "One Two three four"), (19, "one\ttwo THREE  four"), (21, "a b c"), (22, "a b")]
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows] == fps
    got = simhash.near_duplicates(documents(rows, "fp n least top component which cell")).collect()
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, least_reachable(fps, [i for i, _ in rows]))]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(documents([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("crowd, bits", [(simhash.CROWD, 3), (5, 3), (5, 0), (9, 1)])
def test_simhash_links_lose_none(spark, crowd, bits):
    rng = random.Random(crowd + bits)
    fps = [0, 1, 7, 15, (1 << 64) - 1]
    for _ in range(40):
        chain = rng.getrandbits(64)
        for _ in range(12):
            fps.append(chain)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                chain ^= 1 << b
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(df, bits, crowd).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= bits for r in found)
    at = {f: i for i, f in enumerate(fps)}
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for r in found:
        a, b = find(at[r.a & mask]), find(at[r.b & mask])
        top[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == least_reachable(fps, range(len(fps)), bits)


def test_partitions_of_links_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES", 500)
    chain = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = components._dealt(chain.toDF("u", "v").coalesce(1), 9)
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * components.EDGES
    got = components.connected_components(chain)
    assert got.count() == 4001 and got.where("component <> 0").isEmpty()


# Conversations


def brute_repair(rows):
    """Result of one conversation's damaged rows in order, by a search over whole strings."""
    import hashlib
    import re

    seen, kinds = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        fault = None
        if not stripped:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif stripped[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append(fault)
    # By initials read so far: the cheapest (cost, audit, roles and texts); shorter pasts are
    # merged by the pattern's state only.
    legal = re.compile("(s?(ua)*u?)?")

    def state(initials):
        return initials[-1:] if initials else ""

    def push(layer, item):
        cost, audit, initials, out = item
        if legal.fullmatch(initials) and (state(initials) not in layer or item[:2] < layer[state(initials)][:2]):
            layer[state(initials)] = item
            return True
        return False

    def inserted(layer):
        todo = list(layer.values())
        while todo:
            cost, audit, initials, out = todo.pop()
            for role in ("user", "assistant"):
                item = (cost + 5, audit + "I", initials + role[0], out + [(role, "")])
                if push(layer, item):
                    todo.append(item)
        return layer

    layer = {"": (0, "", "", [])}
    for (_, role, text), fault in zip(rows, kinds):
        new = {}
        for cost, audit, initials, out in inserted(dict(layer)).values():
            push(new, (cost + 2, audit + "D", initials, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role:
                    push(new, (cost + more, audit + "K", initials + role[0], out + [(role, text)]))
                for other in ("user", "assistant"):
                    push(new, (cost + more + 1, audit + "R", initials + other[0], out + [(other, text)]))
        layer = new
    ends = [x[:2] + (x[3],) for x in inserted(layer).values() if re.fullmatch("(s?(ua)+)?", x[2])]
    cost, audit, out = min(ends)
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def brute_conversations(rows):
    import re
    import zlib

    by_id = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by_id.setdefault(conv, []).extend([(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(map(repr, ((c, *brute_repair(sorted(rs, key=key))) for c, rs in by_id.items())))


def test_conversations_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalog_audit.QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_conversations(rows)


@pytest.mark.parametrize("size", [conversations.CHUNK, 3, 1])
def test_conversations_edges(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "CHUNK", size)
    monkeypatch.setattr(conversations, "FEW_RUNS", size)
    rng = random.Random(size)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "no end", "", None, " \t", "why? \n", "ä.", "Yes.\x85"]
    rows = [
        (rng.choice([*range(25), None]), rng.choice([*range(40), None, -3]), rng.choice(roles[: 3 + rng.randrange(7)]), f"{rng.choice(texts)}" if rng.random() < 0.3 else rng.choice(texts) or None)
        for _ in range(700)
    ]
    rows += rows[:40] + [(100, i, "ua"[i % 2] + "ser", f"t{i}.") for i in range(60)] + [(101, i, "system", "s.") for i in range(20)]
    rows += [(200 + i, t, "user", "a.") for i in range(8) for t in range(1)] + [(300, None, "user", None), (301, 5, "user", "x" * 50_000 + ".")]
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'x' AS `{c}`" for c in "key run pos chunk codes fault tail cost same".split()])
    got = conversations.damage_and_repair(frame).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_conversations(rows)
    assert conversations.damage_and_repair(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hot, few", [(5, 20_000), (5, 1), (1, 1)])
def test_conversations_hot_and_texts_not_stored(spark, monkeypatch, hot, few):
    stored = []
    materialize = conversations.materialize
    monkeypatch.setattr(conversations, "materialize", lambda df: stored.extend(df.columns) or materialize(df))
    monkeypatch.setattr(conversations, "HOT", hot)
    monkeypatch.setattr(conversations, "FEW_RUNS", few)
    rng = random.Random(hot + few)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(60), None]), rng.choice(["user", "assistant", None]), rng.choice(["a.", "b", "", "c!"])) for _ in range(200)]
    rows += [(9, None, "user", "x."), (9, None, "assistant", "y."), (10, 1, "user", "z.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.damage_and_repair(frame).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_conversations(rows)
    assert stored and "text" not in stored
