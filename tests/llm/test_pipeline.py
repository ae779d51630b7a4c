"""The pipeline's stages and its whole against brute force."""

import hashlib

import numpy as np

import corpus_pipeline
from textloom.llm import byte_bpe, token_counts
from textloom.llm.catalog_tokens import vocabulary
from tests.llm.conftest import prose
from tests.llm.test_groups import groups, runs_deleted
from tests.llm.test_native import repeated, words


def test_stages(spark, documents):
    rows = [(i, prose(i, 90), f"s{i % 3}") for i in range(30)]
    rows += [(100, prose(1, 90), "s0"), (101, "short", "s1"), (102, "ab cd " * 60, "s2"), (103, None, None), (104, prose(3, 89) + " tail", "s0")]
    rows += [(105, prose(200, 70) + "\n" + prose(5, 90), None)]
    docs = documents(rows, "extra")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "mix_sources", "byte_bpe"]
    stage = dict(corpus_pipeline.STAGES)

    after = stage["quality_rules"](spark, docs, "")
    kept = [r for r in rows if len(words(r[1])) >= 50 and 2 * repeated(words(r[1])) <= len(words(r[1]))]
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == {r[0] for r in kept}

    lines = stage["line_dedup"](spark, after, "")
    gone = runs_deleted(kept, 50)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut) for (i, t), cut in gone.items()}
    texts = {i: t for i, t in texts.items() if t.split()}
    assert lines.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    assert 100 not in texts and texts[105] == prose(200, 70)

    near = stage["minhash_near_dedup"](spark, lines, "")
    want = {i for i, (_, top) in groups(list(texts.items()), 5, 80).items() if i == top}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want and 104 not in want

    mixed = stage["mix_sources"](spark, near, "")
    assert mixed.columns == docs.columns
    taken = [(r.doc_id, r.text) for r in mixed.collect()]
    assert {i for i, _ in taken} <= want and len(taken) > 0

    check_tokens(stage["byte_bpe"](spark, mixed, "").collect(), taken)


def check_tokens(got, taken):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("t", pat_str=token_counts.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in taken:
        packed = np.array(library.encode_ordinary(t), "<u4").tobytes()
        want.append((i, len(packed) // 4, packed, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.text_sha256) for r in got) == sorted(want)


def test_stages_of_nothing(spark, documents):
    none = documents([(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids", "text_sha256"] and got.count() > 100
