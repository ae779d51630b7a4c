"""Operators 3, 7 and 9 against the libraries, on real and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import byte_bpe, distinct_words, pieces, token_counts, token_files
from textloom.llm.catalog_tokens import vocabulary

CLASHES = "ids start word chunk place bucket _part n_tokens"


@pytest.fixture(scope="module")
def rows(odd):
    rng = random.Random(11)
    pool = [chr(i) for i in [*range(0, 0x250), 0x300, 0x301, 0x2028, 0x3000, 0x200B, 0x1F600, 0x661, 0xFB01, 0x212B]] + [" "] * 90 + ["\n"] * 20
    made = [(100 + i, "".join(rng.choices(pool, k=rng.randint(1, 60)))) for i in range(300)]
    return odd + made


def by_id(got, rows):
    """Results in order of the rows, for rows whose id is their own."""
    own = {i: t or "" for i, t in rows if i is not None and i != 4}
    assert len(got) == len(rows)
    return [(own[r.doc_id], r) for r in got if r.doc_id in own]


def test_counts(documents, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = token_counts.count_tokens(documents(rows, CLASHES), vocabulary("byte_bpe_50k.json")).collect()
    for text, r in by_id(got, rows):
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert [r.n_tokens for r in got if r.doc_id == 4] == [1, 1]


def test_memos_keep_no_long_keys():
    made = []
    memo = pieces.Bounded(lambda key: made.append(key) or len(key), 3)
    long = "x" * (pieces.LONGEST + 1)
    assert [memo[k] for k in ["a", "a", long, long, "bb", "c", "d"]] == [1, 1, len(long), len(long), 2, 1, 1]
    assert made == ["a", long, long, "bb", "c", "d"]
    assert dict(memo) == {"d": 1}


def test_counts_of_long_unbroken_strings(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(i, f"a {chr(97 + i) * 500}{i} {'é' * 90} 日本{'語' * 200} end") for i in range(6)]
    got = token_counts.count_tokens(documents(rows), vocabulary("byte_bpe_50k.json")).collect()
    own = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(library.encode(own[r.doc_id], add_special_tokens=False).ids)


def test_encoding_and_decoding(documents, rows):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("t", pat_str=token_counts.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    docs = documents(rows, CLASHES)
    for text, r in by_id(byte_bpe.encode(docs, path).collect(), rows):
        assert r.ids == library.encode_ordinary(text)
    for text, r in by_id(byte_bpe.digests(docs, path).collect(), rows):
        packed = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_edges(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, path).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2
    with pytest.raises(Exception, match="IndexError|index"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), path).collect()


def test_files(spark, documents, rows, tmp_path):
    from tokenizers import Tokenizer

    path, out = vocabulary("word_bpe_49k.json"), str(tmp_path / "ids")
    library = Tokenizer.from_file(path)
    token_files.write_token_ids(documents(rows, CLASHES), path, out, end=2)
    start = {}
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        start.setdefault(i, at)
        at += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = token_files.read_token_ids(spark, out).collect()
    for text, r in by_id(got, rows):
        assert r.ids == library.encode(text, add_special_tokens=False).ids + [2] and r.start == start[r.doc_id]
    for text, r in by_id(token_files.checksums(spark, out).collect(), rows):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start[r.doc_id], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.doc_id for r in token_files.find_documents(spark, out, [5, 110, 99_999]).collect()} == {5, 110}
    plan = token_files.find_documents(spark, out, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan or "In(doc_id" in plan


def test_files_skip_rows(spark, documents, tmp_path):
    """Files hold row indexes and Bloom filters, and a lookup reads only the group of its row."""
    out = str(tmp_path / "ids")
    token_files.write_token_ids(documents([(2 * i, f"text {i}") for i in range(12_000)]), vocabulary("word_bpe_49k.json"), out, stride=1000)
    orc, path = spark._jvm.org.apache.orc.OrcFile, spark._jvm.org.apache.hadoop.fs.Path
    files = sorted(map(str, (tmp_path / "ids").glob("*.orc")))
    assert len(files) > 1
    for name in files:
        reader = orc.createReader(path(name), orc.readerOptions(spark._jsc.hadoopConfiguration()))
        stripes = reader.getStripes()
        streams = reader.rows().readStripeFooter(stripes.get(0)).getStreamsList()
        kinds = {(s.getColumn(), s.getKind().toString()) for s in streams}
        assert (1, "BLOOM_FILTER_UTF8") in kinds and {(c, "ROW_INDEX") for c in range(1, 5)} <= kinds
    for wanted, found in ((4_444, 1), (4_445, 0)):  # the second lies within the bounds of a group
        hit = token_files.find_documents(spark, out, [wanted])
        assert len(hit.collect()) == found
        scan = hit._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().get("numOutputRows").get().value()
        assert read <= 1000 if found else read == 0


def test_documents_over_ranges(spark, documents, tmp_path):
    """Runs of documents in many ranges, with repeated and null ids, come back whole."""
    from tokenizers import Tokenizer

    path, out = vocabulary("word_bpe_49k.json"), str(tmp_path / "ids")
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-50, 300)]), " ".join(rng.choices(["some", "words", "Here", "42"], k=rng.randint(0, 30)))) for _ in range(700)]
    token_files.write_token_ids(documents(rows).repartition(7), path, out)
    library = Tokenizer.from_file(path)
    want = sorted((i is not None, i or 0, library.encode(t, add_special_tokens=False).ids + [2]) for i, t in rows)
    got = token_files.read_token_ids(spark, out).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_tables(spark, documents, tmp_path):
    none = documents([(1, "x")]).limit(0)
    assert token_counts.count_tokens(none, vocabulary("byte_bpe_50k.json")).collect() == []
    assert byte_bpe.digests(none, vocabulary("byte_bpe_multi_50k.tiktoken")).collect() == []
    token_files.write_token_ids(none, vocabulary("word_bpe_49k.json"), str(tmp_path / "ids"))
    assert token_files.checksums(spark, str(tmp_path / "ids")).collect() == []


def test_chunks_and_blocks(documents, monkeypatch):
    """Many small chunks and blocks give the same ids as one."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = documents([(i, f"word{i % 7} and text {i}\n  and more" * (i % 5)) for i in range(200)])
    want = sorted((r.doc_id, r.ids) for r in byte_bpe.encode(docs, path).collect())
    for name, value in (("BLOCK", 30), ("SLICE", 50)):
        monkeypatch.setattr(distinct_words, name, value)
    blob = type("B", (), {"value": open(path, "rb").read()})
    monkeypatch.setattr(distinct_words, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())}))
    rows = docs.select("doc_id", "text").toArrow().to_batches()
    parts = list(distinct_words._explode(4, blob, byte_bpe._splitter, 100)(iter(rows)))
    parts.sort(key=lambda b: b.column(0)[0].as_py())
    coded = [b for b in distinct_words._encode(blob, byte_bpe._encoder)(iter(parts))]
    import pyarrow as pa

    whole = pa.Table.from_batches(coded)
    got = []
    for chunk in whole["chunk"].unique().to_pylist():
        out = distinct_words._reassemble(None, None, 1 << 20)(whole.filter(pa.compute.equal(whole["chunk"], chunk)))
        got += list(zip(out["doc_id"].to_pylist(), out["ids"].to_pylist()))
    assert len(whole["chunk"].unique()) > 3 and sorted(got) == want
