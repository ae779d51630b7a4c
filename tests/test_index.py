import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import encodings as E
from textloom.operators import indexbuild as I
from textloom.sources import store


@pytest.mark.parametrize("gap, code", [(1, "81"), (127, "ff"), (128, "0081"), (300, "2c82"), (16384, "000081")])
def test_gap_bytes(gap, code):
    assert E.encode_gap(gap).hex() == code


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.sets(st.integers(1, 2**28 - 1), min_size=1)), max_size=5))
def test_records_round_trip(rows):
    rows = [(w, sorted(d)) for w, d in rows]
    assert list(E.decode_records(b"".join(E.encode_record(w, d) for w, d in rows))) == rows


def test_gap_out_of_range():
    for gap in (0, -1, 1 << 28):
        with pytest.raises(ValueError):
            E.encode_gap(gap)


def test_postings_frames(spark):
    rows = [(123423, [1, 343, 3455, 23657]), (97743, [56, 655, 764, 34546])]
    lists = spark.createDataFrame(rows, "word_id long, doc_ids array<long>")
    back = E.decode_postings(E.encode_postings(lists)).collect()
    assert sorted((r.word_id, r.doc_ids) for r in back) == sorted(rows)


def test_front_coding(spark):
    words = {"abds": 1, "abdgdg": 2, "abdxxd": 3, "abdwere": 4}
    df = spark.createDataFrame(list(words.items()), "word string, word_id long")
    blocks = sorted(tuple(r) for r in E.front_code(df).collect())
    assert blocks == [(0, "abd", [2, 1, 4], ["gdg", "s", "were"]), (1, "abdxxd", [3], [""])]
    assert {r.word: r.word_id for r in E.front_decode(E.front_code(df)).collect()} == words
    assert E.read_dictionary(E.dictionary_bytes([b[1:] for b in blocks])) == words


def test_buckets():
    assert [I.bucket_of(w) for w in ("apple", "Echo", "hat", "zoo", "é")] == ["a-d", "e-g", "h-p", "q-z", "a-d"]


def test_batches(spark):
    sizes = [4, 4, 4, 20, 4, 30, 1]
    files = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, bytes long")
    got = [(r.doc_id, r.batch) for r in I.batches(files, 10, 15).orderBy("doc_id").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 2), (4, 1), (5, 3), (6, 1)]
    assert I.batches(files.limit(0), 10, 15).count() == 0


def test_words_of_a_batch_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"apple w{i % 3} w{i}") for i in range(12)], "doc_id long, text string")
    cut = I.batches(docs.select("doc_id", F.length("text").cast("long").alias("bytes")), 40, 1000)
    words = I.batch_words(docs, cut)
    spilled = I.segments(words)
    got = {(r.batch, r.word): r.doc_ids for r in spilled.collect()}
    assert got[0, "apple"] == [0, 1, 2, 3] and got[0, "w0"] == [0, 3] and got[2, "w11"] == [11]
    # Only texts are shuffled: a join by id and the deal by batch lie below the words.
    plan = spilled._jdf.queryExecution().sparkPlan().toString()
    above = spilled._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Generate" in plan and "Exchange" not in above
    r = I.build_stats(docs, words, cut).first()
    assert (r.batches, r.mapped, r.unique_words) == (3, len(got), 13)


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, "apple zoo", "a.txt"), (1, "Zoo", "b.txt"), (2, "été 9", "c.txt")], "doc_id long, text string, name string")
    index = I.StoredIndex.build(docs, str(tmp_path / "i"))
    assert sorted((r.doc_id, r.name) for r in index.query("ZOO").collect()) == [(0, "a.txt"), (1, "b.txt")]
    assert index.query("none").collect() == [] and index.query("ZOO", case_sensitive=True).collect() == []
    assert {r.word: r.word_id for r in index.read("lexicon").collect()} == {"apple": 1, "zoo": 2}
    plan = index.read("postings").where("bucket = 'q-z' AND word = 'zoo'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(word,zoo)" in plan


def test_save_and_append(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "word string, doc_id long")
    store.save(df, str(tmp_path / "p"), "word")
    store.append(df.limit(1), str(tmp_path / "p"), "word")
    assert store.load(spark, str(tmp_path / "p")).count() == 3


def test_saved_rows_are_computed_once(spark, tmp_path):
    """Sorting the files costs no pass over the rows to sample them; files are sorted, a key lies in one (F23)."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ids = spark.range(0, 1000, 1, 4).select((F.col("id") * 7 % 250).alias("id"), F.col("id").alias("n"))
    store.save(ids.mapInArrow(run, "id long, n long"), str(tmp_path / "p"), ["id", "n"])
    assert seen.value == 1000
    files = [[tuple(r) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "p").glob("*.parquet")]
    assert all(rows == sorted(rows) for rows in files) and sum(map(len, files)) == 1000
    assert sum(len({r[0] for r in rows}) for rows in files) == 250


def test_saved_index_holds_lists(spark, tmp_path, monkeypatch):
    """A word has a row for each part of the texts, not for each document, and a lookup asks the files for it (F23)."""
    from textloom.plans import catalog

    monkeypatch.setattr(catalog, "scratch", lambda spark, kind: str(tmp_path / kind))
    found = catalog.QUERIES["saved_index"](spark, "/root/testdata/sf0.001")
    saved = store.load(spark, str(tmp_path / "saved")).where("word = 'that'")
    assert 0 < saved.count() <= spark.sparkContext.defaultParallelism < found.count()
    assert "EqualTo(word,that)" in found._jdf.queryExecution().executedPlan().toString()


SHUFFLED_ONCE = {"enc_gaps": 1, "xml_tokens": 0, "perm_docs": 3}


@pytest.mark.parametrize("name", sorted(SHUFFLED_ONCE))
def test_words_are_not_shuffled_again(spark, name):
    """Shuffles by a word and a document together, and how often words are shuffled in all."""
    from textloom.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in by if "doc_id" in line and "word" in line]
    assert sum("hashpartitioning(word" in line for line in by) <= SHUFFLED_ONCE[name]
