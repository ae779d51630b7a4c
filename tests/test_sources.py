from textloom.sources import fb2, text
from textloom.streaming import ingest

BOOK = """<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>
<genre>sci_fi</genre><genre>space</genre><author><first-name>Jane</first-name><last-name>O'Neil</last-name></author>
</title-info></description><body><section><p>Red <b>fish</b></p><p>blue fish</p></section></body></FictionBook>"""


def test_books(spark):
    parsed = fb2.parse_books(spark.createDataFrame([(7, BOOK)], "doc_id long, xml string"))
    got = sorted((r.zone, r.word) for r in fb2.book_words(parsed).collect())
    assert got == sorted(
        [(0, "red"), (0, "fish"), (0, "blue"), (0, "fish"), (1, "jane"), (1, "o'neil"), (2, "sci"), (2, "fi"), (2, "space")]
    )


def test_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes(b"one\r\ntwo\rthree\n")
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "sub" / "c.txt").write_text("deep")
    rows = {r.name: (r.doc_id, r.bytes, r.text) for r in text.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": (0, 1, "x"), "b.txt": (1, 15, "one\r\ntwo\rthree\n"), "c.txt": (2, 4, "deep")}
    assert {r.doc_id for r in text.read_texts(spark, str(tmp_path), first_id=1).collect()} == {1, 2, 3}
    lines = [r.line for r in text.read_lines(spark, str(tmp_path / "b.txt")).collect()]
    assert [x for x in lines if x] == ["one", "two", "three"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "red fish"), (1, "blue fish")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = ingest.stream_documents(spark, str(tmp_path / "in"))
    ingest.append_postings(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.word, r.doc_id) for r in got.select("word", "doc_id").collect()) == [("blue", 1), ("fish", 0), ("fish", 1), ("red", 0)]


def test_written_texts(spark, tmp_path):
    """Folders of texts are written without a Hadoop writer a file: no checksum files, no job commit (F2 to F5)."""
    rows = [("one", "en", 0), ("two\nlines", "a b/c", 1), ("", None, 2), ("again", "en", 0)]
    at = f"file://{tmp_path}/out"
    text.write_texts(spark.createDataFrame(rows, "text string, lang string, doc_id long"), at, ["lang", "doc_id"])
    names = [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert names == ["part-0.txt"] * 3
    assert sorted(r.text for r in text.read_files(spark, at).collect()) in (["\n", "again\none\n", "two\nlines\n"], ["\n", "one\nagain\n", "two\nlines\n"])
    assert sorted(r.doc_id for r in text.file_ids(spark, at, first_id=5).collect()) == [5, 6, 7]
    assert {r.path for r in text.file_ids(spark, at).collect()} == {r.path for r in text.read_files(spark, at).collect()}


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no list of the files, and rows are those of Spark's reader (F6, F8, F9)."""
    texts = {"b c.txt": b"one\r\ntwo\rthree\n", "a%é.txt": b"x\r", "lang=en/doc_id=1/part-0.txt": "ü\n\n".encode(), "lang=en/doc_id=10/p+.txt": b"", "_no/x.txt": b"no", ".no.txt": b"no", "lang=en/_SUCCESS": b"no", "z/y/w.txt": b"\xff\r\r\nlast", "_k=1/v.txt": b"k"}
    for name, content in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {}
    for at in (str(tmp_path), f"file://{tmp_path}"):
        frames = [text.read_files(spark, at), text.file_ids(spark, at), text.read_lines(spark, at), text.read_files(spark, at, recursive=False)]
        assert not any("FileScan" in f._jdf.queryExecution().executedPlan().toString() for f in frames)
        frames[0] = frames[0].withColumn("text", frames[0]["text"].cast("binary"))
        frames[2] = frames[2].withColumn("line", frames[2]["line"].cast("binary")).where("line <> X''")
        got[at] = [sorted(map(tuple, f.select(sorted(f.columns)).collect())) for f in frames]
    assert got[str(tmp_path)] == got[f"file://{tmp_path}"]
    rows, ids, lines, flat = got[str(tmp_path)]
    assert len(rows) == 5 and len(flat) == 2
    order = sorted((p.rsplit("/", 1)[0] + "/", p) for _, _, p, _ in rows)
    assert [p for _, p in sorted((n, p) for n, p in ids)] == [p for _, p in order] and sorted(n for n, _ in ids) == list(range(5))
    monkeypatch.setattr(text, "HANDED", 2)
    small = text.read_lines(spark, str(tmp_path)).collect()
    monkeypatch.setattr(text, "local_path", lambda path: None)
    theirs = text.read_files(spark, str(tmp_path))
    assert sorted(map(tuple, theirs.select("bytes", "name", "path", theirs["text"].cast("binary")).collect())) == rows
    of_spark = text.read_lines(spark, str(tmp_path))
    # Splitting replaces bytes that are not UTF-8; they are kept where tasks read.
    assert sorted((r.line, r.name, r.path) for r in of_spark.collect() if r.line) == sorted((bytes(x).decode("utf-8", "replace"), n, p) for x, n, p in lines)
    assert sorted(r.line for r in small) == sorted(r.line for r in of_spark.collect())
    assert sorted((r.doc_id, r.path) for r in text.file_ids(spark, str(tmp_path)).collect()) == ids
