"""Plain-text directories as document frames."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.runtime import dealt, materialize


def write_texts(rows: DataFrame, path: str, levels: list[str]) -> None:
    """A file for each text of ``rows`` (text, *levels) in folders ``level=value`` below ``path``.

    Rows with equal levels go to one file, each with a line feed. In a folder that tasks see as
    a local one they write the files themselves: Spark's writers open each through Hadoop, which
    starts processes for its permissions, and move it twice. Elsewhere Spark's writer is taken.
    """
    parts = dealt(rows.select("text", *levels), *levels)
    if urlsplit(path).scheme not in ("", "file"):
        plain = parts.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        plain.partitionBy(*levels).text(path)
        return
    root = unquote(urlsplit(path).path) if path.startswith("file:") else path

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, n = None, None, 0
        for batch in batches:
            texts, *values = (c.to_pylist() for c in batch.columns)
            for text, *at in zip(texts, *values):
                if at != now:
                    if out:
                        out.close()
                    named = ("__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else quote(str(v), safe=" ") for v in at)
                    folder = os.path.join(root, *[f"{k}={v}" for k, v in zip(levels, named)])
                    os.makedirs(folder, exist_ok=True)
                    now, out, n = at, open(f"{folder}/part-0.txt", "wb"), n + 1
                out.write(text.encode() + b"\n")
        if out:
            out.close()
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    parts.sortWithinPartitions(*levels).mapInArrow(put, "n long").agg(F.sum("n")).collect()


#: Characters that Spark's paths keep, bytes of files and of lines handed on at once, and files of a task.
KEPT, HANDED, FILES = "/,;:$&+=@!*'()-_.~", 8 << 20, 2_000


def local_path(path: str) -> str | None:
    """The path of a folder or file that tasks see as a local one; None for others, and for patterns."""
    scheme = urlsplit(path).scheme
    if scheme not in ("", "file") or (not path.startswith("file:") and re.search(r"[*?\[{]", path)):
        return None
    return unquote(urlsplit(path).path) if scheme else path


def _url(path: str) -> str:
    return "file:" + "".join(c if ord(c) > 127 and c.isprintable() else quote(c, safe=KEPT) for c in path)


def _shown(name: str) -> bool:
    """Whether Spark's readers take a file or folder of this name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def listed(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """at, bytes: the files of a local folder, listed by tasks, a level of folders at a time.

    As by Spark's readers, empty files and those with hidden names are left out.
    Neither the driver nor a task holds the list: a folder's entries are rows when they are read.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["at", "bytes"])

        for batch in batches:
            out = []
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as found:
                    for x in found:
                        if _shown(x.name):
                            out.append((x.path, -1 if x.is_dir() else x.stat().st_size))
                        if len(out) >= FILES:
                            yield handed(out)
                            out = []
            if out:
                yield handed(out)

    if not os.path.isdir(path):
        return spark.createDataFrame([(path, os.path.getsize(path))], "at string, bytes long")
    levels = []
    folders = spark.createDataFrame([(path,)], "at string")
    while True:
        level = materialize(folders.mapInArrow(entries, "at string, bytes long"))
        levels.append(level.where("bytes > 0"))
        count = level.where("bytes < 0").count() if recursive else 0
        if not count:
            return reduce(DataFrame.unionByName, levels)
        folders = level.where("bytes < 0").select("at").repartition(_tasks(spark, count))


def _tasks(spark: SparkSession, files: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-files // FILES))


def _opened(spark: SparkSession, at: str, recursive: bool, make: Callable, made: str) -> DataFrame:
    """name, path, bytes and what ``make(path)`` yields of each file, a value a row."""
    files = listed(spark, at, recursive)
    files = files.repartition(_tasks(spark, files.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                url = _url(path)
                name = url.rsplit("/", 1)[1]  # quoted as by Spark's readers
                for value in make(path):
                    rows.append((name, url, size, value))
                    held += len(value) + len(url) + len(name) + 16
                    if held >= HANDED:
                        yield handed(rows)
                        rows, held = [], 0
            if rows:
                yield handed(rows)

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["name", "path", "bytes", made])

    # As Spark's reader, bytes are taken for UTF-8 without a test.
    rows = files.mapInArrow(read, f"name string, path string, bytes long, {made} binary")
    return rows.withColumn(made, F.col(made).cast("string"))


def _whole(path: str) -> Iterator[bytes]:
    with open(path, "rb") as file:
        yield file.read()


def _lines(path: str) -> Iterator[bytes]:
    """Lines of a file, which ends with its last one or with that one's end."""
    rest = b""
    with open(path, "rb") as file:
        while part := file.read(HANDED):
            part = rest + part
            # A carriage return at the end may belong to a line feed.
            last = b"\r" if part.endswith(b"\r") else b""
            *whole, rest = part[: len(part) - len(last)].replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
            rest += last
            yield from whole
    if rest:
        yield rest.removesuffix(b"\r")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """name, path, bytes, text: one row a file, each read once.

    Of a folder that tasks see as a local one they list and read the files themselves: Spark's
    reader holds the list of all files in the driver. Elsewhere Spark's reader is taken.
    """
    at = local_path(path)
    if at is not None:
        return _opened(spark, at, recursive, _whole, "text")
    whole = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True)
    meta = F.col("_metadata")
    return whole.select(
        meta["file_name"].alias("name"),
        meta["file_path"].alias("path"),
        meta["file_size"].alias("bytes"),
        F.col("value").alias("text"),
    )


def file_ids(spark: SparkSession, path: str, recursive: bool = True, first_id: int = 0) -> DataFrame:
    """path, doc_id: ids go folder by folder, by path; no file is opened."""
    at = local_path(path)
    if at is not None:
        files = listed(spark, at, recursive).mapInArrow(_urls, "path string")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        files = found.select(F.col("_metadata.file_path").alias("path"))
    files = materialize(files.select("path", F.regexp_extract("path", "^(.*/)", 1).alias("_folder")))
    # Ranges of the order, numbered by the rows of those before: no task holds more than one.
    parts = files.repartitionByRange(_tasks(spark, files.count()), "_folder", "path").sortWithinPartitions("_folder", "path")
    placed = materialize(parts.select("path", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return order.select("path", (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first_id).alias("doc_id"))


def _urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(map(_url, batch.column(0).to_pylist()), pa.string())], ["path"])


def read_texts(spark: SparkSession, path: str, recursive: bool = True, first_id: int = 0) -> DataFrame:
    """doc_id, name, path, bytes, text: ``read_files`` with ``file_ids``."""
    order = file_ids(spark, path, recursive, first_id)
    return read_files(spark, path, recursive).join(order, "path").select("doc_id", "name", "path", "bytes", "text")


def read_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """name, path, line: lines end at \\n, \\r or both; no file is held as a whole. Files are found as by ``read_files``."""
    at = local_path(path)
    if at is not None:
        return _opened(spark, at, recursive, _lines, "line").drop("bytes")
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    meta = F.col("_metadata")
    return lines.select(meta["file_name"].alias("name"), meta["file_path"].alias("path"), F.explode(F.split("value", "\r")).alias("line"))
