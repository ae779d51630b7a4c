"""Token ids in ORC files.

Rows lie in ascending order of ``doc_id`` over all files. A row holds the id of a document,
its place in the order, its ids and their number. Integers are run-length encoded by the format; stripes
and row groups carry minima and maxima of document ids and a Bloom filter on them, so that
looking up documents reads few stripes, and a scan runs over stripes in parallel.

The tokenizer drops white space and none of its pre-tokens spans it, so what white space
parts is encoded word by word, each distinct one of the corpus once. Documents then go by
range of id to the task that writes the range's file.

Defined results: a null text is encoded as empty and holds only the end id; null ids come
first; rows with equal ids lie next to each other in any order; columns besides ``doc_id``
and ``text`` are not read; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.runtime import small_enough
from textloom.llm.distinct_words import encode_words, unpack_run
from textloom.llm.pieces import read_vocabulary

#: Files whose first positions are sent to all tasks; beyond it they are joined.
FEW_FILES = 100_000
SCHEMA = "doc_id long, place long, n_ids int, ids array<int>"
#: Positions of a chunk of documents whose words are encoded together.
CHUNK = 6_000_000
#: Documents in a file, about.
FILE_ROWS = 250_000


#: Fixed value: the tokenizer's pre-tokens, once its normalizer has lowered a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Characters below U+0180 but one: lowering such text leaves it composed, whatever library
#: lowers it.
_SIMPLE = re.compile("[\\x00-\u012f\u0131-\u017f]*")


#: Pieces of letters that are one word, whose lower case is the same in any library.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Stands between pieces whose words are found together.
_BETWEEN = "\n"


def _splitter(blob: bytes) -> tuple[Callable, Callable]:
    """Pieces between ASCII white space, and the normalized words of pieces.

    Pieces of plain letters are lowered in Arrow; other simple ones are joined, lowered and
    searched together. A piece that holds an added token, or a word that normalizing would
    change once more, is a word as it stands.
    """
    tokenizer = _tokenizer(blob)
    normal, find = tokenizer.normalizer.normalize_str, regex.compile(WORDS).findall
    find_all = regex.compile(f"{_BETWEEN}|{WORDS}").findall
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def simple(text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and not any(c in text for c in added)

    def words(piece: str) -> list[str]:
        if any(c in piece for c in added):
            return [piece]
        found = find(normal(piece))
        return [piece] if any(normal(w) != w for w in found) else found

    def pieces_of(texts: pa.Array) -> pa.ListArray:
        # Empty pieces, of white space at the ends, have no words.
        return pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))

    def words_of(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        letters = pa.compute.match_substring_regex(pieces, _LETTERS)
        plain = pa.compute.utf8_lower(pieces.filter(letters))
        rest = pieces.filter(pa.compute.invert(letters)).to_pylist()
        odd = [] if simple("".join(rest)) else [i for i, p in enumerate(rest) if not simple(p)]
        kinds = np.where(letters.to_numpy(zero_copy_only=False), 0, 1)
        joined = rest
        if odd:
            kinds[np.nonzero(kinds)[0][odd]] = 2
            strange = set(odd)
            joined = [p for i, p in enumerate(rest) if i not in strange]
        found = find_all(_BETWEEN.join(joined).lower())
        marks = [-1, *(i for i, w in enumerate(found) if w == _BETWEEN), len(found)]
        others = [words(rest[i]) for i in odd]
        # Pieces go in order of their kind.
        order = np.argsort(kinds, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = [np.ones(len(plain), np.int64), np.diff(marks)[: len(joined)] - 1, np.fromiter(map(len, others), np.int64, len(others))]
        parts = [[w for w in found if w != _BETWEEN], [w for run in others for w in run]]
        parts = [plain.cast(pa.binary()), *(pa.array(x, pa.string()).cast(pa.binary()) for x in parts)]
        return pa.concat_arrays(parts), np.concatenate(sizes), place

    return pieces_of, words_of


def _tokenizer(blob: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(blob.decode("utf-8"))


#: Lowered words that normalizing leaves alone and that are one pre-token between blanks.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")


def _encoder(blob: bytes) -> Callable[[list[bytes]], list[bytes]]:
    """Plain words are encoded in one text and parted after each id that ends a word."""
    tokenizer = _tokenizer(blob)
    encode = tokenizer.encode_batch_fast
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def together(words: list[str]) -> list[bytes]:
        ids = np.array(encode([" ".join(words)], add_special_tokens=False)[0].ids, "<i4")
        stops = (np.nonzero(ends[ids])[0] + 1).tolist()
        if len(stops) != len(words):
            raise ValueError("a word of plain characters is not one run of ids")
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops)]

    def many(words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8") for w in words]
        out: dict[str, bytes] = {}
        plain = [t for t in texts if _PLAIN.fullmatch(t)]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            out.update(zip(part, together(part)))
        odd = [t for t in texts if t not in out]
        out.update(zip(odd, (array("i", x.ids).tobytes() for x in encode(odd, add_special_tokens=False))))
        return [out[t] for t in texts]

    return many


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end: int = 2, stride: int = 10_000) -> None:
    """Encode every whole text of ``docs`` and write the files below ``path``.

    Row indexes and Bloom filters have an entry for each ``stride`` rows.

    Their number grows with that of documents. The bounds of their ranges of ids, one number
    a file, come from a scan of the ids alone, before texts are read.
    """
    spark = docs.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_ROWS))
    steps = [i / files for i in range(1, files)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, max(100_000, 100 * files))).first()[0] if steps else []
    ranges = np.unique(np.array(bounds or [], np.int64))
    largest = max(_tokenizer(read_vocabulary(vocabulary)).get_vocab_size(), end)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(batch.num_rows):
                run = batch.slice(part, 1).to_pylist()[0]
                yield from unpack_run(pa.array(run["doc_ids"], pa.int64()), np.array(run["counts"]), run["ids"], largest)

    encoded = encode_words(docs, _splitter, _encoder, vocabulary, end, ranges=ranges, largest=largest, chunk=CHUNK, in_arrow=True)
    (
        encoded.repartitionById(files, F.col("part"))
        .mapInArrow(unpack, "doc_id long, ids array<int>")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .select("doc_id", F.monotonically_increasing_id().alias("place"), F.size("ids").alias("n_ids"), "ids")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .orc(path)
    )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))


def _starts(spark: SparkSession, path: str, rows: DataFrame, size: str) -> DataFrame:
    """``rows`` (file, place and a ``size``, narrow) with ``start``, the sizes of all before.

    Places ascend over files as well as in them, so files follow each other by their least
    place. What each file holds is one row a file; they are sent to all tasks if they are few.
    """
    base = _rows(spark, path).groupBy("file").agg(F.min("place").alias("least"), F.sum(F.col("n_ids").cast("long")).alias("held"))
    base = base.select("file", (F.sum("held").over(Window.orderBy("least")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("file").orderBy("place")
    start = F.col("base") + F.sum(size).over(inside) - F.col(size)
    return rows.join(small_enough(base, FEW_FILES), "file").withColumn("start", start)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: all documents, ``start`` being the ids of all documents before."""
    rows = _rows(spark, path)
    narrow = rows.select("file", "place", F.col("n_ids").cast("long").alias("n"))
    starts = _starts(spark, path, narrow, "n").select("place", "start")
    return rows.join(starts, "place").select("doc_id", "start", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of some documents; stripes are skipped by statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(sizes), pa.array(sums, pa.int64())],
                ["doc_id", "file", "place", "n_tokens", "ids_crc32"],
            )

    summed = _rows(spark, path).select("doc_id", "file", "place", "ids").mapInArrow(
        run, "doc_id long, file string, place long, n_tokens long, ids_crc32 long"
    )
    return _starts(spark, path, summed, "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")
