"""Compressed postings and a front-coded dictionary.

Postings: gaps between ascending ids, each as 7-bit groups, lowest first, with the high bit
set on the last byte; a record is the word id in four bytes, the gaps, and 0x80. Lengths are
column expressions; bytes are made in Arrow batches. Dictionary: sorted words in blocks,
each with the common prefix of its words and their rests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.strings import common_prefix
from textloom.functions.ordering import chunked_row_number
from textloom.functions.runtime import materialize
from textloom.sources.store import load, save

#: End of a record, words of a dictionary block, largest gap (exclusive).
END, BLOCK_WORDS, GAP_LIMIT = 0x80, 3, 1 << 28


def gaps(postings: DataFrame) -> DataFrame:
    """word, doc_id, gap: distance from the word's document before, or from 0."""
    order = Window.partitionBy("word").orderBy("doc_id")
    return postings.withColumn("gap", F.col("doc_id") - F.lag("doc_id", 1, 0).over(order))


def gap_array(doc_ids: Column) -> Column:
    """array<long>: gaps of an ascending array of ids."""
    return F.transform(doc_ids, lambda x, i: x - F.coalesce(F.get(doc_ids, i - 1), F.lit(0)))


def gap_length(gap: Column) -> Column:
    """Bytes of an encoded gap."""
    return F.when(gap < 1 << 7, 1).when(gap < 1 << 14, 2).when(gap < 1 << 21, 3).otherwise(4)


def encode_gap(gap: int) -> bytes:
    return _gap_bytes(np.array([gap]))[0].tobytes()


def _gap_bytes(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of encoded gaps, and how many each has."""
    if len(steps) and not (steps.min() > 0 and steps.max() < GAP_LIMIT):
        raise ValueError(f"gap out of range: {steps.min()} or {steps.max()}")
    size = 1 + (steps >= 1 << 7) + (steps >= 1 << 14) + (steps >= 1 << 21)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        part = (steps[has] >> (7 * k)) & 127
        out[place[has] + k] = np.where(size[has] == k + 1, part | 128, part)
    return out, size


def encode_records(word_ids: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all records, and the size of each: word k has the next ``counts[k]`` ids."""
    ends = np.cumsum(counts)
    steps = np.diff(flat, prepend=0)
    first = (ends - counts)[counts > 0]
    steps[first] = flat[first]
    body, size = _gap_bytes(steps)
    held = np.concatenate([[0], np.cumsum(size)])
    inside = held[ends] - held[ends - counts]
    sizes = inside + 5
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(4):
        out[start + k] = (word_ids >> (8 * k)) & 255
    out[np.arange(len(body)) + np.repeat(start + 4 - (np.cumsum(inside) - inside), inside)] = body
    out[start + sizes - 1] = END
    return out, sizes


def encode_record(word_id: int, doc_ids: Iterable[int]) -> bytes:
    """A posting record; ids are distinct, ascending and at least 1."""
    ids = np.fromiter(doc_ids, np.int64)
    return encode_records(np.array([word_id]), ids, np.array([len(ids)]))[0].tobytes()


def decode_records(data: bytes) -> Iterator[tuple[int, list[int]]]:
    """(word id, ids) of each record of a stream. Inside a record the end's byte is no part
    of a gap: the last byte of a gap holds its highest bits, which are not all 0."""
    at = 0
    while at < len(data):
        end = data.index(END, at + 4)
        body = np.frombuffer(data, np.uint8, end - at - 4, at + 4).astype(np.int64)
        stop = np.nonzero(body & 128)[0]
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        place = np.arange(len(body)) - np.repeat(start, stop - start + 1)
        steps = np.add.reduceat((body & 127) << (7 * place), start) if len(stop) else body
        yield int.from_bytes(data[at : at + 4], "little"), np.cumsum(steps).tolist()
        at = end + 1


def encode_postings(lists: DataFrame) -> DataFrame:
    """word_id, record (binary) of rows with word_id, doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().astype(np.int64)
            counts = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            raw, sizes = encode_records(batch.column(0).to_numpy(), flat, counts)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            records = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            yield pa.record_batch([batch.column(0), records], ["word_id", "record"])

    return lists.select(F.col("word_id").cast("long"), "doc_ids").mapInArrow(run, "word_id long, record binary")


def decode_postings(records: DataFrame) -> DataFrame:
    """word_id, doc_ids of rows with a record each, or several in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for data in batch.column(0).to_pylist() for r in decode_records(data)]
            columns = list(zip(*rows)) or [[], []]
            yield pa.record_batch(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))], ["word_id", "doc_ids"]
            )

    return records.select("record").mapInArrow(run, "word_id long, doc_ids array<long>")


def save_postings(records: DataFrame, path: str) -> None:
    """Write records to files, in order of the word ids, so that a lookup reads few of them."""
    save(records, path, "word_id")


def read_postings(spark: SparkSession, path: str, word_ids: list[int] | None = None) -> DataFrame:
    """word_id, doc_ids of saved records, of some words or all."""
    records = load(spark, path)
    return decode_postings(records if word_ids is None else records.where(F.col("word_id").isin(word_ids)))


def front_code(words: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """block, prefix, word_ids, suffixes: sorted words in blocks of ``size``.

    ``words`` has word, word_id. In a sorted block the prefix that all share is the one of
    the first and last word.
    """
    chunked = materialize(words.select("word", "word_id", F.substring("word", 1, 2).alias("_chunk")))
    ranked = chunked_row_number(chunked, [], "_chunk", [F.col("word")], "rank")
    rows = ranked.withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    grouped = rows.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("word", "word_id"))).alias("rows"),
        common_prefix(F.min("word"), F.max("word")).alias("prefix"),
    )
    return grouped.select(
        "block",
        "prefix",
        F.transform("rows", lambda r: r["word_id"]).alias("word_ids"),
        F.transform("rows", lambda r: F.substring(r["word"], F.length("prefix") + 1, F.length(r["word"]))).alias("suffixes"),
    )


def front_decode(blocks: DataFrame) -> DataFrame:
    """word, word_id of front-coded blocks."""
    rows = blocks.select("prefix", F.explode(F.arrays_zip("suffixes", "word_ids")).alias("r"))
    return rows.select(F.concat("prefix", F.col("r.suffixes")).alias("word"), F.col("r.word_ids").alias("word_id"))


def dictionary_block(prefix: str, rests: list[str]) -> bytes:
    """A block: one byte for the length of its first word in UTF-16 units, the prefix, FF FF,
    the rest; then length and rest of each further word."""
    units = lambda x: x.encode("utf-16-le")
    length = lambda rest: bytes([len(units(prefix + rest)) // 2])
    first = length(rests[0]) + units(prefix) + b"\xff\xff" + units(rests[0])
    return first + b"".join(length(rest) + units(rest) for rest in rests[1:])


def dictionary_rows(blocks: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """block, position, ids (binary, padded with 0), body (binary) of front-coded blocks.

    Positions are sums over all blocks before, taken in chunks of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, prefix, ids, rests = (batch.column(k).to_pylist() for k in range(4))
            table = [np.array([*i, *[0] * (size - len(i))], "<u4").tobytes() for i in ids]
            body = list(map(dictionary_block, prefix, rests))
            columns = [pa.array(block, pa.int64()), pa.array(table, pa.binary()), pa.array(body, pa.binary())]
            yield pa.record_batch([*columns, pa.array(map(len, body), pa.int64())], ["block", "ids", "body", "n"])

    coded = blocks.select("block", "prefix", "word_ids", "suffixes").mapInArrow(run, "block long, ids binary, body binary, n long")
    coded = materialize(coded.withColumn("_chunk", F.floor(F.col("block") / 100_000).cast("long")))
    inside = Window.partitionBy("_chunk").orderBy("block")
    held = coded.groupBy("_chunk").agg(F.sum("n").alias("held"))
    before = held.select("_chunk", (F.sum("held").over(Window.orderBy("_chunk")) - F.col("held")).alias("before"))
    position = F.sum("n").over(inside) - F.col("n") + F.col("before")
    return coded.join(before, "_chunk").select("block", position.alias("position"), "ids", "body")


def dictionary_head(blocks: int, size: int = BLOCK_WORDS) -> bytes:
    """Header of a dictionary file: words of a block, number of blocks."""
    return size.to_bytes(4, "little") + blocks.to_bytes(4, "little")


def dictionary_bytes(blocks: list[tuple[str, list[int], list[str]]], size: int = BLOCK_WORDS) -> bytes:
    """A whole dictionary file of (prefix, word ids, suffixes): header, table, blocks.

    All numbers are 32-bit little-endian. A row of the table is the position of the block in
    what follows, and its ids padded with 0. For dictionaries that fit one process; frames
    of any size are ``dictionary_rows``.
    """
    bodies = [dictionary_block(prefix, rests) for prefix, _, rests in blocks]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    table = [[p, *ids, *[0] * (size - len(ids))] for p, (_, ids, _) in zip(at.tolist(), blocks)]
    return b"".join([dictionary_head(len(blocks), size), np.array(table, "<u4").tobytes(), *bodies])


def read_dictionary(data: bytes) -> dict[str, int]:
    """word to id of a dictionary file."""
    number = lambda at: int.from_bytes(data[at : at + 4], "little")
    size, count = number(0), number(4)
    start = 8 + count * 4 * (size + 1)
    out = {}
    for b in range(count):
        row = 8 + b * 4 * (size + 1)
        at = start + number(row)
        ids = [number(row + 4 * (i + 1)) for i in range(size)]
        length, at = data[at], at + 1
        mark = at
        while data[mark : mark + 2] != b"\xff\xff":
            mark += 2
        prefix = data[at:mark]
        at = mark + 2
        for k, word_id in enumerate(i for i in ids if i):
            if k:
                length, at = data[at], at + 1
            rest = 2 * length - len(prefix)
            out[(prefix + data[at : at + rest]).decode("utf-16-le")] = word_id
            at += rest
    return out
