"""Byte-level BPE by one global shuffle of distinct words.

Pre-tokens are exploded with their positions, each distinct one of the corpus is encoded
once, and ids are joined back and reassembled by position, as ``distinct_words`` tells.
Decoding joins ids with the token-byte table, whose size is that of the vocabulary.

Defined results: null texts are empty and have no ids; null ids of documents stay null and
ids may repeat; columns besides ``doc_id`` and ``text`` are not read; an empty table gives
an empty result; null or empty id lists decode to empty; an id outside the table is an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.distinct_words import Chunk, encode_words, take_runs
from textloom.llm.pieces import cut, once, read_vocabulary, strings
from textloom.llm.token_counts import PRE_TOKENS


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes to ranks from a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def _splitter(_: bytes) -> Callable:
    find = regex.compile(PRE_TOKENS).findall

    def start(chunk: Chunk) -> Callable:
        plain = chunk.memo(lambda p: [w.encode("utf-8") for w in find(p)])
        blank = chunk.memo(lambda p: [w.encode("utf-8") for w in find(" " + p)])

        def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            pieces: list[int] = []
            ends = [0]
            for text in strings(texts):
                whole, parts = cut(text)
                pieces.extend(map(plain.__getitem__, whole))
                pieces.extend(map(blank.__getitem__, parts))
                ends.append(len(pieces))
            return np.array(pieces, np.int64), np.diff(ends)

        return split

    return start


def _encoder(blob: bytes) -> Callable[[list[bytes]], list[bytes]]:
    import tiktoken

    ranks = read_ranks(blob)
    encode = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda words: [array("i", encode(w.decode("utf-8"))).tobytes() for w in words]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of ``docs``."""
    return encode_words(docs, _splitter, _encoder, vocabulary)


class _TokenBytes:
    def __init__(self, blob: bytes):
        ranks = read_ranks(blob)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, table), np.int64, len(table)))])


_DECODED = "doc_id long, packed_ids binary, decoded binary"


def _decoder(blob: bytes) -> Callable[[pa.Table], pa.Table]:
    """Turns doc_id, ids into doc_id, packed_ids (little-endian, 32 bits), decoded."""
    table = _TokenBytes(blob)

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for batch in rows.to_batches():
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(1)
                sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text, at = take_runs(table.flat, table.ends, ids)
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                columns = [part.column(0), _binaries(ids.astype("<u4"), ends * 4), _binaries(text, at[ends])]
                out.append(pa.record_batch(columns, ["doc_id", "packed_ids", "decoded"]))
        names = [("doc_id", pa.int64()), ("packed_ids", pa.binary()), ("decoded", pa.binary())]
        return pa.Table.from_batches(out, pa.schema(names))

    return run


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, packed_ids (little-endian 32-bit ids), decoded (bytes) of rows with doc_id, ids."""
    blob = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = once("decoder", blob.value, _decoder)
        for batch in batches:
            yield from decoder(pa.Table.from_batches([batch])).to_batches()

    return encoded.select("doc_id", "ids").mapInArrow(run, _DECODED)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, packed_ids, decoded of every row of ``docs``: ids, and what they decode to.

    Like ``decode`` after ``encode``, in one pass over the ids.
    """
    return encode_words(docs, _splitter, _encoder, vocabulary, finish=_decoder, finish_schema=_DECODED)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw, offsets = pa.py_buffer(values.tobytes()), pa.py_buffer(ends.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, raw])


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 after encoding and decoding ``docs``."""
    return encode_decode(docs, vocabulary).select(
        "doc_id",
        (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
