"""Encoding texts word by word, each distinct word of the corpus once.

1. Explode. Where texts are scanned, runs of documents (chunks) are split into words. A
   chunk numbers its distinct words and deals them to buckets by a hash of their bytes, one
   packed row for each bucket; in place of its texts it writes the numbers in order of
   position, compressed, in blocks of whole documents.
2. Encode. Rows are shuffled by bucket, so that all mentions of a word meet in one run of
   rows, where each distinct word of the corpus is encoded once.
3. Reassemble. Ids go back by chunk, where the blocks' numbers are replaced by the ids of
   their words, position by position.

What is shuffled is a word for each chunk that holds it and about two bytes a position. A
chunk is bounded by its number of positions and its bytes, except that a document is never split. A hot
word is one entry a chunk. The number of buckets is that of shuffle partitions, a task has
one bucket, and its table of words forgets all when it has grown too large. The partitions of the scan make the chunks,
so the documents should be a table as it is read; rows are never matched by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.pieces import once, read_vocabulary, tidy

#: Positions after which a chunk ends, and a block inside it.
CHUNK, BLOCK = 2_000_000, 250_000
#: Bytes of text that are split at a time, and in a chunk for each of its positions at most.
SLICE, LONG = 10_000_000, 16
#: Bytes of words and ids that a task remembers; it starts anew beyond them, and words that
#: come again are encoded again.
FORGET = 400_000_000
_EXPLODED = pa.schema(
    [
        ("bucket", pa.int32()),
        ("chunk", pa.int64()),
        ("slots", pa.binary()),
        ("words", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)
_EXPLODED_SQL = (
    "bucket int, chunk long, slots binary, words binary, doc_ids array<long>, counts array<int>, payload binary"
)


def take_runs(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate runs ``values[ends[i]:ends[i + 1]]`` for i in ``at``; with their ends."""
    starts, sizes = ends[at], ends[at + 1] - ends[at]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(out[-1]) + np.repeat(starts - out[:-1], sizes)], out


def _planes(numbers: np.ndarray, kind: np.dtype) -> bytes:
    """Bytes of little-endian numbers, all lowest ones first."""
    return numbers.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(numbers: np.ndarray) -> bytes:
    """Compress small numbers."""
    return zstandard.compress(_planes(numbers, np.dtype("<u4")), 3)


def unpack(payload: bytes) -> np.ndarray:
    return _from_planes(zstandard.decompress(payload), np.dtype("<u4")).astype(np.int64)


def pack_runs(parts: list[bytes]) -> bytes:
    """Compress byte strings, with their lengths in front."""
    return _packed_runs(np.fromiter(map(len, parts), np.uint32, len(parts)), b"".join(parts))


def _packed_runs(sizes: np.ndarray, raw: bytes) -> bytes:
    return zstandard.compress(np.uint32(len(sizes)).tobytes() + sizes.astype(np.uint32).tobytes() + raw, 3)


def unpack_runs(packed: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, all bytes) of ``pack_runs``."""
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


def leave_out_new(numbers: np.ndarray, known: int) -> np.ndarray:
    """0 for the first mention of a word, which has the next number, else number + 1.

    ``known`` words have been mentioned before.
    """
    most = np.maximum.accumulate(np.concatenate([[known - 1], numbers]))
    return np.where(numbers > most[:-1], 0, numbers + 1)


def put_new_back(coded: np.ndarray, known: int) -> np.ndarray:
    """Inverse of ``leave_out_new``."""
    new = coded == 0
    return np.where(new, known - 1 + np.cumsum(new), coded - 1)


class Memo(dict):
    """A table that learns what it is asked for."""

    def __init__(self, learn: Callable):
        self.learn = learn

    def __missing__(self, key):
        value = self[key] = self.learn(key)
        return value


class _Slots(dict):
    """Numbers of words, in order of their first mention."""

    def __init__(self):
        self.count = 0

    def __missing__(self, word):
        number = self[word] = self.count
        self.count += 1
        return number


class Chunk:
    """Distinct words of the documents read since the last chunk ended.

    ``memo`` makes a table from pieces of texts to their numbers in this chunk, given the
    function from a piece to its words, as str or bytes. Pieces must be learned in the order
    in which texts mention them.
    """

    def __init__(self, number: int):
        self.number = number
        self.slots = _Slots()
        self.learned = 0
        self.words: list[int] = []  # of pieces learned since the last block
        self.sizes_of: list[int] = []
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.positions = self.blocks = self.known = self.bytes = 0
        self._new_block()

    def _new_block(self) -> None:
        self.ids, self.sizes, self.pieces, self.waiting = [], [], [], 0

    def memo(self, words_of: Callable) -> Memo:
        return Memo(lambda piece: self._learn(words_of(piece)))

    def _learn(self, words: list) -> int:
        self.words.extend(map(self.slots.__getitem__, words))
        self.sizes_of.append(len(words))
        self.learned += 1
        return self.learned - 1

    def add(self, doc_ids: list[int | None], pieces: np.ndarray, counts: np.ndarray) -> None:
        """Documents with the numbers of their pieces, ``counts`` for each document."""
        self.ids += doc_ids
        self.pieces.append(pieces)
        self.sizes.append(counts)
        self.waiting += len(pieces) + len(counts)

    def close_block(self, buckets: int) -> pa.RecordBatch:
        self.flat = np.concatenate([self.flat, np.array(self.words, np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(self.sizes_of, dtype=np.int64)])
        self.words, self.sizes_of = [], []
        numbers, ends = take_runs(self.flat, self.ends, np.concatenate(self.pieces))
        counts = np.diff(ends[np.concatenate([[0], *self.sizes]).cumsum()])
        row = {
            "bucket": (self.number + self.blocks) % buckets,
            "chunk": self.number,
            "slots": self.known.to_bytes(8, "little"),
            "doc_ids": self.ids,
            "counts": counts,
            "payload": pack(leave_out_new(numbers, self.known)),
        }
        self.known = self.slots.count
        self.positions += len(numbers)
        self.blocks += 1
        self._new_block()
        return pa.RecordBatch.from_pylist([row], schema=_EXPLODED)

    def word_rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        words = [w if isinstance(w, bytes) else w.encode("utf-8") for w in self.slots]
        bucket = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        for name, slots in zip(names, np.split(order, starts[1:])):
            row = {
                "bucket": int(name),
                "chunk": self.number,
                "slots": pack(np.diff(slots, prepend=0)),
                "words": pack_runs([words[i] for i in slots]),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_EXPLODED)


_WEIGHTS = np.random.default_rng(17).integers(1, 2**63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """Buckets of binary words, by a hash of all their bytes."""
    flat, ends = _bytes_of(words)
    size = np.diff(ends)
    out = np.zeros(len(words), np.uint64)
    short = np.nonzero((size > 0) & (size <= len(_WEIGHTS)))[0]
    if len(short):
        few, at = take_runs(flat, ends, short)
        place = np.arange(len(few)) - np.repeat(at[:-1], size[short])
        out[short] = np.add.reduceat((few.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place], at[:-1])
    for i in np.nonzero(size > len(_WEIGHTS))[0].tolist():
        out[i] = xxhash.xxh3_64_intdigest(flat[ends[i] : ends[i + 1]].tobytes())
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(33)) % np.uint64(buckets)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and the ends of its items."""
    _, ends, raw = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), ends


class ArrowChunk:
    """A chunk whose pieces are told apart in Arrow, all at its end.

    Its words are numbered by frequency, the most frequent first, so that most numbers are
    small; those mentioned once follow in order of their place, which stands for them.
    """

    def __init__(self, number: int):
        self.number, self.bytes, self.positions = number, 0, 0
        self.ids: list[list[int | None]] = []
        self.coded: list[pa.DictionaryArray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], pieces: pa.ListArray) -> None:
        flat = pieces.flatten()
        self.ids.append(doc_ids)
        self.coded.append(flat.dictionary_encode())
        self.counts.append(pieces.value_lengths().to_numpy().astype(np.int64))
        self.positions += len(flat) + len(doc_ids)

    def rows(self, buckets: int, words_of: Callable) -> Iterator[pa.RecordBatch]:
        """Rows of all blocks and words; ``words_of`` gives the words of pieces, as a binary
        array, with their number for each piece, and the place of each piece among these."""
        whole = pa.chunked_array(self.coded).unify_dictionaries()
        words, sizes, place = words_of(whole.chunk(0).dictionary)
        coded = words.dictionary_encode()
        at = [place[part.indices.to_numpy()] for part in whole.chunks]
        often = sum(np.bincount(part, minlength=len(sizes)) for part in at)
        numbers = coded.indices.to_numpy()
        uses = np.bincount(numbers, np.repeat(often, sizes), len(coded.dictionary))
        # Pieces have come in order of their first mention, before ``words_of`` moved them.
        mention = np.empty(len(numbers), np.int64)
        mention[np.argsort(np.repeat(np.argsort(place), sizes), kind="stable")] = np.arange(len(numbers))
        first = np.full(len(uses), len(numbers))
        np.minimum.at(first, numbers, mention)
        order = np.lexsort((first, -uses))
        repeated = known = int((uses > 1).sum())
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        numbers, ends = rank[numbers], np.concatenate([[0], np.cumsum(sizes)])
        for block, (ids, counts, part) in enumerate(zip(self.ids, self.counts, at)):
            found, stops = take_runs(numbers, ends, part)
            row = {
                "bucket": (self.number + block) % buckets,
                "chunk": self.number,
                "slots": known.to_bytes(8, "little"),
                "doc_ids": ids,
                "counts": np.diff(stops[np.concatenate([[0], np.cumsum(counts)])]),
                "payload": pack(np.where(found < repeated, found + 1, 0)),
            }
            known += int((found >= repeated).sum())
            yield pa.RecordBatch.from_pylist([row], schema=_EXPLODED)
        words = coded.dictionary.take(pa.array(order))
        flat, ends = _bytes_of(words)
        bucket = buckets_of(words, buckets)
        dealt = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[dealt], return_index=True)
        for name, slots in zip(names.tolist(), np.split(dealt, starts[1:])):
            raw, stops = take_runs(flat, ends, slots)
            row = {
                "bucket": name,
                "chunk": self.number,
                "slots": pack(np.diff(slots, prepend=0)),
                "words": _packed_runs(np.diff(stops), raw.tobytes()),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_EXPLODED)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about SLICE bytes, one row at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE
    starts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(texts)]])
    return zip(starts[:-1].tolist(), np.diff(starts).tolist())


def _explode(buckets: int, blob, splitter: Callable, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            yield from exploded(batches)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = splitter(blob.value)
        chunk = Chunk(TaskContext.get().partitionId() << 32)
        split = start(chunk)
        for batch in batches:
            for at, length in _slices(batch.column(1)):
                part = batch.slice(at, length)
                chunk.add(part.column(0).to_pylist(), *split(part.column(1)))
                chunk.bytes += part.column(1).nbytes
                if chunk.waiting < BLOCK and chunk.bytes < LONG * most:
                    continue
                yield chunk.close_block(buckets)
                if chunk.positions >= most or chunk.bytes >= LONG * most:
                    yield from chunk.word_rows(buckets)
                    chunk = Chunk(chunk.number + 1)
                    split = start(chunk)
        if chunk.ids:
            yield chunk.close_block(buckets)
        yield from chunk.word_rows(buckets)

    return run


def _explode_in_arrow(buckets: int, blob, splitter: Callable, most: int):
    """As ``_explode``, with a pair of functions: from texts to lists of pieces, and from
    pieces to words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            yield from exploded(batches)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, words_of = once(splitter.__qualname__, blob.value, splitter)
        chunk = ArrowChunk(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for at, length in _slices(batch.column(1)):
                part = batch.slice(at, length)
                chunk.add(part.column(0).to_pylist(), pieces_of(part.column(1)))
                chunk.bytes += part.column(1).nbytes
                if chunk.positions >= most or chunk.bytes >= LONG * most:
                    yield from chunk.rows(buckets, words_of)
                    chunk = ArrowChunk(chunk.number + 1)
        if chunk.coded:
            yield from chunk.rows(buckets, words_of)

    return run


def _encode(blob, encoder: Callable):
    """Replace the words of each row by their ids; a task has the rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(encoder.__qualname__, blob.value, encoder)
        known: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            out = []
            for packed in batch.column(3).to_pylist():
                if packed is None:
                    out.append(None)
                    continue
                sizes, raw = unpack_runs(packed)
                ends = np.cumsum(sizes).tolist()
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                if held > FORGET:
                    known, held = {}, 0
                if new := [w for w in words if w not in known]:
                    held += sum(map(len, new)) + 150 * len(new)
                    known.update(zip(new, encode(new)))
                out.append(pack_runs(list(map(known.__getitem__, words))))
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary()), *batch.columns[4:]], schema=_EXPLODED)

    return run


def _packed_type(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


_RUN = pa.schema(
    [("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary())]
)
_RUN_SQL = "part int, doc_ids array<long>, counts array<int>, ids binary"


def _runs(docs: pa.Array, ids: np.ndarray, bounds: np.ndarray, ranges: np.ndarray, largest: int) -> pa.Table:
    """part, doc_ids, counts, ids: one row for each range of document ids that ``docs`` touch."""
    part = np.searchsorted(ranges, docs.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    rows = []
    for name, at in zip(names.tolist(), np.split(order, starts[1:])):
        first, last = int(at[0]), int(at[-1]) + 1
        if last - first == len(at):  # documents that lie next to each other need no gathering
            flat, counts = ids[bounds[first] : bounds[last]], np.diff(bounds[first : last + 1])
        else:
            flat, ends = take_runs(ids, bounds, at)
            counts = np.diff(ends)
        packed = zstandard.compress(_planes(flat, _packed_type(largest)), 3)
        rows.append((name, docs.take(pa.array(at)).to_pylist(), counts, packed))
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, _RUN.types)], _RUN)


def unpack_run(doc_ids: pa.Array, counts: np.ndarray, packed: bytes, largest: int) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of a run of documents that ``encode_words`` packed, some at a time."""
    flat = pa.array(_from_planes(zstandard.decompress(packed), _packed_type(largest)).astype(np.int32))
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    # A batch ends where another million ids begin.
    cuts = np.nonzero(np.diff(ends[:-1] // 1_000_000))[0] + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)]):
        offsets = pa.array(ends[a : b + 1] - ends[a], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, flat.slice(ends[a], ends[b] - ends[a]))
        yield pa.record_batch([doc_ids.slice(a, b - a), lists], ["doc_id", "ids"])


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``ids`` with ``end`` after each run of ``sizes``."""
    out = np.empty(len(ids) + len(sizes), ids.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own] = ids
    out[~own] = end
    return out


def _reassemble(end: int | None, ranges: np.ndarray | None, largest: int, finish: Callable | None = None):
    """Ids of a chunk's documents from its words' ids and its blocks; ``end`` follows each."""

    def run(chunk: pa.Table) -> pa.Table:
        with tidy():
            return finish(whole(chunk)) if finish else whole(chunk)

    def whole(chunk: pa.Table) -> pa.Table:
        slots, sizes, raws = [], [], []
        for runs, at in zip(chunk["words"].to_pylist(), chunk["slots"].to_pylist()):
            if runs is not None:
                size, raw = unpack_runs(runs)
                slots.append(np.cumsum(unpack(at)))
                sizes.append(size // 4)
                raws.append(np.frombuffer(raw, "<i4"))
        # Runs lie bucket by bucket; place[slot] is the slot's run.
        place = np.argsort(np.concatenate(slots), kind="stable") if slots else np.zeros(0, np.int64)
        flat = np.concatenate(raws) if raws else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)
        docs, ids, counts = [], [], []
        blocks = zip(*(chunk[c].to_pylist() for c in ("slots", "doc_ids", "counts", "payload")))
        for known, doc_ids, count, payload in blocks:
            if payload is not None:
                numbers = put_new_back(unpack(payload), int.from_bytes(known, "little"))
                got, at = take_runs(flat, ends, place[numbers])
                size = np.diff(at[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])])
                if end is not None:
                    got, size = _with_ends(got, size, end), size + 1
                docs += doc_ids
                ids.append(got)
                counts.append(size)
        bounds = np.concatenate([[0], *counts]).cumsum()
        flat = np.concatenate(ids or [flat[:0]])
        if ranges is not None:
            return _runs(pa.array(docs, pa.int64()), flat, bounds, ranges, largest)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        return pa.table([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])

    return run


def encode_words(
    docs: DataFrame,
    splitter: Callable,
    encoder: Callable,
    vocabulary: str,
    end: int | None = None,
    ranges: np.ndarray | None = None,
    largest: int = 2**31 - 1,
    finish: Callable | None = None,
    finish_schema: str = "",
    chunk: int = CHUNK,
    in_arrow: bool = False,
) -> DataFrame:
    """doc_id, ids for every row of ``docs`` (doc_id, text).

    ``ids`` is array<int>. With ``ranges``, ascending document ids, rows are part, doc_ids,
    counts, ids: what a chunk has of a range of documents (part k begins with the k-th of
    ``ranges``; null ids are in part 0), which ``unpack_run`` reads and which is smaller to
    shuffle once more; no id is above ``largest``. ``end`` follows the ids of each document.
    ``splitter(blob)(chunk)`` gives a function from texts to the numbers of their pieces, in
    tables of the chunk, and how many each text has; with ``in_arrow`` it is what
    ``_explode_in_arrow`` takes; ``encoder(blob)`` gives a function from
    words to the ids of each as little-endian 32-bit integers; ``finish(blob)`` may turn a table of
    doc_id and ids into one of ``finish_schema``. All run on executors. A larger ``chunk``
    shuffles fewer words and holds more of them in memory.
    """
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    explode = _explode_in_arrow if in_arrow else _explode
    exploded = docs.select("doc_id", "text").mapInArrow(explode(buckets, blob, splitter, chunk), _EXPLODED_SQL)
    by_bucket = exploded.repartitionById(buckets, F.col("bucket"))
    encoded = by_bucket.mapInArrow(_encode(blob, encoder), _EXPLODED_SQL)
    schema = finish_schema or (_RUN_SQL if ranges is not None else "doc_id long, ids array<int>")
    last = (lambda table: once(finish.__qualname__, blob.value, finish)(table)) if finish else None
    return encoded.groupBy("chunk").applyInArrow(_reassemble(end, ranges, largest, last), schema)
