"""Words of texts counted in Arrow batches, by the profiles of ``tokens``.

Texts are cut at the bytes that delimit, and the tokens of a slice of texts told apart in
Arrow. Only distinct tokens are trimmed, tested and lowered, so that this costs little beside
the reading. What a token becomes is kept in a memo of a bounded size.

Which characters are word characters, and how one is lowered, is asked from Spark once a
session, as Python's Unicode may be another version than Java's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.llm.pieces import Bounded

#: Bytes of texts counted together, tokens of a worker's memo, and bytes of counts listed together.
SLICE, MEMO, LISTED = 16 << 20, 500_000, 64 << 20
#: Python and Java agree on letters below.
SETTLED = "\u0370"


@dataclass
class Signs:
    """Ranges of code points that are word characters, and characters that Spark lowers otherwise."""

    begins: list[int]
    ends: list[int]
    lowered: dict[str, str]
    known: dict[str, bool] = field(default_factory=dict)

    def is_word(self, c: str) -> bool:
        found = self.known.get(c)
        if found is None:
            k = bisect_right(self.begins, ord(c)) - 1
            found = self.known[c] = k >= 0 and ord(c) <= self.ends[k]
        return found

    def lower(self, text: str) -> str:
        if self.lowered and not text.isascii() and not self.lowered.keys().isdisjoint(text):
            return "".join(self.lowered.get(c) or c.lower() for c in text)
        return text.lower()


_SIGNS: dict[str, Signs] = {}


def signs(spark: SparkSession, word_class: str) -> Signs:
    """``Signs`` of the session; all code points are tested once, so the job has a fixed size."""
    key = f"{spark.sparkContext.applicationId} {word_class}"
    if key not in _SIGNS:
        points = spark.range(1, 0x110000).where("id not between 55296 and 57343")
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        told = points.select("id", c.rlike(rf"^{word_class}\z").alias("word"), F.lower(c).alias("low"))
        rows = told.where(F.col("word") | (F.col("low") != c)).toArrow().sort_by("id")
        ids, words = rows.column("id").to_numpy(), rows.column("word").to_numpy()
        inside = ids[words.astype(bool)]
        breaks = np.flatnonzero(np.diff(inside) > 1)
        begins, ends = inside[np.concatenate([[0], breaks + 1])], inside[np.concatenate([breaks, [-1]])]
        low = dict(zip(map(chr, ids.tolist()), rows.column("low").to_pylist()))
        other = {chr(i): low.get(chr(i), chr(i)) for i in range(128, 0x110000) if chr(i).lower() != low.get(chr(i), chr(i)) and not 0xD800 <= i < 0xE000}
        _SIGNS[key] = Signs(begins.tolist(), ends.tolist(), other)
    return _SIGNS[key]


def word_of(profile, letters: Signs) -> Callable[[bytes], str | None]:
    """The word that a token becomes; None if it is none."""

    def word(token: bytes) -> str | None:
        t = token.decode("utf-8", "replace")
        t = t.strip(profile.trimmed) if profile.trimmed else t
        if not t or (profile.longest and len(t) > profile.longest):
            return None
        if profile.whole and not (t.isalpha() and max(t) < SETTLED) and not all(map(letters.is_word, t)):
            return None
        if profile.whole is False and not any(map(letters.is_word, t)):
            return None
        return letters.lower(t) if not profile.first or re.match(profile.first, letters.lower(t[0])) else None

    return word


def _delimiters(profile) -> tuple[np.ndarray, bool]:
    """Which bytes delimit by themselves, and whether two hyphens do."""
    single = np.array([b < 128 and re.fullmatch(profile.delimiters, chr(b)) is not None for b in range(256)])
    return single, re.fullmatch(profile.delimiters, "--") is not None


def cut(texts: pa.Array, single: np.ndarray, hyphens: bool) -> tuple[pa.Array, np.ndarray]:
    """(tokens as binary, without empty ones; the place of the text of each)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if hyphens:
        texts = pc.replace_substring(texts, "--", "\n")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if bounds[-1] == bounds[0]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~single[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A token ends with its text.
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside)  # bytes of tokens up to each
    at = np.concatenate([kept[starts] - 1, kept[-1:]]).astype(np.int64)
    own = np.searchsorted(bounds, starts, "right") - 1
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]), own


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about ``SLICE`` bytes of texts, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            held = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, held + SLICE, "right")))
            yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
            at = to


def _same(a, b) -> bool:
    return a is b or a == b or (a != a and b != b)


#: What tokens become, in this worker.
_MEMOS: dict = {}


def counter(profile, letters: Signs, schema: pa.Schema, merged: bool) -> Callable:
    """Rows (id, word, tf, dl, head) of batches (id, text), for mapInArrow.

    ``dl`` is the number of words of the document, and ``head`` is true in one of its rows. Rows with
    equal ids are one document if ``merged`` (they have to be neighbours), else each is its own.
    The words of the last document of a slice are held until another one follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, hyphens = _delimiters(profile)
        memo = _MEMOS.setdefault(profile, Bounded(word_of(profile, letters), MEMO))
        open_id, opened = None, None

        def told(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
            """Words, and for each token its word or -1."""
            found = list(map(memo.__getitem__, distinct.to_numpy(zero_copy_only=False)))
            coded = pa.array(found, pa.string()).dictionary_encode()
            return coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64)

        def handed(ids, words, tf, first, of_doc) -> pa.RecordBatch:
            dl = np.repeat(np.add.reduceat(tf, first), np.diff(first, append=len(tf)))
            head = np.zeros(len(tf), bool)
            head[first] = True
            columns = [ids.take(pa.array(of_doc)), words, pa.array(tf), pa.array(dl), pa.array(head)]
            return pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema)

        def closed() -> pa.RecordBatch:
            n = len(opened)
            tf = np.fromiter(opened.values(), np.int64, n)
            return handed(open_id, pa.array(list(opened), pa.string()), tf, np.zeros(1, np.int64), np.zeros(n, np.int64))

        for ids, texts in _slices(batches):
            tokens, own = cut(texts, single, hyphens)
            coded = tokens.dictionary_encode()
            words, of = told(coded.dictionary)
            at = of[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)
            # Documents are runs of equal ids.
            begins = np.arange(len(ids))
            if merged:
                values = ids.to_pylist()
                begins = np.array([i for i in range(len(values)) if not i or not _same(values[i], values[i - 1])], np.int64)
                if opened is not None and not _same(values[0], open_id[0].as_py()):
                    if opened:
                        yield closed()
                    opened = None
            doc = np.searchsorted(begins, own, "right") - 1
            keep = at >= 0
            key, tf = np.unique(doc[keep] * (len(words) or 1) + at[keep], return_counts=True)
            doc, at, tf = key // (len(words) or 1), key % (len(words) or 1), tf.astype(np.int64)
            if merged:
                # The first run may continue the open document; the last one stays open.
                last = len(begins) - 1
                held = doc == last
                if opened is not None and last > 0:
                    head = doc == 0
                    for w, n in zip(words.take(pa.array(at[head])).to_pylist(), tf[head].tolist()):
                        opened[w] = opened.get(w, 0) + n
                    if opened:
                        yield closed()
                    opened = None
                    out = ~head & ~held
                else:
                    out = ~held
                opened = {} if opened is None else opened
                open_id = ids.slice(int(begins[last]), 1)
                for w, n in zip(words.take(pa.array(at[held])).to_pylist(), tf[held].tolist()):
                    opened[w] = opened.get(w, 0) + n
                doc, at, tf = doc[out], at[out], tf[out]
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                yield handed(ids, words.take(pa.array(at)), tf, first, begins[doc])
        if opened:
            yield closed()

    return run


def lister(run: Callable, schema: pa.Schema) -> Callable:
    """Rows (word, ids, tfs) of what ``run`` of ``counter`` makes, for mapInArrow.

    A list holds what of its word lies in about ``LISTED`` bytes of a task's counts, in their
    order, so that a word of all documents has many lists of a bounded size.
    """

    def column(counts: pa.Table, name: str) -> pa.Array:
        return counts.column(name).combine_chunks()

    def listed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        counts = pa.Table.from_batches(held).combine_chunks()
        coded = column(counts, "word").dictionary_encode()
        of = coded.indices.to_numpy()
        order = pa.array(np.argsort(of, kind="stable"))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, column(counts, name).take(order)) for name in ("doc_id", "tf")]
        return pa.record_batch([c.cast(f.type) for c, f in zip([coded.dictionary, *lists], schema)], schema)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for counts in run(batches):
            held.append(counts.select(["doc_id", "word", "tf"]))
            size += held[-1].nbytes
            if size >= LISTED:
                yield listed(held)
                held, size = [], 0
        if held:
            yield listed(held)

    return lists


def gatherer(run: Callable, schema: pa.Schema) -> Callable:
    """Rows (id, words, tfs), one for each document, of what ``run`` of ``counter`` makes, for mapInArrow."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A document lies in one batch as a whole, its first row is marked.
        for counts in run(batches):
            first = np.flatnonzero(counts.column(4).to_numpy(zero_copy_only=False))
            ends = pa.array(np.append(first, len(counts)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, counts.column(k)) for k in (1, 2)]
            columns = [counts.column(0).take(pa.array(first)), *lists]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema)

    return rows
