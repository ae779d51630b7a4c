"""Line dedup by winnowing over line hashes.

A repeated run is a run of consecutive lines with ``min_words`` words or more whose lines,
in this order, also begin at an earlier place of the corpus. Places are ordered by document
id and line. All lines of repeated runs are deleted, so that the first copy of everything
stays; blank lines do not count and go with the run around them. Lines are compared without
white space at their ends, by 128-bit digests.

1. Select. From each line on, and up to each line, the shortest run with ``min_words`` words
   is a window. Of the runs of half as many words inside a window, the one with the least
   hash is its fingerprint. Only fingerprints are stored, each once for all windows that
   select it, with the digests of the lines of these windows. Equal windows select equal
   fingerprints, so every repeated run has one in common with its earlier copy.
2. Join. Fingerprints found at more than one place are joined with the first of their places.
3. Extend. From the fingerprint, lines are compared with those of the first place backwards
   and forwards as far as they agree. Windows inside the match are repeated.
4. Go on. Where the first place does not explain all windows, since a part of the run comes
   from another earlier document, the windows left over are compared by a hash of their line
   digests, again with the first place only. A window left over has no copy among those
   explained, as it would have agreed with the first place as well, so nothing is missed.
5. Delete the lines of repeated windows.

A passage that a third of all documents share gives rows that are counted with partial
sums, and is joined with one row, its first place; no pairs of documents are made.

Defined results: null and blank texts have no lines and stay as they are; documents with
null ids come first; rows with equal ids are ordered by a hash of their texts, and rows
equal in id and text are treated alike, as one document; other columns are carried along
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.runtime import fresh, materialize
from textloom.llm.pieces import strings, tidy

_PRINTS = (
    "doc_id long, text_hash long, "
    "prints array<struct<print: long, at: int, spot: int, lines: array<int>, digests: binary, windows: array<int>>>"
)
_STRUCT = pa.list_(
    pa.struct(
        [
            ("print", pa.int64()),
            ("at", pa.int32()),
            ("spot", pa.int32()),
            ("lines", pa.list_(pa.int32())),
            ("digests", pa.binary()),
            ("windows", pa.list_(pa.int32())),
        ]
    )
)
_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.binary())]
)
#: Bytes of the digest of a line.
DIGEST = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_hash(text: str) -> int:
    """64 bits that tell rows with the same id apart."""
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8")))


def _shortest(total: np.ndarray, most: int) -> np.ndarray:
    """For each line i the first j such that lines i..j-1 hold ``most`` words; n + 1 if none."""
    found = np.searchsorted(total, total[:-1] + most, side="left")
    return np.where(found < len(total), found, len(total))


def fingerprints(text: str, min_words: int) -> list[dict]:
    """The selected fingerprints of a text.

    ``print`` is its hash, ``at`` the number of its first line, ``lines`` and ``digests``
    the lines with words that its windows span, ``spot`` its first line among these, and
    ``windows`` the first and last line of each window among these.
    """
    lines = [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]
    lines = [(i, b) for i, x in lines if (b := x.encode("utf-8").strip())]
    if not lines:
        return []
    total = np.concatenate([[0], np.cumsum([len(b.split()) for _, b in lines])])
    n = len(lines)
    if total[-1] < min_words:
        return []
    digests = b"".join(xxhash.xxh3_128_digest(b) for _, b in lines)
    grams = _shortest(total, -(-min_words // 2)).tolist()
    hashes = [xxhash.xxh3_64_intdigest(digests[DIGEST * i : DIGEST * j]) if j <= n else None for i, j in enumerate(grams)]
    windows = {(i, j) for i, j in enumerate(_shortest(total, min_words).tolist()) if j <= n}
    # Up to line j: the last i with total[j] - total[i] >= min_words.
    last = np.searchsorted(total, total - min_words, side="right") - 1
    windows |= {(i, j) for j, i in enumerate(last.tolist()) if i >= 0}
    chosen: dict[int, list[tuple[int, int]]] = {}
    for a, b in sorted(windows):
        chosen.setdefault(min((hashes[i], i) for i in range(a, b) if grams[i] <= b)[1], []).append((a, b))
    out = []
    for at, spans in chosen.items():
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        out.append(
            {
                "print": _signed(hashes[at]),
                "at": lines[at][0],
                "spot": at - low,
                "lines": [i for i, _ in lines[low:high]],
                "digests": digests[DIGEST * low : DIGEST * high],
                "windows": [x - low for a, b in spans for x in (a, b - 1)],
            }
        )
    return out


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            yield from scanned(batches)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = strings(batch.column(1))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(map(text_hash, texts), pa.int64()),
                    pa.array([fingerprints(x, min_words) for x in texts], _STRUCT),
                ],
                ["doc_id", "text_hash", "prints"],
            )

    return run


def agree(own: bytes, spot: int, first: bytes, first_spot: int) -> tuple[int, int]:
    """First and last line of ``own`` around ``spot`` that agree with ``first``, line by line."""
    before, after = min(spot, first_spot), min(len(own) // DIGEST - spot, len(first) // DIGEST - first_spot)
    line = lambda digests, at: digests[DIGEST * at : DIGEST * (at + 1)]
    back = ahead = 0
    while back < before and line(own, spot - back - 1) == line(first, first_spot - back - 1):
        back += 1
    while ahead < after and line(own, spot + ahead) == line(first, first_spot + ahead):
        ahead += 1
    return spot - back, spot + ahead - 1


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs (without a hash), and the windows that the first place does not explain.

    Input: a fingerprint's place, its windows and those of its first place.
    """
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own, lines = row["digests"], row["lines"]
            low, high = agree(own, row["spot"], row["first_digests"], row["first_spot"])
            spans = list(zip(row["windows"][::2], row["windows"][1::2]))
            inside = [(a, b) for a, b in spans if low <= a and b <= high]
            if inside:  # all of them hold the fingerprint, so they are one run
                out.append((row, min(a for a, _ in inside), max(b for _, b in inside), None))
            for a, b in spans:
                if not (low <= a and b <= high):
                    out.append((row, a, b, xxhash.xxh3_128_digest(own[DIGEST * a : DIGEST * (b + 1)])))
        rows = [(r["doc_id"], r["text_hash"], r["lines"][a], r["lines"][b], h) for r, a, b, h in out]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, _RUNS.types)], schema=_RUNS)


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text_hash, start, stop: line ranges (0-based, inclusive) to delete."""
    scanned = docs.select("doc_id", "text").mapInArrow(_scan(min_words), _PRINTS)
    # Rows equal in id and text are one document.
    prints = materialize(scanned.select("doc_id", "text_hash", F.explode("prints").alias("p")).select("doc_id", "text_hash", "p.*"))
    place = F.struct("doc_id", "text_hash", "at")
    return _later_runs(prints, place)


def _later_runs(prints: DataFrame, place: Column) -> DataFrame:
    whole = F.struct("doc_id", "text_hash", "at", "spot", "digests")
    first = prints.groupBy("print").agg(F.min(whole).alias("first"), F.max(place).alias("hi"))
    head = F.struct("first.doc_id", "first.text_hash", "first.at")
    first = first.where(head != F.col("hi")).select("print", "first")
    later = prints.join(first, "print").where(place > head)
    columns = ["doc_id", "text_hash", "spot", "lines", "digests", "windows"]
    later = later.select(*columns, F.col("first.spot").alias("first_spot"), F.col("first.digests").alias("first_digests"))
    found = materialize(later.mapInArrow(_extend, "doc_id long, text_hash long, start int, stop int, hash binary"))
    explained = found.where("hash IS NULL")
    rest = found.where("hash IS NOT NULL")
    begin = F.struct("doc_id", "text_hash", "start")
    heads = rest.groupBy("hash").agg(F.min(begin).alias("head"), F.max(begin).alias("tail")).where("head <> tail")
    again = rest.join(heads.select("hash", "head"), "hash").where(begin > F.col("head"))
    runs = ["doc_id", "text_hash", "start", "stop"]
    return explained.select(*runs).unionByName(again.select(*runs))


#: Rows that a Python worker turns into objects at once.
ROWS = 500
_CUT = pa.struct([("text", pa.string()), ("lines", pa.int64()), ("removed", pa.int64()), ("removed_words", pa.int64())])


def _slices(kind: pa.DataType, make: Callable[..., list], *columns: pa.Array) -> pa.Array:
    """``make`` of the columns, ``ROWS`` rows at a time, so that few texts are Python objects at once."""
    with tidy():
        cuts = range(0, len(columns[0]), ROWS)
        made = [pa.array(make(*[c.slice(i, ROWS).to_pylist() for c in columns]), kind) for i in cuts]
        return pa.concat_arrays(made) if made else pa.array([], kind)


def _hash_text(text: pa.Array) -> pa.Array:
    return _slices(pa.int64(), lambda texts: [text_hash(x or "") for x in texts], text)


def _cut_lines(text: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    return _slices(_CUT, _cut_rows, text, starts, stops)


def _cut_rows(texts: list, starts: list, stops: list) -> list[dict]:
    out = []
    for x, a, b in zip(texts, starts, stops):
        lines = (x or "").split("\n")
        steps = np.zeros(len(lines) + 1, np.int64)
        np.add.at(steps, a or [], 1)
        np.add.at(steps, np.array(b or [], np.int64) + 1, -1)
        inside = np.cumsum(steps[:-1]) > 0
        words = [len(line.encode("utf-8").split()) for line in lines]
        gone = [n for n, cut in zip(words, inside) if cut and n]
        kept = "\n".join(line for line, cut in zip(lines, inside) if not cut) if inside.any() else x
        out.append({"text": kept, "lines": sum(n > 0 for n in words), "removed": len(gone), "removed_words": sum(gone)})
    return out


def _ranged(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: the line ranges to delete, null if none."""
    hash_text = F.arrow_udf(_hash_text, "long")
    runs = repeated_runs(docs, min_words)
    key, ranges = (fresh(docs, name) for name in ("_key", "_ranges"))
    per = runs.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(
        F.collect_set(F.struct("start", "stop")).alias(ranges)
    )
    keyed = docs.withColumn(key, hash_text(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(per["_i"]) & (keyed[key] == per["_h"])
    joined = keyed.join(per, same, "left")
    return joined.select(*[keyed[c] for c in docs.columns], joined[ranges]), ranges


def _cut(text: Column, ranges: str) -> Column:
    # Spark evaluates a deterministic function once more below a filter on what it returns,
    # in Python workers of its own.
    cut_lines = F.arrow_udf(_cut_lines, "struct<text: string, lines: long, removed: long, removed_words: long>")
    return cut_lines.asNondeterministic()(text, F.col(ranges)["start"], F.col(ranges)["stop"])


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with one more column, ``_cut``: the text without repeated runs, and what was
    taken out.

    It has text, lines (lines with words before), removed (of these) and removed_words.
    """
    ranged, ranges = _ranged(docs, min_words)
    return ranged.select(*docs.columns, _cut(F.col("text"), ranges).alias(fresh(docs, "_cut")))


def has_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def drop_repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with their columns, less repeated runs; documents that lost all words go."""
    ranged, ranges = _ranged(docs, min_words)
    cut, found = fresh(ranged, "_cut"), F.col(ranges).isNotNull()
    # Only texts with such runs go to Python; of the others a null goes there.
    deduped = ranged.withColumn(cut, _cut(F.when(found, F.col("text")), ranges))
    left = deduped.where(~(found & (F.col(cut)["removed"] > 0) & ~has_words(F.col(cut)["text"])))
    text = F.when(found, F.col(cut)["text"]).otherwise(F.col("text")).alias("text")
    return left.select(*[text if c == "text" else F.col(c) for c in docs.columns])
