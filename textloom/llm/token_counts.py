"""Token counts by byte-pair merging with a heap over a linked list.

A pre-token starts as its bytes. Adjacent pairs that can merge lie in a heap by (rank,
place); the lowest is popped, its two symbols become one in a doubly linked list, and the
pairs with the new neighbours go on the heap; pairs whose symbols have changed since are
skipped. The count is the number of bytes less the number of merges: no identifiers are
made. It costs n log n for a pre-token of n bytes, however long.

Counting needs no shuffle: texts are counted where they are scanned, with tables of counted
pre-tokens and pieces that a Python worker keeps, of bounded size.

Defined results: a null text has no tokens and no bytes; ids may be null or repeat; other
columns are not read; an empty table gives an empty result. Added tokens of the file, such
as an end-of-text mark, are found inside texts and count as one token each, as the library
counts them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from public_tokenizers import PATTERN as PRE_TOKENS
from pyspark.sql import DataFrame

from textloom.llm.pieces import Bounded, cut, once, read_vocabulary, strings

#: Entries that a worker keeps of each table.
KEPT = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: the byte's own if it is
    visible in Latin-1, else the next unused one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of a text by a ``tokenizers`` BPE file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        ids = model["vocab"]
        self.symbol = [ids[c] for c in byte_letters()]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[left], ids[right]] = (rank, ids[left + right])
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.words = Bounded(self.merged, KEPT)
        self.plain = Bounded(self.piece, KEPT)
        self.blank = Bounded(lambda part: self.piece(" " + part), KEPT)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        symbols = [self.symbol[b] for b in word.encode("utf-8")]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [
            (found[0], i, symbols[i], symbols[i + 1])
            for i in range(n - 1)
            if (found := self.merge.get((symbols[i], symbols[i + 1])))
        ]
        heapq.heapify(pairs)
        merges = 0
        while pairs:
            _, i, left, right = heapq.heappop(pairs)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.merge[left, right][1], -1
            merges += 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := self.merge.get((symbols[a], symbols[b]))):
                    heapq.heappush(pairs, (found[0], a, symbols[a], symbols[b]))
        return n - merges

    def piece(self, piece: str) -> int:
        return sum(map(self.words.__getitem__, self.find(piece)))

    def plain_count(self, text: str) -> int:
        whole, parts = cut(text)
        return sum(map(self.plain.__getitem__, whole)) + sum(map(self.blank.__getitem__, parts))

    def count(self, text: str) -> int:
        """Tokens of a text, its added tokens included."""
        if self.added is None or self.added.search(text) is None:
            return self.plain_count(text)
        between = self.added.split(text)
        return len(between) - 1 + sum(map(self.plain_count, between))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs``."""
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("merge counter", blob.value, MergeCounter)
        for batch in batches:
            texts = strings(batch.column(1))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(x) if x.isascii() else len(x.encode("utf-8")) for x in texts], pa.int64()),
                    pa.array(map(counter.count, texts), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
