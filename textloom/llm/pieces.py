"""Cutting texts for byte-level tokenizers, and vocabulary files on executors.

``regex`` finds the pre-tokens of a text, but slowly. A text is first cut wherever a
character that is no white space is followed by a blank: no pre-token spans such a cut and
none looks back, so each piece splits into pre-tokens by itself. Pieces repeat, so what a
piece holds is looked up in a table that lives as long as the Python worker.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa

#: Any white space before a blank: only then do cuts need more care than split(" ").
_RUNS = re.compile(r"\s ")
_CUTS = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> tuple[list[str], list[str]]:
    """(pieces as they stand, pieces without the blank that they begin with), in order.

    One of the lists holds one piece at least; the pieces of the first come first.
    """
    if _RUNS.search(text) is None:
        parts = text.split(" ")
        return parts[:1], parts[1:]
    return _CUTS.split(text), []


#: Characters or bytes of the longest key that a memo keeps.
LONGEST = 64


class Bounded(dict):
    """A memo of ``make(key)`` that starts anew when it holds ``most`` keys.

    Keys longer than ``LONGEST`` are made anew each time, so what a memo holds is bounded in
    bytes too, whatever unbroken strings the texts have.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file, read on the driver; such files have a fixed size of a few MB."""
    with open(path, "rb") as f:
        return f.read()


_made: dict = {}


def once(kind: str, blob: bytes, make: Callable):
    """``make(blob)``, made once in a Python worker."""
    key = (kind, len(blob), hash(blob))
    if key not in _made:
        _made[key] = make(blob)
    return _made[key]


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


@contextmanager
def tidy(*forget: Callable):
    """Forget, and give memory back when a task ends, as Python workers wait for others."""
    try:
        yield
    finally:
        for each in forget:
            each()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
