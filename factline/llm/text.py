"""Words: as Spark expressions, and as numpy arrays for Arrow batches.

`SPACED` words are `[^\\x20\\x09-\\x0D]+`; `ALNUM` words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after
A-Z are lower-cased. All bytes of a non-ASCII character are word bytes in both, so UTF-8 can be cut by bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"

U = np.uint64


def free_name(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores as it takes to differ from all of `columns`."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row; inside a lambda a column would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Of each element of an array the fold of all elements before it; `merge` is associative with identity `zero`.

    Folds of runs of RUN elements come first, so n elements take n * RUN + (n / RUN)^2 steps and no array grows.
    """

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda b: F.aggregate(F.slice(v, b * RUN + 1, F.lit(RUN)), zero, merge))
        begins = let(runs, lambda r: F.transform(r, lambda x, b: F.aggregate(F.slice(r, F.lit(1), b), zero, merge)))
        return let(begins, lambda s: F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % RUN + 1, i % RUN), F.get(s, F.floor(i / RUN).cast("int")), merge)))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.slice(v, F.lit(1), F.lit(0))))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() where all characters are ASCII, as it is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of the regex class `separators`; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    return split_words(text, r"[\x20\x09-\x0D]+")


def alnum_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return split_words(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _table(word: bool, chars: bytes) -> np.ndarray:
    table = np.full(256, not word)
    table[list(chars)] = word
    return table


_lowered = np.arange(256, dtype=np.uint8)
_lowered[ord("A") : ord("Z") + 1] += 32
SPACED = _table(False, b" \t\n\x0b\x0c\r")
ALNUM = _table(True, bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _weights(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit weights, fixed by position and salt."""
    return fmix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt)) | U(1)


_by_position = _weights(64, 1)


class Words:
    """The words of some texts, as parallel arrays: start and end (bytes in `data`), doc (row), hash."""

    def __init__(self, texts: list[bytes | None], kind: np.ndarray):
        lens = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.data = _lowered[np.frombuffer(b"".join(t for t in texts if t), dtype=np.uint8)]
        n, is_word = len(self.data), kind[self.data]
        begins, stops = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        stops[:-1] &= ~is_word[1:]
        edges = self.offsets[:-1][lens > 0]  # a text's first byte
        begins[edges] = is_word[edges]
        last = self.offsets[1:][lens > 0] - 1
        stops[last] = is_word[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1 if n else np.zeros(0, np.int64)
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = self._hashes(is_word)

    def _hashes(self, is_word: np.ndarray) -> np.ndarray:
        global _by_position
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, U)
        if length.max() > len(_by_position):
            _by_position = _weights(int(length.max()) * 2, 1)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        value = (self.data[is_word].astype(U) + U(1)) * _by_position[place]
        return fmix(np.add.reduceat(value, begin) + length.astype(U) * U(0xD6E8FEB86659FD93))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of n consecutive words of one text, in order."""
        if len(self.hash) < n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        total = np.zeros(len(at), U)
        for i, w in enumerate(_weights(n, 1000 + n)):
            total += self.hash[at + i] * w
        return fmix(total), at


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.to_pylist()


def blocks(texts: list[bytes | None], limit: int = 1_000_000):
    """(from, to) index ranges of about `limit` bytes, so that the arrays of Words stay small."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
