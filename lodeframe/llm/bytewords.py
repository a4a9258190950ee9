"""Words of whole Arrow batches as arrays: spans, lines and 64-bit names, without a loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 18
SPACES = b" \t\n\v\f\r"

_rng = np.random.default_rng(20240229)
#: A random value for each byte; A-Z has those of a-z, white space has zero.
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[np.arange(65, 91)] = _VALUE[np.arange(97, 123)]
_VALUE[list(SPACES)] = 0
_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Values and base of a second family of names, independent of the first; longer words have a digest instead.
_CHECK = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHECK[np.arange(65, 91)] = _CHECK[np.arange(97, 123)]
_CHECK[list(SPACES)] = 0
_CHECK_BASE = np.uint64(0xD1342543DE82EF95)
DIGESTED = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=2)
def _scales(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2**64."""
    return powers(n, base), powers(n, np.uint64(pow(int(base), -1, 1 << 64)))


def _sums(value: np.ndarray, data: np.ndarray, start: np.ndarray, base: np.uint64) -> np.ndarray:
    """For each word the sum of its bytes' values times the powers of ``base``; bytes between words have none."""
    up, down = _scales(max(CHUNK, 1 << (data.size - 1).bit_length()), base) if data.size else (data, data)
    share = value[data]
    share *= up[: data.size]
    return np.add.reduceat(share, start) * down[start]


@dataclass
class Words:
    """Of rows ``first`` .. of a batch: bytes, text offsets, and for each word its span, text and name."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    name: np.ndarray
    of: np.ndarray

    def checks(self) -> np.ndarray:
        """A second 64-bit name of each word, so that both together are 128 bits."""
        if not self.start.size:
            return np.empty(0, np.uint64)
        size = self.end - self.start
        out = mix(_sums(np.where(self.of, _CHECK, np.uint64(0)), self.data, self.start, _CHECK_BASE) + size.astype(np.uint64))
        for k in np.flatnonzero(size > DIGESTED).tolist():
            word = self.data[self.start[k] : self.end[k]].tobytes().lower()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest())
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its line within the chunk, counted over all texts, and the line within its text."""
        breaks = np.flatnonzero(self.data == 10)
        at = np.cumsum(np.bincount(np.searchsorted(self.start, breaks), minlength=self.start.size + 1)[:-1])
        return at + self.text, at - np.searchsorted(breaks, self.offsets[:-1])[self.text]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of a string column without nulls, about CHUNK bytes at a time."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


#: Bytes of letters and digits: ASCII ones, and all of other characters.
ALPHANUMERIC = np.arange(256) >= 128
ALPHANUMERIC[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def words(column: pa.Array, of: np.ndarray = _WORD) -> Iterator[Words]:
    """Words of a string column without nulls: runs of the bytes in ``of``, by default
    ``[^\\x20\\x09-\\x0D]+``; names don't tell A-Z from a-z."""
    value = np.where(of, _VALUE, np.uint64(0))
    for first, data, offsets in chunks(column):
        n = data.size
        inside = of[data]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | head[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | head[1:n]
        start = np.flatnonzero(begin)
        end = np.flatnonzero(stop) + 1
        name = mix(_sums(value, data, start, _BASE)) if start.size else np.empty(0, np.uint64)
        text = np.repeat(np.arange(offsets.size - 1), np.diff(np.searchsorted(start, offsets)))
        yield Words(first, data, offsets, start, end, text, name, of)


def names_of_beginnings(w: Words, at: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length a value for that many first bytes of the words ``at``; of no use where a word is shorter."""
    place = w.start[at][:, None] + np.arange(max(lengths))
    share = _VALUE[w.data[np.minimum(place, max(w.data.size - 1, 0))]] * powers(max(lengths))
    total = np.cumsum(share, axis=1, dtype=np.uint64)
    return [total[:, k - 1] for k in lengths]
