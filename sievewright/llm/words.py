"""Words of whole Arrow text columns as spans and 64-bit keys, by numpy over the column's bytes.

A word class is a set of bytes; all bytes of multi-byte UTF-8 characters belong to it, so spans never cut a character.
Keys are polynomial hashes modulo 2**64 over a random byte table, then mixed: two given words of up to some thousand
bytes share a key with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Fixed: everything but ASCII white space (0x20, 0x09 to 0x0D).
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Fixed, after folding: digits, a to z, and all non-ASCII bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15 | 5, U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads every bit."""
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, SLICE + (SLICE >> 2))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(m, U(base))
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of rows lo to hi of a column. bounds[i]:bounds[i + 1] are row lo + i's words."""

    lo: int
    hi: int
    data: np.ndarray  # folded bytes
    text: np.ndarray  # byte offsets of the rows, one more than rows
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    key: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a text column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    _, offs, data = values.buffers()
    at = np.frombuffer(offs, np.int64)[values.offset : values.offset + len(values) + 1]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(values: pa.Array, member: np.ndarray, keys: bool = True, most: int = SLICE) -> Iterator[Words]:
    """The words, maximal runs of ``member`` bytes of the folded text, of every row, some rows at a time."""
    data, at = column(values)
    for lo, hi in slices(at, most):
        own = at[lo : hi + 1] - at[lo]
        x = FOLD[data[at[lo] : at[hi]]]
        yield _split(lo, hi, x, own, member, keys)


def texts(values: pa.Array, most: int = SLICE) -> Iterator[Words]:
    """The folded text of every row, some rows at a time, with no words."""
    data, at = column(values)
    none = np.zeros(0, np.int64)
    for lo, hi in slices(at, most):
        yield Words(lo, hi, FOLD[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo], none, none, none, np.zeros(0, U))


def _split(lo: int, hi: int, x: np.ndarray, own: np.ndarray, member: np.ndarray, keys: bool) -> Words:
    n = len(x)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = member[x]
    edge = np.zeros(n + 1, dtype=bool)
    edge[own] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    stops[:-1] &= ~inside[1:] | edge[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    key = np.zeros(0, np.uint64)
    if keys:
        with np.errstate(over="ignore"):
            up, down = _power(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[x] * up[:n], out=sums[1:])
            key = mix((sums[end] - sums[start]) * down[start]) if len(start) else key
    return Words(lo, hi, x, own, start, end, np.searchsorted(start, own), key)


_ODD = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def chain(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n consecutive words."""
    m = max(0, len(keys) - n + 1)
    total = np.full(m, U(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            total += keys[j : j + m] * (_ODD[j % 64] + U(j // 64 * 2))
        return mix(total)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every run of n words inside a row; a row of fewer words, but not none, gives its whole sequence."""
    counts, first = w.counts(), w.bounds[:-1]
    runs = np.where(counts >= n, counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
    rows, keys = [row], [chain(w.key, n)[at] if len(at) else np.zeros(0, np.uint64)]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            rows.append(short)
            keys.append(chain(w.key, m)[first[short]])
    return np.concatenate(rows), np.concatenate(keys)
