"""Vectorised work on the bytes of many texts at once (numpy, inside Arrow batches).

Words are ``[^\\x20\\x09-\\x0D]+``; these separators are single bytes in UTF-8 and
never part of another character, so word edges are found on raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_P = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_P &= 2**64 - 1
_PI = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pw = _ipw = np.ones(1, np.uint64)


def _lower_pairs() -> np.ndarray:
    """Two UTF-8 bytes as a number -> those of the lower-case letter, where it has two bytes as well."""
    t = np.arange(65536, dtype=np.uint16)
    for cp in range(0x80, 0x800):
        a, b = chr(cp).encode(), chr(cp).lower().encode()
        if len(b) == 2:
            t[a[0] << 8 | a[1]] = b[0] << 8 | b[1]
    return t


_LOWER_PAIR = _lower_pairs()
#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 512 << 10
#: Rows and bytes of the batches that Spark hands to Python, where the session does not say.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark) -> None:
    """Bound what reaches a Python worker at once, unless the session's own settings do."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash's base and of its inverse."""
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, STEP_BYTES + 1)
        a, b = np.full(size, _P, np.uint64), np.full(size, _PI, np.uint64)
        a[0] = b[0] = 1
        with np.errstate(over="ignore"):
            _pw, _ipw = np.cumprod(a), np.cumprod(b)
    return _pw, _ipw


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each."""
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def lower(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters of one or two bytes lower-cased; no byte moves."""
    out = LOWER[raw]
    at = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    if len(at):
        pair = _LOWER_PAIR[out[at].astype(np.uint16) << 8 | out[at + 1]]
        out[at], out[at + 1] = pair >> 8, pair & 0xFF
    return out


def spaced(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The words of the texts one after the other, each with one blank behind it."""
    data = np.insert(raw, off[1:], 32)
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = data[keep]
    out[_SPACE[out]] = 32
    return out


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """``data[start[i]:end[i]]`` as a string column."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(data[ranges(start, size)]))


class Words:
    """The words of some texts: byte ``start`` and ``end`` of each, ``first[d]:first[d+1]`` those of text d."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off = raw, off
        m = np.empty(len(raw) + 2, bool)
        m[0] = m[-1] = False
        np.logical_not(_SPACE[raw], out=m[1:-1])
        edge = m[1:-1] & ~m[:-2]
        tail = m[1:-1] & ~m[2:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        edge[cut] |= m[cut + 1]
        tail[cut - 1] |= m[cut]
        self.start, self.end = np.flatnonzero(edge), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.raw)
        pw, ipw = powers(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * pw[:n], out=s[1:])
        h = (s[self.end] - s[self.start]) * ipw[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes (over text ends too; callers leave those out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out + U(k))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i]+1, ...`` (``count[i]`` of them) one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = count > 0
    s, c = start[keep], count[keep]
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + c[:-1]) + 1
    return np.cumsum(out)
