"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regular expressions: code points become classes by table
lookup, shifted class arrays resolve the pattern's look-ahead into a small alphabet,
and an automaton's transition functions are composed by a blocked associative scan,
which gives the state before every character and with it every token boundary.  The
slices between boundaries go through a bounded cache of pair merging; what is not
cached is merged for a whole batch at once in numpy.  Token offsets come from the
tokens' lengths and are what decoding cuts by.

Defined results
---------------
* null text: encoded as the empty text (no tokens, hash of nothing).
* repeated rows and ties: each row on its own; among equal merge ranks the leftmost pair goes first.
* very long texts: worked on whole; a piece of over ``LONG`` bytes is merged with a heap.
* empty table: empty result.  Extra columns are ignored, whatever their names.

No shuffle; the rank file (under 1 MB) is read by the driver and shipped as a broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ranges, small_batches, steps, text_bytes

#: Pieces that a worker's cache holds before it starts anew.
CACHE = 100_000
#: Bytes of text that are encoded at once; a longer text is a step of its own.
STEP = 256 << 10
#: Bytes of a piece from which merging runs alone, with a heap.
LONG = 64

# -- boundaries --------------------------------------------------------------

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Unicode's White_Space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def class_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for first in range(0, 0x110000, 0x10000):
        if first in (0x40000, 0x50000, 0x60000, 0x70000, 0x80000, 0x90000, 0xA0000, 0xB0000, 0xC0000, 0xD0000, 0xF0000, 0x100000):
            continue  # planes without letters or numbers
        for c in range(first, first + 0x10000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = LETTER
            elif k == "N":
                t[c] = NUMBER
    t[list(WHITE)] = SPACE
    return t


# symbols: what the automaton reads.  Look-ahead is folded into them.
#   L N O        a letter, a number, anything else that is not white space
#   A2 A3        an apostrophe that opens a contraction of two or three characters
#   G            a blank before something that is not white space: it joins what follows
#   H            other single white space before something that is not white space
#   W            white space before white space or at the end of the text
L, N, O, A2, A3, G, H, W, FRESH = range(9)
# states: what the token holds at this place
#   0 nothing (a token ends here), 1 letters, 2 numbers, 3 others, 4 white space,
#   5 a joining blank, 6 and 7 a contraction with one or two characters to come
_STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts before this character)."""
    if state == 6:
        return 0, False
    if state == 7:
        return 6, False
    run = {L: 1, N: 2, O: 3, A2: 3, A3: 3}
    if state == 5:  # the blank takes in whatever follows
        return run[symbol] if symbol in run else 4, False
    if symbol in (A2, A3) and state != 3:
        return (6 if symbol == A2 else 7), True
    if symbol in run:
        return run[symbol], state != run[symbol]
    if symbol == W:
        return 4, state != 4
    return (5 if symbol == G else 0), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, functions, starts[state, symbol]).

    Functions are the closure of the symbols' transition functions under composition.
    FRESH is the constant function to state 0, set before each text."""
    step = [[_step(s, x) for s in range(_STATES)] for x in range(8)]
    base = [tuple(n for n, _ in row) for row in step] + [(0,) * _STATES]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(_STATES)), *base]))}
    queue = list(number)
    for f in queue:
        for g in base:
            fg = tuple(g[x] for x in f)
            if fg not in number:
                number[fg] = len(number)
                queue.append(fg)
    fs = np.array(list(number), np.uint8)
    compose = np.empty((len(fs), len(fs)), np.uint16)
    for i, f in enumerate(number):
        for j, g in enumerate(number):
            fg = tuple(g[x] for x in f)
            compose[i, j] = number.setdefault(fg, len(number))
    if len(number) != len(fs):
        raise AssertionError("transition functions are not closed")
    starts = np.array([[step[x][s][1] for x in range(8)] for s in range(_STATES)], bool)
    return np.array([number[b] for b in base], np.uint16), compose, fs, starts


def scan(items: np.ndarray, compose: np.ndarray, block: int = 128) -> np.ndarray:
    """Exclusive prefix composition of function numbers (0 is the identity)."""
    n = len(items)
    if n == 0:
        return items
    rows = -(-n // block)
    grid = np.zeros((block, rows), items.dtype)
    flat = np.zeros(rows * block, items.dtype)
    flat[:n] = items
    cols = flat.reshape(rows, block).T  # one column step works on all blocks at once
    k = compose.shape[0]
    table = compose.ravel()
    run = np.zeros(rows, items.dtype)
    for j in range(block):
        grid[j] = run
        run = table[run.astype(np.intp) * k + cols[j]]
    if rows > 1:
        lead = scan(run, compose, block)
        grid = table[lead.astype(np.intp)[None, :] * k + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in ``cp`` (code points of some texts, each beginning at one of ``first``) where a token starts."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    cls = class_table()[cp]
    sym = np.array([L, N, W, O], np.uint8)[cls]
    # what follows, within the text
    ends = begins[1:]
    follow = np.empty(n, np.uint8)
    follow[:-1] = cls[1:]
    follow[-1] = SPACE
    follow[ends] = SPACE
    lone = (cls == SPACE) & (follow != SPACE)
    sym[lone] = np.where(cp[lone] == 32, G, H)
    ap = np.flatnonzero(cp == 39)
    if len(ap):
        pad = np.concatenate((cp, np.zeros(2, cp.dtype)))
        c1 = np.where(ends[ap], 0, pad[ap + 1])
        c2 = np.where((c1 == 0) | np.concatenate((ends, [True]))[ap + 1], 0, pad[ap + 2])
        two = np.isin(c1, [ord(c) for c in "stmd"])
        three = np.zeros(len(ap), bool)
        for x, y in ("re", "ve", "ll"):
            three |= (c1 == ord(x)) & (c2 == ord(y))
        sym[ap[two]], sym[ap[three]] = A2, A3
    of, compose, fs, starts = automaton()
    f = of[sym]
    # a text's first character is read from state 0: set the state before it by a constant function
    at = first[first < n]
    at = np.unique(at)
    g = np.insert(f, at, of[FRESH])
    place = np.arange(n) + np.searchsorted(at, np.arange(n), "right")
    state = fs[scan(g, compose)[place], 0]
    out = starts[state, sym]
    out[at] = True
    return np.flatnonzero(out)


# -- merging -----------------------------------------------------------------


class Ranks:
    """A rank table: bytes -> id, with the pairs that merge into each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs: dict[int, int] = {}
        for tok, i in ranks.items():
            for k in range(1, len(tok)):
                a, b = ranks.get(tok[:k]), ranks.get(tok[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = size - 1
        keys, vals = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        todo_k, todo_v = np.fromiter(pairs, np.int64), np.fromiter(pairs.values(), np.int64)
        probe = 0
        while len(todo_k):  # open addressing, all keys of a probe at once
            at = (self._slot(todo_k) + probe) & self.mask
            free = keys[at] == -1
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            keys[at[put]], vals[at[put]] = todo_k[put], todo_v[put]
            rest = np.ones(len(todo_k), bool)
            rest[put] = False
            todo_k, todo_v = todo_k[rest], todo_v[rest]
            probe += 1
        self.keys, self.vals, self.probes = keys, vals, probe
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("every single byte needs a rank")
        top = max(ranks.values())
        by = [b""] * (top + 1)
        for tok, i in ranks.items():
            by[i] = tok
        self.tokens = by
        self.length = np.array([len(t) for t in by], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)))
        self.data = np.frombuffer(b"".join(by), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(30)).astype(np.int64) & self.mask

    def rank_of(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        out = np.full(key.shape, none, np.int64)
        for p in range(self.probes):
            k = self.keys[(at + p) & self.mask]
            hit = k == key
            out[hit] = self.vals[((at + p) & self.mask)[hit]]
            if not ((k != -1) & ~hit).any():
                break
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        ids = [int(x) for x in self.byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.pairs.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece.  Short pieces are merged together: in each round every piece
        merges its pair of least rank, the leftmost where ranks are equal."""
        out: list = [None] * len(pieces)
        short: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = [r]
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                short.setdefault(-(-len(p) // 8) * 8, []).append(i)
        none = 1 << 40
        for width, rows in short.items():
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                ids = np.full((len(part), width + 1), -1, np.int64)
                size = np.array([len(pieces[i]) for i in part])
                flat = self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                ids[np.repeat(np.arange(len(part)), size), ranges(np.zeros(len(part), np.int64), size)] = flat
                live = np.arange(len(part))
                rank = np.where(ids[:, 1:] >= 0, self.rank_of(ids[:, :-1], ids[:, 1:], none), none)
                while True:
                    r = rank[live]
                    best = r.argmin(1)
                    least = r[np.arange(len(live)), best]
                    go = least < none
                    live, best, least = live[go], best[go], least[go]
                    if not len(live):
                        break
                    x, k = ids[live], rank[live]
                    col = np.arange(width + 1)[None, :]
                    # drop what stands right of the merged pair's left half
                    x = np.where(col <= best[:, None], x, np.concatenate((x[:, 1:], np.full((len(x), 1), -1)), 1))
                    k = np.where(col[:, :-1] <= best[:, None], k, np.concatenate((k[:, 1:], np.full((len(k), 1), none)), 1))
                    i = np.arange(len(live))
                    x[i, best] = least
                    nb = x[i, best + 1]
                    k[i, best] = np.where(nb >= 0, self.rank_of(least, nb, none), none)
                    p = best > 0
                    k[i[p], best[p] - 1] = self.rank_of(x[i[p], best[p] - 1], least[p], none)
                    ids[live], rank[live] = x, k
                n = (ids >= 0).sum(1).tolist()
                for i, row, m in zip(part, ids.tolist(), n, strict=True):
                    out[i] = row[:m]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes batches of texts, with a bounded cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE):
        self.ranks, self.limit = Ranks(ranks), cache
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(self.limit + 1, np.int64)
        self.used = 0

    def _learn(self, pieces: list[bytes]) -> None:
        merged = self.ranks.merge_many(pieces)
        n = len(self.number)
        sizes = [len(m) for m in merged]
        flat = np.fromiter((x for m in merged for x in m), np.uint32, sum(sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        if n + len(pieces) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(n + len(pieces), np.int64)))
        self.begin[n + 1 : n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts given by their UTF-8 bytes and byte offsets."""
        lead = (raw & 0xC0) != 0x80  # the bytes that begin a character
        data = raw.tobytes()
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(lead)
        first = np.searchsorted(at, off[:-1])
        cut = at[boundaries(cp, first)] if len(cp) else np.zeros(0, np.int64)
        count = np.diff(np.searchsorted(cut, off))
        edge = [*cut.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        if len(self.number) > self.limit:
            self._clear()
        number = self.number
        new = [p for p in dict.fromkeys(pieces) if p not in number]
        if new:
            self._learn(new)
        k = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        size = self.begin[k + 1] - self.begin[k]
        ids = self.ids[ranges(self.begin[k], size)]
        per = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        return ids, per

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offset of each token and of the end)."""
        r = self.ranks
        size = r.length[ids]
        return r.data[ranges(r.begin[ids], size)], np.concatenate(([0], np.cumsum(size)))


# -- Spark -------------------------------------------------------------------

_codecs: dict[int, Codec] = {}


#: Columns beside the digests, and their types.
EXTRA = {"ids": "array<int>", "offsets": "array<long>", "decoded": "string"}


def _digests(data: bytes, edge: list[int]) -> pa.Array:
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edge, edge[1:], strict=False)], pa.string())


def _encode_batches(shipped, extra: tuple[str, ...]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shipped.value
        if (codec := _codecs.get(id(ranks))) is None:  # a worker serves many tasks
            _codecs.clear()
            codec = _codecs[id(ranks)] = Codec(ranks)
        for big in batches:
            for batch in steps(big, limit=STEP):
                raw, off = text_bytes(batch.column("text"))
                ids, per = codec.encode(raw, off)
                back, token_at = codec.decode(ids)
                ids4, decoded, cut = ids.astype("<u4").tobytes(), back.tobytes(), token_at[per]
                out = {
                    "k": batch.column("k"), "n_tokens": pa.array(np.diff(per), pa.int64()),
                    "ids_sha256": _digests(ids4, (4 * per).tolist()), "decoded_sha256": _digests(decoded, cut.tolist()),
                }
                if "ids" in extra:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(ids.view(np.int32)))
                if "offsets" in extra:  # one more than ids in each text
                    n = np.diff(per) + 1
                    flat = token_at[ranges(per[:-1], n)] - np.repeat(cut[:-1], n)
                    out["offsets"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int64()))
                if "decoded" in extra:
                    out["decoded"] = pa.array([decoded[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return f


def byte_bpe(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, as named in ``extra`` (in this order), ``ids``, byte
    ``offsets`` (one more than ids) and the ``decoded`` text.

    ``ranks_path``: a rank file (base64 token, blank, rank) on the driver."""
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    extra = tuple(c for c in EXTRA if c in extra)
    schema = ", ".join(["k long, n_tokens long, ids_sha256 string, decoded_sha256 string", *[f"{c} {EXTRA[c]}" for c in extra]])
    out = df.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("text")).mapInArrow(_encode_batches(shipped, extra), schema)
    return out.withColumnRenamed("k", doc_id)
