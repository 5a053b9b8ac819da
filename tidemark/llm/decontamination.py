"""Benchmark decontamination under edit distance.

A document is contaminated by an item of n words if one of its passages, whatever its
length, is within ``k = floor((1 - similarity) * n)`` word edits of the item.

1. Such a passage of m words keeps n - k words and n - 1 - 2k word pairs of its item, and so
   does the window of n words from its start (of fewer where the text ends before).  Running counts of the items' words and pairs, per item
   size, drop windows with fewer; nothing is lost by that.
2. Remaining windows and all items are embedded by CGK random walks (edit distance to
   Hamming distance): at step j the walk writes the current word and moves on if a random
   bit of (walk, j, word) is set, 3n steps in all.  ``WALKS`` walks with ``TABLES`` samples
   of ``SAMPLED`` positions each give the buckets; sharing one makes a candidate.
   At half the positions equal, 1 - (1 - 0.5**2)**32 = 0.9999 of pairs share one.
3. Candidates are verified, many at once, by the exact edit distance of the item to the best
   passage of the text around the window (2k words more on both sides; candidates of one
   item near each other share one such area).

Words are lower-cased (letters of one or two UTF-8 bytes: Latin, Greek, Cyrillic) and lose
ASCII punctuation at both ends; what is then empty is no word.

The work is map-only: documents are not shuffled and a passage in a third of all
documents costs each of them the same.  The benchmark goes to the executors in blocks
of at most ``BLOCK_WORDS`` words, each block one pass over the documents.

Defined results
---------------
* null or empty text, no words: no row.  A null id: rows carry the null id.
* items that are null or have no words: not searched for.  Items so short that no edit is allowed
  (under five words) are looked up by their words' hash: every copy of them is a hit.
* null item ids: searched for like others; their rows carry the null id.
* ``n_words`` and the byte span are those of the passage, which may have up to k words more
  or fewer than its item.  Texts of n - k words and more are looked at.
* ties: per document and item the passage of least distance, then the leftmost, then the one
  whose length is nearest the item's.
* repeated documents and items: each gives its own rows.
* very long texts: whole, linear in their words.
* empty tables: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, table
from .textops import U, Words, grams, lower, mix, powers, ranges, small_batches, steps, text_bytes

SIMILARITY, MIN_WORDS = 0.8, 1
WALKS, TABLES, SAMPLED = 8, 4, 2
#: Words of items that are shipped at once (8 bytes each, and as much again for their buckets).
BLOCK_WORDS = 1_000_000

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Normal:
    """Normalised words of some texts: hashes, byte spans, and ``first[d]:first[d+1]`` of text d."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        w = Words(lower(raw), off)
        start, end = w.start.copy(), w.end.copy()
        live = np.arange(len(start))
        while len(live):
            live = live[(start[live] < end[live]) & _PUNCT[raw[np.minimum(start[live], len(raw) - 1)]]]
            start[live] += 1
        live = np.flatnonzero(start < end)
        while len(live):
            live = live[_PUNCT[raw[end[live] - 1]]]
            end[live] -= 1
        keep = start < end
        self.start, self.end = start[keep], end[keep]
        self.first = np.concatenate(([0], np.cumsum(keep)))[w.first]
        w.start, w.end = self.start, self.end
        self.hash = w.hashes()


def _sampled() -> np.ndarray:
    """(WALKS, TABLES * SAMPLED) places of the samples, as shares of a walk's 2n steps (after which it has
    passed all words on average)."""
    return np.random.Generator(np.random.PCG64(7)).random((WALKS, TABLES * SAMPLED))


def buckets(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, WALKS * TABLES) bucket keys of word rows; row r has ``n[r]`` words and then zeros, at least one."""
    m = len(words)
    rows = np.arange(m)
    at = np.zeros((WALKS, m), np.int32)
    walk = (np.arange(1, WALKS + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F))[:, None]
    place = (_sampled()[:, :, None] * (2 * n)).astype(np.int64)
    steps_ = int(place.max(initial=0)) + 1
    trace = np.empty((steps_, WALKS, m), np.int32)
    flat, base = words.ravel(), rows * words.shape[1]
    keys = np.empty((m, WALKS * TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(steps_):
            trace[j] = at
            bit = mix(flat[base + at] ^ (walk + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))) >> U(63)
            at = np.minimum(at + bit.astype(np.int32), n)
        for w in range(WALKS):
            for t in range(TABLES):
                k = mix(n.astype(np.uint64) * U(0x100000001B3) + U(w * TABLES + t + 1))
                for i in range(t * SAMPLED, (t + 1) * SAMPLED):
                    k = mix(k * U(0xD6E8FEB86659FD93) + flat[base + trace[place[w, i], w, rows]])
                keys[:, w * TABLES + t] = k
    return keys


def best_passages(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of the passage of ``b[r, :size[r]]`` nearest to ``a[r, :n[r]]`` in word edits, for each row."""
    m, width = len(b), b.shape[1]
    base = width + 1  # a cell is its distance times this, plus the start of its passage
    small = (int(n.max(initial=0)) + width + 1) * base < 2**31
    cols = np.arange(width + 1, dtype=np.int32 if small else np.int64)
    slope = cols * base
    row = np.broadcast_to(cols, (m, width + 1)).copy()
    out = row.copy()
    for i in range(int(n.max(initial=0))):
        best = row + base
        np.minimum(best[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b) * cols.dtype.type(base), out=best[:, 1:])
        best -= slope
        row = np.minimum.accumulate(best, axis=1, out=best)
        row += slope
        done = n == i + 1
        if done.any():
            out[done] = row[done]
    out[cols > size[:, None]] = np.iinfo(out.dtype).max
    least = out.min(axis=1)
    odd = np.where(out == least[:, None], np.abs(cols - (least % base + n)[:, None]), 2 * base + int(n.max(initial=0)))
    return (least // base).astype(np.int64), (least % base).astype(np.int64), odd.argmin(axis=1)


def _rows(h: np.ndarray, start: np.ndarray, n: np.ndarray, width: int, pad: np.ndarray | int = 0) -> np.ndarray:
    """Words from ``start``, ``n`` of them, then zeros; ``pad`` zeros before."""
    out = np.zeros((len(start), width), np.uint64)
    r = np.repeat(np.arange(len(start)), n)
    out[r, ranges(np.broadcast_to(pad, len(start)), n)] = h[ranges(start, n)]
    return out


def _find(names: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in sorted ``names``; ``len(names)`` if it is not there."""
    out = np.full(len(h), len(names), np.int32)
    if len(names) and len(h):
        maybe = np.zeros(1 << 20, bool)
        maybe[(names >> U(44)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(h >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(names, h[some]), len(names) - 1)
        real = names[at] == h[some]
        out[some[real]] = at[real]
    return out


class Benchmark:
    """Items by size, with their vocabulary and buckets.

    Items are kept one after the other and padded only for the step that needs them, so one long item
    does not widen the others."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, min_words: int = MIN_WORDS):
        raw = [(t or "").encode() for _, t in items]
        off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        w = Normal(np.frombuffer(b"".join(raw), np.uint8), off)
        count = np.diff(w.first)
        edits = ((1 - similarity) * count + 1e-9).astype(np.int64)
        #: items that allow no edit: by size, hashes of their words and whose they are
        self.exact: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.flat = w.hash
        use = np.flatnonzero((count >= max(1, min_words)) & (edits > 0))
        short = np.flatnonzero((count >= max(1, min_words)) & (edits == 0))
        every = np.concatenate((use, short))
        self.ids = pa.array([items[r][0] for r in every], pa.int64())
        self.n, self.at, self.edits = count[every], w.first[every], edits[every]
        for n in np.unique(count[short]).tolist():
            own = np.flatnonzero((self.n == n) & (self.edits == 0))
            key = np.array([grams(w.hash[a : a + n], n)[0] for a in self.at[own].tolist()], np.uint64)
            order = np.argsort(key, kind="stable")
            self.exact.append((n, key[order], own[order]))
        m = len(use)
        self.longest = int(self.n[:m].max(initial=0))
        keys = np.zeros((m, WALKS * TABLES), np.uint64)
        order, at = np.argsort(self.n[:m], kind="stable"), 0
        while at < m:  # by size: rows of a step are about as long, and a step's walks take bounded memory
            o = order[at : at + max(1, 1_000_000 // int(self.n[order[at]]))]
            o = o[: max(1, int(np.searchsorted(self.n[o] * np.arange(1, len(o) + 1), 1_000_000)))]
            keys[o] = buckets(self.rows(o, int(self.n[o].max()) + 1), self.n[o])
            at += len(o)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], order // keys.shape[1]
        #: (words, edits allowed, hashes of these items' words)
        by = {n: np.flatnonzero(self.n[:m] == n) for n in np.unique(self.n[:m]).tolist()}
        self.sizes = [(n, int((1 - similarity) * n + 1e-9), np.unique(self.flat[ranges(self.at[o], self.n[o])])) for n, o in by.items()]
        self.vocabulary = np.unique(np.concatenate([s[2] for s in self.sizes])) if self.sizes else np.zeros(0, np.uint64)
        self.uses = [np.append(np.isin(self.vocabulary, s[2]), False) for s in self.sizes]
        self.pairs = np.unique(grams(self.flat, 2)[ranges(self.at[:m], self.n[:m] - 1)]) if self.sizes else self.vocabulary
        # every window within its bound has a run of ``self.span`` word pairs of which ``self.least`` are an item's
        ns = [(s[0], s[1]) for s in self.sizes]
        self.span = min((n - 1 for n, _ in ns), default=1)
        self.least = max(0, min((self.span - 2 * k // ((n - 1) // self.span) for n, k in ns), default=0))

    def rows(self, items: np.ndarray, width: int) -> np.ndarray:
        """The words of items, zeros behind them."""
        return _rows(self.flat, self.at[items], self.n[items], width)

    def _copies(self, w: Normal) -> list[tuple]:
        """Copies of the items that allow no edit."""
        out, last = [], np.repeat(w.first[1:], np.diff(w.first))
        for n, key, own in self.exact:
            g = grams(w.hash, n)
            lo, hi = np.searchsorted(key, g, "left"), np.searchsorted(key, g, "right")
            s = np.flatnonzero(hi > lo)
            s = s[last[s] - s >= n]
            i = own[ranges(lo[s], hi[s] - lo[s])]
            s = np.repeat(s, hi[s] - lo[s])
            out.append((np.searchsorted(w.first, s, "right") - 1, i, np.zeros(len(s), np.int64), s, np.full(len(s), n)))
        return out

    def matches(self, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """All (text, item) hits: text, item, distance, size and the byte span of the passage."""
        w = Normal(raw, off)
        first = w.first
        names = ("text", "item", "distance", "start", "size")
        out = [tuple(np.zeros(0, np.int64) for _ in names), *self._copies(w)]
        at = self._dense(w.hash)  # the words near enough to items' word pairs
        if len(at):
            s, size, n, pad = self._windows(w.hash, at, first)
            window, item, exact = self._lookup(w.hash, s, size, n, pad)
            start = s[window]
            text = np.searchsorted(first, start, "right") - 1
            out.append((text[exact], item[exact], np.zeros(int(exact.sum()), np.int64), start[exact], self.n[item[exact]]))
            # nothing is nearer than a copy, and copies are all found
            pair = text * len(self.n) + item
            rest = ~np.isin(pair, pair[exact])
            out += self._verify(w.hash, first, text[rest], item[rest], start[rest])
        got = {x: np.concatenate(c) for x, c in zip(names, zip(*out, strict=True), strict=True)}
        order = np.lexsort((np.abs(got["size"] - self.n[got["item"]]), got["start"], got["distance"], got["item"], got["text"]))
        got = {x: v[order] for x, v in got.items()}
        if len(order):
            new = np.concatenate(([True], (np.diff(got["text"]) != 0) | (np.diff(got["item"]) != 0)))
            got = {x: v[new] for x, v in got.items()}
            base = off[got["text"]]
            got["from"] = w.start[got["start"]] - base
            got["to"] = w.end[got["start"] + got["size"] - 1] - base
        else:
            got["from"] = got["to"] = got["start"]
        return got

    def _windows(self, h: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, words, words of the items looked for, empty words before) of the windows with enough words and pairs, among the places ``at``."""
        d, M = h[at], len(at)
        word = _find(self.vocabulary, d)
        b = np.concatenate(([0], np.cumsum(_find(self.pairs, grams(d, 2)) < len(self.pairs), dtype=np.int32)))
        here = np.arange(M)
        lead = at - np.repeat(first[:-1], np.diff(first))[at]  # from where each word's text begins
        room = np.repeat(first[1:], np.diff(first))[at] - at  # to where it ends
        run = np.searchsorted(at - here, at - here, "right") - here  # and where its dense run does
        out = []
        for (n, k, _), use in zip(self.sizes, self.uses, strict=True):
            c = np.concatenate(([0], np.cumsum(use[word], dtype=np.int32)))
            full = np.zeros(0, np.int64)
            if n <= M:
                full = np.flatnonzero((c[n:] - c[:-n] >= n - k) & (b[n - 1 :] - b[: M - n + 1] >= n - 1 - 2 * k) & (np.minimum(room, run)[: M - n + 1] >= n))
            cut = np.flatnonzero((room < n) & (room >= n - k) & (run >= room))  # windows the text's end cuts
            end = cut + room[cut]
            cut = cut[(c[end] - c[cut] >= n - k) & (b[end - 1] - b[cut] >= n - 1 - 2 * k)]
            # windows that begin before their text, with words of no text: walks of shortened items meet at some of them
            s = np.concatenate((full, cut))
            s = np.unique((at - lead)[s[lead[s] < k]])
            pad, s = np.tile(np.arange(1, k + 1), len(s)), np.repeat(s, k)
            end = first[np.searchsorted(first, s, "right")]
            for x, y, z in ((full, n, 0), (cut, room[cut], 0), (None, np.minimum(n - pad, end - s), pad)):
                x = s if x is None else at[x]
                out.append([np.broadcast_to(v, len(x)) for v in (x, y, n, z)])
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _dense(self, h: np.ndarray) -> np.ndarray:
        """Places of words within ``longest`` of a run dense in items' word pairs; all places where no run need be."""
        N = len(h)
        if not N or not self.sizes:
            return np.zeros(0, np.int64)
        if self.least == 0:
            return np.arange(N)
        h = np.concatenate((h, np.zeros(self.longest, np.uint64)))  # a passage at the end may be shorter than a run
        c = np.concatenate(([0], np.cumsum(_find(self.pairs, grams(h, 2)) < len(self.pairs), dtype=np.int32)))
        hit = np.flatnonzero(c[self.span :] - c[: -self.span] >= self.least)
        edge = np.zeros(len(h) + 1, np.int32)
        np.add.at(edge, np.maximum(hit - self.longest, 0), 1)
        np.add.at(edge, np.minimum(hit + self.span + 1 + self.longest, len(h)), -1)
        return np.flatnonzero(np.cumsum(edge[:N]) > 0)

    def _lookup(self, h: np.ndarray, s: np.ndarray, size: np.ndarray, n: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place of the item, whether they are equal) of the windows (starts ``s``) that share a bucket with an item."""
        # equal windows (repeated lines, one passage in many texts) are looked up once
        pw, ipw = powers(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * pw[: len(h)])))
            key = mix((sums[s + size] - sums[s]) * ipw[s] + (n.astype(np.uint64) << U(32) | pad.astype(np.uint64)) * U(0x100000001B3))
        _, one, back, copies = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        one = one[by := np.argsort(n[one], kind="stable")]  # windows of a step are about as long
        back = np.argsort(by)[back]
        copies = copies[by]
        order, begin = np.argsort(back, kind="stable"), np.cumsum(copies) - copies
        out, m = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))], len(self.n)
        at = 0
        while at < len(one):
            o = one[at : at + max(1, 1_500_000 // int(n[one[at]] + 1))]
            o = o[: max(1, int(np.searchsorted((n[o] + 1) * np.arange(1, len(o) + 1), 1_500_000)))]
            width = int(n[o].max()) + 1
            part = max(1, 1_500_000 // width)
            windows = _rows(h, s[o], size[o], width, pad[o])
            b = buckets(windows, n[o]).ravel()
            lo, hi = np.searchsorted(self.keys, b, "left"), np.searchsorted(self.keys, b, "right")
            window = np.repeat(np.arange(len(o)), WALKS * TABLES)
            pair = np.unique(np.repeat(window, hi - lo) * m + self.owner[ranges(lo, hi - lo)])
            for p in range(0, len(pair), part):
                i, j = np.divmod(pair[p : p + part], m)
                ok = n[o[i]] == self.n[j]
                i, j = i[ok], j[ok]
                same, u = (windows[i] == self.rows(j, width)).all(axis=1), i + at
                out.append((order[ranges(begin[u], copies[u])], np.repeat(j, copies[u]), np.repeat(same, copies[u])))
            at += len(o)
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _verify(self, h: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> list[tuple]:
        """(text, place of the item, distance, start, words) arrays of the best passages around candidates, where within their bounds."""
        if not len(start):
            return []
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        n, k = self.n[item], self.edits[item]
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(start) > k[1:])
        begin = np.flatnonzero(new)
        lead = np.repeat(start[begin], np.diff(np.append(begin, len(start))))
        new[1:] |= np.diff((start - lead) // np.maximum(n, 1)) != 0  # long chains are cut, areas overlap
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(start)) - 1
        text, item, n, k = text[begin], item[begin], n[begin], k[begin]
        lo = np.maximum(first[text], start[begin] - 2 * k)
        size = np.minimum(first[text + 1], start[last] + n + 2 * k) - lo
        out = []
        order, at = np.lexsort((size, n)), 0
        while at < len(order):
            # sorted by words, so rows are about as long as the chunk's last
            to = min(len(order), at + max(1, 1_500_000 // int(size[order[at]] + 1)))
            o = order[at:to]
            to = at + max(1, int(np.searchsorted(np.maximum.accumulate(size[o]) * np.arange(1, len(o) + 1), 2_000_000)))
            o = order[at:to]
            d, a, e = best_passages(self.rows(item[o], int(n[o].max())), _rows(h, lo[o], size[o], int(size[o].max())), n[o], size[o])
            ok = (d <= k[o]) & (e > a)
            out.append((text[o][ok], item[o][ok], d[ok], (lo[o] + a)[ok], (e - a)[ok]))
            at = to
        return out


def _scan(shipped):
    names = ["doc_id", "item_id", "distance", "n_words", "start_byte", "end_byte"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shipped.value
        for big in batches:
            for batch in steps(big):
                m = bench.matches(*text_bytes(batch.column("text")))
                if len(m["text"]):
                    ids = batch.column("doc_id").take(pa.array(m["text"]))
                    yield pa.RecordBatch.from_arrays([ids, bench.ids.take(pa.array(m["item"])), *[pa.array(m[x].astype(np.int64)) for x in ("distance", "size", "from", "to")]], names)

    return f


def _clean(shipped, text: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shipped.value
        for big in batches:
            for batch in steps(big, text):
                ok = np.ones(batch.num_rows, bool)
                ok[bench.matches(*text_bytes(batch.column(text)))["text"]] = False
                yield batch.filter(pa.array(ok))

    return f


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, similarity: float, min_words: int) -> tuple[int, Iterator[Benchmark]]:
    """How many blocks of about BLOCK_WORDS words the benchmark has, and the blocks; one at a time is on the driver."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    words = items.agg(F.sum(F.size(F.split("t", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = int(words // BLOCK_WORDS) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    return blocks, (Benchmark([(r["i"], r["t"]) for r in dealt.filter(F.col("block") == b).collect()], similarity, min_words) for b in range(blocks))


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, n_words, start_byte, end_byte``: the best window of each document
    for each item that contaminates it."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks, every = _blocks(benchmark, item_id, item_text, similarity, min_words)
    out = None
    for bench in every:
        shipped = spark.sparkContext.broadcast(bench)
        hits = docs.mapInArrow(_scan(shipped), "doc_id long, item_id long, distance long, n_words long, start_byte long, end_byte long")
        if blocks > 1:  # one block's broadcast at a time
            hits = table(hits)
            shipped.destroy()
        out = hits if out is None else out.union(hits)
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` without its contaminated rows.  Columns of ``df`` may have any names."""
    spark = df.sparkSession
    small_batches(spark)
    blocks, every = _blocks(benchmark, item_id, item_text, similarity, min_words)
    for i, bench in enumerate(every):
        shipped, before = spark.sparkContext.broadcast(bench), df
        df = before.mapInArrow(_clean(shipped, text), df.schema)
        if blocks > 1:
            df = table(df)
            if i:
                drop(spark, before)
            shipped.destroy()
    return df
