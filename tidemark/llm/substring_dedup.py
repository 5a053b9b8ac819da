"""Substring dedup with compressed FM-indexes.

A window is ``width`` consecutive words of one document.  Every word under a
window that also starts in a document with a smaller id is removed; windows are
judged on the input.

1. Each window has an anchor: of the runs of ``ANCHOR`` words in it, the one with
   the smallest hash.  Equal windows have equal anchors, so documents share a window
   only if they share an anchor.  Anchors are written once and go through one aggregation
   to the smallest and largest id; those of one document only are done with.
2. Documents are cut into segments: the words under a run of windows with one anchor.
   Equal segments collapse before anything is gathered, so a passage in a third of
   all documents is one segment.  Of an anchor met more than ``HOT_RUNS`` times each
   window is a segment of its own, dealt by the window's hash; so what one anchor
   brings together is bounded.
3. Distinct segments are dealt to shards of bounded size by their anchor, in the order of the first
   document that has each.  A shard keeps an FM-index of its segments: the Burrows-Wheeler transform over word
   numbers and the array of documents by suffix, both as wavelet matrices of packed bits.
   The segments of each document are streamed through backward search against the
   documents before it: the match that ends at a word grows to the left as long as the
   suffix interval holds a smaller document.  These are the matching statistics; words
   under matches of ``width`` words and more are reported as intervals.
4. The first document of a segment gets the segment's intervals, any later one all of it.

Every job is an aggregation or an equi-join over rows of bounded width, hot keys apart
(``scratch.join_counted``); nothing of corpus size is broadcast or reaches the driver
(sums do).

Defined results
---------------
* null or empty text: no words; nothing removed; the hash of the empty string.
* null id: such a document is neither trimmed nor does it trim others.
* repeated rows (same id, same text): treated as one document, each returned.
  Rows with one id but other texts: windows between them are not compared.
* fewer words than ``width``: kept whole.
* very long texts: handled whole; work is linear in their words.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, free_name, join_counted, table
from .textops import U, Words, grams, mix, ranges, slices, small_batches, spaced, steps, text_bytes

WIDTH, ANCHOR = 13, 4
#: Runs of windows with one anchor from which its windows are dealt one by one.
HOT_RUNS = 4096
#: Words of distinct segments in one shard's index, on average.
SHARD_WORDS = 100_000


# -- the index ---------------------------------------------------------------


class Wavelet:
    """A wavelet matrix: an integer sequence as one packed bit row for each bit of its values."""

    def __init__(self, values: np.ndarray, sigma: int):
        n = len(values)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            b = ((values >> bit) & 1).astype(bool)
            packed = np.zeros(-(-n // 64) * 8 + 8, np.uint8)
            p = np.packbits(b, bitorder="little")
            packed[: len(p)] = p
            word = packed.view(np.uint64)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(word)[:-1], dtype=np.int32))).astype(np.int32)
            self.levels.append((bit, word, ones, int(n - b.sum())))
            values = np.concatenate((values[~b], values[b]))

    @staticmethod
    def _ones(word: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return ones[w] + np.bitwise_count(word[w] & ((U(1) << (at & 63).astype(np.uint64)) - U(1)))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` falls among the equal symbols on the lowest row."""
        for bit, word, ones, zeros in self.levels:
            r = self._ones(word, ones, at)
            at = np.where((symbol >> bit) & 1, zeros + r, at - r)
        return at

    def any_below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whether ``sequence[lo:hi]`` holds something smaller than ``value``."""
        found = np.zeros(len(lo), bool)
        for bit, word, ones, zeros in self.levels:
            a, b = self._ones(word, ones, lo), self._ones(word, ones, hi)
            one = ((value >> bit) & 1).astype(bool)
            found |= one & ((hi - b) > (lo - a))
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return found


class FMIndex:
    """FM-index of segments (symbols from 1), each of a document, for patterns of up to 31 symbols.

    Suffixes are sorted by their first 32 symbols, more than any pattern looks at.  The suffix
    array itself is not kept: intervals are asked about documents, not places."""

    def __init__(self, text: np.ndarray, document: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        for k in (1, 2, 4, 8, 16):
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (int(nxt.max(initial=0)) + 1) + nxt
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64)))) if n else order
        sigma = int(text.max(initial=0)) + 1
        self.c = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.bwt = Wavelet(text[order - 1], sigma)
        self.documents = Wavelet(document[order], int(document.max(initial=0)) + 1)
        self.begin = self.bwt.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns: their intervals with ``symbol`` put before."""
        both = self.bwt.descend(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        base = self.c[symbol] - self.begin[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, text: np.ndarray, end: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Matching statistics of ``text``: for each place in ``end`` the length of the longest run of symbols
        that ends there, starts at ``first`` or later, and stands in a document smaller than ``before``."""
        out = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        s = text[end]
        lo, hi = self.c[s], self.c[s + 1]
        while len(live):
            on = np.flatnonzero((lo < hi) & self.documents.any_below(lo, hi, before[live]))
            live, lo, hi = live[on], lo[on], hi[on]
            out[live] += 1
            at = end[live] - out[live]
            more = at >= first[live]
            live, lo, hi, at = live[more], lo[more], hi[more], at[more]
            lo, hi = self.extend(text[at], lo, hi)
        return out


def earlier_matches(symbols: np.ndarray, size: np.ndarray, document: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, first, last)``: the words of segments that lie under matches of ``width`` or more words with
    smaller documents.  ``symbols`` (from 1) of all segments follow each other, ``size[i]`` of them in segment i."""
    n = len(size)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if n else size
    text = np.zeros(int(size.sum()) + n, np.int64)
    text[ranges(begin, size)] = symbols
    of = np.repeat(np.arange(n), size + 1)
    index = FMIndex(text, document[of])
    ends = ranges(begin + width - 1, np.maximum(size - width + 1, 0))
    seg = of[ends]
    length = index.matching(text, ends, begin[seg], document[seg])
    hit = length >= width
    e, s, m = ends[hit], seg[hit], length[hit]
    if not len(e):
        return s, e, e
    # matches of neighbouring ends overlap: one interval from the first one's start to the last one's end
    new = np.concatenate(([True], (e[1:] != e[:-1] + 1) | (s[1:] != s[:-1])))
    up = np.flatnonzero(new)
    down = np.concatenate((up[1:] - 1, [len(e) - 1]))
    return s[up], e[up] - m[up] + 1 - begin[s[up]], e[down] - begin[s[up]]


# -- anchors and segments ----------------------------------------------------


def anchor_runs(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, text) of the runs of windows with one anchor; a window is named by its first word."""
    m = width - ANCHOR + 1  # runs of ANCHOR words in a window
    if not 1 <= m <= 16:
        raise ValueError(f"width must be {ANCHOR} to {ANCHOR + 15}")
    g = grams(w.hashes(), ANCHOR)
    # the place of a run, modulo 16, in the lowest bits of its hash
    low = (g & ~U(15)) | (np.arange(len(g), dtype=np.uint64) & U(15))
    k = 1
    while 2 * k <= m:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if k < m:
        low = np.minimum(low[: k - m], low[m - k :])
    windows = np.maximum(w.count() - width + 1, 0)
    at = ranges(w.first[:-1], windows)
    v = low[at]
    place = at + (((v & U(15)).astype(np.int64) - at) & 15)
    up = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), place[1:] != place[:-1])))
    return at[up], np.diff(np.append(up, len(at))), (v[up] & ~U(15)).view(np.int64), np.searchsorted(w.first, at[up], "right") - 1


def _emit_anchors(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                _, _, key, doc = anchor_runs(Words(*text_bytes(batch.column("text"))), width)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                up = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
                runs = np.diff(np.append(up, len(key)))
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key[up]), pa.array(ids[doc[up]]), pa.array(runs)], ["anchor", "id", "runs"])

    return f


def _of_text(column: pa.Array) -> np.ndarray:
    """(text, value) pairs of a column of lists, as one number each."""
    off = np.asarray(column.offsets)
    flat = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    return _pair(np.repeat(np.arange(len(column)), np.diff(off)), flat)


def _pair(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(value.view(np.uint64) ^ mix(text.astype(np.uint64) + U(1)))


def _emit_segments(width: int):
    names = ["route", "id", "th", "start", "windows", "seg"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big, limit=256 << 10):
                raw, off = text_bytes(batch.column("text"))
                w = Words(raw, off)
                first, n, key, doc = anchor_runs(w, width)
                own = _pair(doc, key)
                cold, hot = (np.isin(own, _of_text(batch.column(c))) for c in ("cold", "hot"))
                single = ranges(first[hot], n[hot])
                each = grams(w.hashes(), width)[single].view(np.int64)
                first, key = np.concatenate((first[cold], single)), np.concatenate((key[cold], each))
                doc = np.concatenate((doc[cold], np.repeat(doc[hot], n[hot])))
                n = np.concatenate((n[cold], np.ones(len(single), np.int64)))
                place = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))  # of words in the spaced text
                segs = slices(spaced(raw, off), place[first], place[first + n + width - 1] - 1)
                ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
                cols = [pa.array(x) for x in (key, ids[doc], ths[doc], (first - w.first[doc]).astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, segs], names)

    return f


def _search_shard(width: int):
    def f(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("least")
        words = pc.split_pattern(shard["seg"].combine_chunks(), " ")
        symbols = pc.dictionary_encode(words.flatten()).indices.to_numpy().astype(np.int64) + 1
        least = shard["least"].to_numpy()
        seg, first, last = earlier_matches(symbols, pc.list_value_length(words).to_numpy().astype(np.int64), np.unique(least, return_inverse=True)[1], width)
        n = np.bincount(seg, minlength=len(least))
        off = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])
        out = shard.select(["k1", "k2", "least", "n"]).append_column("spans", pa.ListArray.from_arrays(off, spans))
        return out.filter(pa.array((n > 0) | (least < shard["most"].to_numpy())))

    return f


# -- the operator ------------------------------------------------------------


def shared_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, th, spans``: per document (``docs`` has id, th, text) the words under its windows that also
    start in a document with a smaller id, as (first, last) runs that may overlap.

    ``spans`` is an array of structs; documents without such windows have no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.filter("id is not null")
    anchors = table(own.select("id", "text").mapInArrow(_emit_anchors(width), "anchor long, id long, runs long"))
    ends = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.sum("runs").alias("runs"))
    ends = table(ends.filter("lo < hi").select("anchor", (F.col("runs") > HOT_RUNS).alias("many"), "n"))
    found = join_counted(anchors.select("anchor", "id"), ends, ["anchor"], "n")
    by_doc = table(
        found.groupBy("id").agg(
            F.collect_set(F.when(~F.col("many"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("hot")
        )
    )
    drop(spark, anchors, ends)
    segments = own.join(by_doc, "id").mapInArrow(_emit_segments(width), "route long, id long, th long, start int, windows int, seg string")
    segments = table(segments)
    drop(spark, by_doc)
    one = table(segments.groupBy("route", "seg").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")))
    words = one.agg(F.sum(F.length("seg") - F.length(F.translate("seg", " ", "")) + 1)).first()[0] or 0
    keys = {"k1": F.xxhash64("seg"), "k2": F.xxhash64(F.lit("b"), "seg")}  # made on reading: hashes do not compress
    shard = F.pmod(F.xxhash64("route"), F.lit(int(words // SHARD_WORDS) + 1))
    answers = one.withColumns(keys | {"shard": shard}).select("shard", "seg", "least", "most", "n", "k1", "k2").groupBy("shard")
    answers = table(answers.applyInArrow(_search_shard(width), "k1 long, k2 long, least long, n long, spans array<struct<first:int,last:int>>"))
    drop(spark, one)
    hits = join_counted(segments.withColumns(keys).select("k1", "k2", "id", "th", "start", "windows"), answers, ["k1", "k2"], "n")
    whole = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("windows") + width - 2).alias("last")))
    part = F.transform("spans", lambda s: F.struct((F.col("start") + s["first"]).alias("first"), (F.col("start") + s["last"]).alias("last")))
    hits = hits.select("id", "th", F.when(F.col("id") > F.col("least"), whole).otherwise(part).alias("spans")).filter(F.size("spans") > 0)
    spans = table(hits.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    drop(spark, segments, answers)
    return spans


def _kept_runs(n: int, spans) -> tuple[int, list[tuple[int, int]]]:
    """(removed words, runs of kept words) of a text of ``n`` words."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[s["last"] + 1] -= 1
    gone = np.cumsum(edge[:n]) > 0
    x = np.diff(np.concatenate(([0], (~gone).view(np.int8), [0])))
    return int(gone.sum()), list(zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True))


def _emit_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in steps(big):
            raw, off = text_bytes(batch.column("text"))
            w, spans = Words(raw, off), batch.column("spans")
            place = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
            data = spaced(raw, off).tobytes()
            counts, removed, digests = w.count(), [], []
            for d, (a, n) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
                gone, runs = _kept_runs(n, spans[d].as_py()) if spans[d].is_valid else (0, [(0, n)] * (n > 0))
                removed.append(gone)
                digests.append(hashlib.sha256(b"".join(data[place[a + i] : place[a + j]] for i, j in runs)[:-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _emit_cut(text: str, n_chars: str | None, spans: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big, text):
                raw, off = text_bytes(batch.column(text))
                w, data, got, old = Words(raw, off), raw.tobytes(), batch.column(spans), batch.column(text)
                texts = []
                for d in range(batch.num_rows):
                    if not got[d].is_valid:
                        texts.append(old[d].as_py())
                        continue
                    _, runs = _kept_runs(int(w.first[d + 1] - w.first[d]), got[d].as_py())
                    st, en = w.start[w.first[d] :], w.end[w.first[d] :]
                    texts.append(b"\n".join(data[st[i] : en[j - 1]] for i, j in runs).decode())
                new = {text: pa.array(texts, pa.string())}
                if n_chars:
                    new[n_chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                names = [n for n in batch.schema.names if n != spans]
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return f


def _keyed(doc_id: str, text: str):
    return F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text")


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    docs = df.select(*_keyed(doc_id, text))
    out = docs.join(shared_windows(docs, width), ["id", "th"], "left").select("id", "text", "spans")
    return out.mapInArrow(_emit_kept, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", doc_id)


def cut_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """``df`` with repeated words cut out of its texts: runs of kept words as they stood, one line each.
    Texts without any stay as they are.  ``n_chars`` (a long column) follows the text.  Columns of ``df`` may
    have any names."""
    i, th, spans = (free_name(df, c) for c in ("id", "th", "spans"))
    found = shared_windows(df.select(*_keyed(doc_id, text)), width).select(F.col("id").alias(i), F.col("th").alias(th), F.col("spans").alias(spans))
    a, b, _ = _keyed(doc_id, text)
    rows = df.join(found, (a == F.col(i)) & (b == F.col(th)), "left").drop(i, th)
    return rows.mapInArrow(_emit_cut(text, n_chars, spans), df.schema)
