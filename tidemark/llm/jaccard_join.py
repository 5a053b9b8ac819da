"""Jaccard self-join of documents on word n-gram sets, by grouped prefixes.

Two documents link when ``100 * |A & B| >= percent * |A | B|``; the result gives each
document the smallest id that it reaches over links.

1. Shingles that are frequent in the corpus are counted over all documents (each step
   of some hundred thousand shingles reports those it holds twice); the most frequent, at most
   ``HOT_TABLE``, are broadcast.  They only order shingles: rare ones first, so that
   prefixes avoid shared passages.  Any order gives the same links.
2. Equal sets collapse to their smallest id.  Sets of equal size and prefix collapse to
   a group; only groups are indexed.
3. Groups that share a prefix shingle are paired where no more than ``LIST_ROWS`` share
   it, and kept if sizes and the number of common prefix shingles allow the threshold.
   Longer lists are not paired here: their groups are tied to the list's smallest, which
   only brings them into one block.
4. Pairs and ties say which groups must meet.  Their members' whole sets are gathered in
   blocks of bounded size.  A block orders shingles by its own frequencies, groups its sets by
   prefix, filters the pairs of groups, expands them to members and verifies these exactly;
   members that verified links connect already are not compared again.
5. What does not fit one block is dealt to parts.  Each part is verified alone and with the
   smallest document of all; documents that this leaves outside the largest component
   are then verified against every part.  Copies of one text, however many, are linked
   in the first of these rounds and shipped once.

Defined results
---------------
* null or empty text, or white space only: 0 shingles, linked with nothing.
* fewer than ``words`` words: the whole sequence is the one shingle.
* repeated rows: each is returned; rows with one id are one node, linked by the text of each.
  A null id gets a null component and links nothing.
* very long texts: whole; a set is shipped once per block it is compared in.
* shingles are told apart by 64-bit hashes.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, free_name, join_counted, scope, table
from .textops import LOWER, U, Words, grams, mix, ranges, small_batches, steps, text_bytes

WORDS, PERCENT = 5, 80
#: Shingles counted at once; those met twice among them are reported.
COUNT_STEP = 1 << 20
#: Reported occurrences from which a shingle counts as frequent, and how many of these are kept (12 bytes each).
HOT_COUNT, HOT_TABLE = 32, 1 << 18
#: Groups on one prefix shingle up to which they are paired.
LIST_ROWS = 256
#: Documents and shingles of a part; a block holds one or two.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 200_000


def shingle_sets(batch: pa.RecordBatch, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch, A-Z lower-cased."""
    raw, off = text_bytes(batch.column("text"))
    w = Words(LOWER[raw], off)
    h = w.hashes()
    g = grams(h, words)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a) ^ U(0xA5A5A5A5A5A5A5A5))
        else:
            out.append(h[:0])
    return out


def _frequent(words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True)
            x, c = x[c > 1], c[c > 1]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c)], ["s", "n"])

        for big in batches:
            for batch in steps(big):
                sets = shingle_sets(batch, words)
                held += sets
                n += sum(map(len, sets))
                if n >= COUNT_STEP:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return f


def _describe(words: int, percent: int, hot):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = hot.value
        filt = np.zeros(1 << 22, bool)
        filt[(names >> U(42)).astype(np.int64)] = True
        for big in batches:
            for batch in steps(big):
                cols: list[list] = [[] for _ in range(5)]
                flat, size = [], []
                for s in shingle_sets(batch, words):
                    n = len(s)
                    p = n + (-percent * n) // 100 + 1 if n else 0  # n - ceil(n * percent / 100) + 1
                    maybe = np.flatnonzero(filt[(s >> U(42)).astype(np.int64)]) if len(names) else []
                    if len(maybe):
                        at = np.minimum(np.searchsorted(names, s[maybe]), len(names) - 1)
                        real = names[at] == s[maybe]
                        maybe, at = maybe[real], at[real]
                        cold = np.delete(s, maybe)
                        pre = cold[:p] if len(cold) >= p else np.concatenate((cold, s[maybe][np.argsort(counts[at], kind="stable")]))[:p]
                    else:
                        pre = s[:p]
                    with np.errstate(over="ignore"):
                        x = mix(s ^ U(0x5BD1E9955BD1E995))
                        cols[0].append(n)
                        cols[1].append(int(np.bitwise_xor.reduce(x).view(np.int64)) if n else 0)
                        cols[2].append(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                        y = mix(pre * U(3) + np.arange(p, dtype=np.uint64))
                        cols[3].append(int(np.bitwise_xor.reduce(y).view(np.int64)) if p else 0)
                        cols[4].append(int(mix(y).sum(dtype=np.uint64).view(np.int64)) if p else 0)
                    flat.append(pre.view(np.int64))
                    size.append(p)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in cols], prefix], ["id", "n", "s1", "s2", "g1", "g2", "prefix"])

    return f


def _gather(words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in steps(big):
                sets = [s.tobytes() for s in shingle_sets(batch, words)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "s"])

    return f


class _Sets:
    """Some shingle sets by number: ``token[first[i]:first[i+1]]`` are those of set i, rarest first."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        m = self.m = len(sets)
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        owner = np.repeat(np.arange(m), self.size)
        _, token, df = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        token, self.df = rank[token], np.sort(df, kind="stable")
        self.token = token[np.lexsort((token, owner))].astype(np.int32)
        order = np.argsort(self.token, kind="stable")
        self.post, self.begin = owner[order].astype(np.int32), np.concatenate(([0], np.cumsum(self.df)))
        # groups of equal size and prefix
        self.prefix = np.where(self.size > 0, self.size + (-percent * self.size) // 100 + 1, 0)
        number: dict[tuple, int] = {}
        heads: list[int] = []
        self.group = np.empty(m, np.int64)
        for i in range(m):
            key = (int(self.size[i]), self.token[self.first[i] : self.first[i] + self.prefix[i]].tobytes())
            if (g := number.setdefault(key, len(number))) == len(heads):
                heads.append(i)
            self.group[i] = g
        self.heads = np.array(heads, np.int64)
        self.members = np.argsort(self.group, kind="stable")
        self.of = np.searchsorted(self.group[self.members], np.arange(len(heads) + 1))
        # the index: groups by prefix token
        n = self.prefix[self.heads]
        flat = self.token[ranges(self.first[self.heads], n)]
        by = np.argsort(flat, kind="stable")
        self.listed = np.repeat(np.arange(len(heads)), n)[by]
        self.lists = np.searchsorted(flat[by], np.arange(len(self.df) + 1))

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.first[i] : self.first[i + 1]]

    def fits(self, common: np.ndarray, a, b) -> np.ndarray:
        return (common > 0) & ((100 + self.percent) * common >= self.percent * (a + b))

    def reach(self, i: int) -> int:
        """Entries of the lists on the prefix of set i."""
        t = self.token[self.first[i] : self.first[i] + self.prefix[i]]
        return int((self.lists[t + 1] - self.lists[t]).sum())

    def partners(self, i: int) -> np.ndarray:
        """Members of the groups that pass the filters with the group of set i."""
        t = self.token[self.first[i] : self.first[i] + self.prefix[i]]
        g, common = np.unique(self.listed[ranges(self.lists[t], self.lists[t + 1] - self.lists[t])], return_counts=True)
        h = self.heads[g]
        n, m, p, q = self.size[i], self.size[h], self.prefix[i], self.prefix[h]
        # common shingles lie in both prefixes or behind the prefix that ends first
        g = g[(self.percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & self.fits(common + np.maximum(n - p, m - q), n, m)]
        return self.members[ranges(self.of[g], self.of[g + 1] - self.of[g])]

    def verify(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that set i links with."""
        mark = np.zeros(len(self.df), bool)
        mark[self.tokens(i)] = True
        n = self.size[others]
        hit = mark[self.token[ranges(self.first[others], n)]]
        total = np.concatenate(([0], np.cumsum(hit)))
        end = np.cumsum(n)
        return others[self.fits(total[end] - total[end - n], self.size[i], n)]

    def common(self, rows: np.ndarray) -> np.ndarray:
        """Common shingles of some sets with all sets: tokens that many sets have by a matrix
        product, the others by their lists."""
        out = np.zeros((len(rows), self.m), np.float32)
        rare = int(np.searchsorted(self.df, max(2, self.m // 32)))
        width = max(1, (8 << 20) // (4 * self.m))
        for a in range(rare, len(self.df), width):
            b = min(a + width, len(self.df))
            tile = np.zeros((self.m, b - a), np.float32)
            at = slice(self.begin[a], self.begin[b])
            tile[self.post[at], np.repeat(np.arange(b - a), self.df[a:b])] = 1
            out += tile[rows] @ tile.T
        flat = out.ravel()
        for k, i in enumerate(rows.tolist()):
            t = self.tokens(i)
            t = t[(t < rare) & (self.df[t] > 1)]
            np.add.at(flat, k * self.m + self.post[ranges(self.begin[t], self.df[t])].astype(np.int64), 1)
        return out


def verified_components(sets: list[np.ndarray], percent: int = PERCENT, label: np.ndarray | None = None, look: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest place that it reaches over links, exactly.

    ``label``: sets of equal label count as connected already.  ``look``: only links of these sets
    are looked for.  Without it all are, and sets of the largest component need no look
    once all others have had one."""
    m = len(sets)
    lab = np.arange(m) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    if m < 2:
        return lab
    s = _Sets(sets, percent)
    open_ = np.zeros(m, bool)
    open_[np.arange(m) if look is None else look] = True
    open_ &= s.size > 0
    most, chunk = max(1, (2 << 20) // m), 1

    def link(i: int, ys: np.ndarray) -> None:
        roots = np.unique(lab[ys])
        if len(roots) > 1 or (len(roots) and roots[0] != lab[i]):
            roots = np.append(roots, lab[i])
            lab[np.isin(lab, roots)] = roots.min()

    while True:
        wait = np.flatnonzero(open_ if look is not None else open_ & (lab != np.bincount(lab, minlength=m).argmax()))[:chunk]
        if not len(wait):
            return lab
        open_[wait] = False
        wide = np.array([s.reach(i) > 2 * m + 1000 for i in wait.tolist()])
        for i in wait[~wide].tolist():
            near = s.partners(i)
            link(i, s.verify(i, near[lab[near] != lab[i]]))
        if wide.any():  # many partners: all common counts at once
            rows = wait[wide]
            hit = s.fits(c := s.common(rows), s.size[rows][:, None], s.size[None, :])
            del c
            for i, row in zip(rows.tolist(), hit, strict=True):
                link(i, np.flatnonzero(row))
        chunk = min(most, chunk * 4)


def _verify(percent: int):
    def f(block: pa.Table) -> pa.Table:
        rows = {}
        for i, x, again, s in zip(*(block[c].to_pylist() for c in ("id", "label", "look", "s")), strict=True):
            rows[i, s] = (x, again or rows.get((i, s), (0, False))[1])
        keys = sorted(rows)
        ids, label = np.array([i for i, _ in keys], np.int64), np.array([rows[k][0] for k in keys], np.int64)
        again = np.flatnonzero([rows[k][1] for k in keys])
        root = verified_components([np.frombuffer(s, np.uint64) for _, s in keys], percent, label, again if len(again) else None)
        link = ids[root] != ids
        return pa.table({"u": ids[link], "v": ids[root[link]]})

    return f


def _linked(sets: DataFrame, where: DataFrame, percent: int) -> DataFrame:
    """``u, v``: verified links (or paths of these) within blocks.  ``where``: id, blocks, label, look."""
    rows = sets.join(where, "id").select(F.explode("blocks").alias("block"), "id", "label", "look", "s")
    return table(rows.groupBy("block").applyInArrow(_verify(percent), "u long, v long"))


def _parts(docs: str, shingles: str):
    return F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1).cast("long"))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = df.sparkSession
    small_batches(spark)
    with scope(spark) as kept:
        docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

        top = docs.select("text").mapInArrow(_frequent(words), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_COUNT)
        top = top.orderBy(F.desc("n"), "s").limit(HOT_TABLE).toArrow()
        names = top["s"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(names)
        hot = spark.sparkContext.broadcast((names[order], top["n"].to_numpy()[order]))

        all_sets = table(docs.mapInArrow(_describe(words, percent, hot), "id long, n long, s1 long, s2 long, g1 long, g2 long, prefix array<long>"))
        known = all_sets.filter("n > 0 and id is not null")
        # equal sets: the smallest id stands for all; then sets of equal size and prefix likewise
        single = known.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "g1", "g2", "prefix")).alias("x"), F.count("*").alias("copies"))
        single = table(single.select("n", "s1", "s2", "copies", "x.*"))
        copied = single.filter("copies > 1").select("n", "s1", "s2", F.col("id").alias("v"), "copies")
        member = join_counted(known.select("id", "n", "s1", "s2"), copied, ["n", "s1", "s2"], "copies").filter("id <> v").select(F.col("id").alias("u"), "v")
        member = table(member.distinct())
        group = table(single.groupBy("n", "g1", "g2").agg(F.min(F.struct("id", "prefix")).alias("x"), F.count("*").alias("m")).select("n", "g1", "g2", "m", "x.*"))
        grouped = group.filter("m > 1").select("n", "g1", "g2", F.col("id").alias("v"), "m")
        inside = join_counted(single.select("id", "n", "g1", "g2"), grouped, ["n", "g1", "g2"], "m").filter("id <> v").select(F.col("id").alias("u"), "v")

        rows = group.select("id", "n", F.size("prefix").cast("long").alias("p"), F.posexplode("prefix").alias("pos", "s"))
        length = table(rows.groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("v")).filter("k > 1"))
        lists = table(join_counted(rows, length.withColumn("all", F.col("k")), ["s"], "all"))
        short, long_ = lists.filter(F.col("k") <= LIST_ROWS), lists.filter(F.col("k") > LIST_ROWS)
        a = short.select("s", *[F.col(c).alias(f"{c}a") for c in ("id", "n", "p", "pos")])
        b = short.select("s", *[F.col(c).alias(f"{c}b") for c in ("id", "n", "p", "pos")])
        fits = (F.col("ida") < F.col("idb")) & (percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
        # at its first common shingle a pair within the threshold has this much left on both sides
        left = (100 + percent) * F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= percent * (F.col("na") + F.col("nb"))
        # rows of one id with other texts have other sizes or prefixes: these name a group with its id
        pairs = a.join(b, "s").filter(fits).groupBy("ida", "idb", "na", "nb", "pa", "pb").agg(F.count("*").alias("o"), F.max(left).alias("left"))
        # common shingles lie in both prefixes or behind the prefix that ends first
        most = F.col("o") + F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        pairs = pairs.filter("left").filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select(F.col("ida").alias("u"), F.col("idb").alias("v"))
        ties = long_.select(F.col("id").alias("u"), "v").filter("u <> v").distinct()
        cluster = table(components(pairs.union(ties).union(inside)))
        drop(spark, lists, length)

        # members with their whole sets in blocks; small clusters many to a block
        n_of = single.groupBy("id").agg(F.max("n").alias("n"))
        sized = table(cluster.join(n_of, "id").select("id", F.col("component").alias("c"), "n"))
        shape = table(sized.groupBy("c").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).withColumn("parts", _parts("docs", "shingles")))
        total, split = shape.agg(F.sum("shingles"), F.max("parts")).first()
        packs = int((total or 0) // (BLOCK_SHINGLES // 2)) + 1
        of_part = shape.select("c", "parts", "docs")
        placed = table(join_counted(sized, of_part, ["c"], "docs").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))))
        every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        mine = F.when(F.col("id") == F.col("c"), every).otherwise(F.array("part"))
        blocks = F.when(F.col("parts") == 1, F.array(F.concat(F.lit("p"), F.pmod(F.xxhash64("c"), F.lit(packs))))).otherwise(F.transform(mine, lambda j: F.concat_ws("-", "c", j)))
        where = placed.select("id", blocks.alias("blocks"), F.col("id").alias("label"), F.lit(False).alias("look"))
        # whole texts are dealt once, by id at every size; later rounds read the members' sets
        sets = table(docs.join(placed.select("id").hint("merge"), "id").mapInArrow(_gather(words), "id long, s binary"))
        linked = _linked(sets, where, percent)
        if (split or 1) > 1:
            linked = linked.union(_across(sets, placed.filter("parts > 1"), linked, percent))
        found = components(linked.union(member))
        out = all_sets.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
        out = out.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        kept.append(out)
    return out


def _across(sets: DataFrame, placed: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links between the parts of large clusters: what is outside a cluster's largest component so far meets every part."""
    so_far = components(linked)
    now = table(placed.join(so_far, "id", "left").select("id", "c", "n", "parts", "part", F.coalesce("component", "id").alias("label")))
    held = now.groupBy("c", "label").agg(F.count("*").alias("k"))
    largest = held.groupBy("c").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("docs")).select("c", F.col("top.label").alias("top"), "docs")
    now = table(join_counted(now, table(largest), ["c"], "docs").withColumn("rest", F.col("label") != F.col("top")))
    rest = now.filter("rest").groupBy("c").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).withColumn("rests", _parts("docs", "shingles"))
    rest = table(rest.select("c", "rests"))
    # one row a large cluster, and a cluster is large from BLOCK_DOCS documents or BLOCK_SHINGLES shingles on
    now = now.join(rest, "c").withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("rests")))
    i, j = F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    as_part = F.transform(i, lambda x: F.concat_ws("-", "c", x, "part"))
    as_rest = F.transform(j, lambda y: F.concat_ws("-", "c", "mine", y))
    own = now.select("id", as_part.alias("blocks"), "label", F.lit(False).alias("look"))
    looking = now.filter("rest").select("id", as_rest.alias("blocks"), "label", F.lit(True).alias("look"))
    return _linked(sets, own.union(looking), percent)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` with one document of each component, the one with the smallest id (rows that share this id stay
    together); rows with a null id stay.  Columns of ``df`` may have any names."""
    name = free_name(df, "gone")
    with scope(df.sparkSession) as kept:
        gone = jaccard_components(df, doc_id, text, **how).filter(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias(name)).distinct()
        gone = table(gone)
        kept.append(gone)
    return df.join(gone, F.col(doc_id) == F.col(name), "left_anti")
