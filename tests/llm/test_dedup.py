"""op2 and op7 against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj
from tidemark.llm import substring_dedup as sd
from tidemark.llm.components import components
from tidemark.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_jaccard_join"])
def test_query_equals_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def brute_windows(rows, width=13):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first.get(tuple(w[j : j + width]), i) < i:
                gone |= set(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, post, parent = [], defaultdict(list), {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        if i is None:
            continue
        c = Counter(b for s in sets[a] for b in post[s])
        for s in sets[a]:
            post[s].append(a)
        for b, o in c.items():
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(i), find(rows[b][0])))
                parent[y] = x
    return sorted(repr((i, len(s), None if i is None else find(i))) for (i, _), s in zip(rows, sets, strict=True))


def corpus(words, edges):
    base, rows = words(120, 1), list(edges)
    for k in range(40):  # near copies
        w = list(base)
        for j in range(k % 9):
            w[(k * 7 + j * 13) % len(w)] = f"edit{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    passage = words(30, 2)
    for k in range(30):  # a shared passage in other texts
        rows.append((200 + k, " ".join(words(40, 50 + k)) + "\n" + " ".join(passage) + "\t" + " ".join(words(25, 90 + k))))
    rows += [(300, " ".join(base)), (301, " ".join(base).upper()), (302, " ".join(words(30_000, 3))), (303, "a b c d"), (304, "A b c d"), (305, "z " * 40)]
    return rows


def test_substring_dedup(docs_of, words, edges, monkeypatch):
    rows = corpus(words, edges)
    got = sorted(repr(tuple(r)) for r in sd.substring_dedup(docs_of(rows)).collect())
    assert got == brute_windows(rows)
    # hot anchors dealt window by window, many shards
    monkeypatch.setattr(sd, "HOT_RUNS", 3)
    monkeypatch.setattr(sd, "SHARD_WORDS", 200)
    assert sorted(repr(tuple(r)) for r in sd.substring_dedup(docs_of(rows)).collect()) == brute_windows(rows)


def test_cut_repeats(spark, words):
    p, a, b = " ".join(words(20, 1)), " ".join(words(9, 2)), " ".join(words(9, 3))
    df = spark.createDataFrame([(1, p, 0), (2, f"{a}\n{p} {b}", 0), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in sd.cut_repeats(df).collect()}
    assert got[1]["text"] == p and got[3]["text"] is None
    assert got[2]["text"] == f"{a}\n{b}" and got[2]["n_chars"] == len(f"{a}\n{b}")


def test_empty_tables(docs_of, spark):
    none = docs_of([(1, "a")]).limit(0)
    assert sd.substring_dedup(none).count() == 0
    assert jj.jaccard_components(none).count() == 0
    assert jj.keep_one(none).count() == 0


def test_matching_statistics():
    """Longest match with a smaller document at each place, of any length, and the intervals from a width on."""
    rng = np.random.Generator(np.random.PCG64(1))
    size = rng.integers(1, 25, 60)
    document = np.sort(rng.integers(0, 20, 60))
    symbols = rng.integers(1, 4, size.sum())
    parts = np.split(symbols, np.cumsum(size)[:-1])
    for i in (7, 20, 41):  # long repeats
        parts[i] = parts[i + 9] = np.concatenate((parts[i], parts[i + 5]))[:25]
    size, symbols = np.array([len(p) for p in parts]), np.concatenate(parts)

    def known(run, d):
        return any(document[k] < d and any(np.array_equal(run, p[a : a + len(run)]) for a in range(len(p) - len(run) + 1)) for k, p in enumerate(parts))

    want = [[max((n for n in range(j + 2) if n and known(p[j + 1 - n : j + 1], document[i])), default=0) for j in range(len(p))] for i, p in enumerate(parts)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    of = np.repeat(np.arange(60), size + 1)
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends = np.flatnonzero(text)
    index = sd.FMIndex(text, document[of])
    assert index.matching(text, ends, begin[of[ends]], document[of[ends]]).tolist() == [n for row in want for n in row]
    assert max(max(r) for r in want) > 13
    for width in (3, 6, 13):
        covered = {(i, k) for i, row in enumerate(want) for j, n in enumerate(row) if n >= width for k in range(j + 1 - n, j + 1)}
        seg, first, last = sd.earlier_matches(symbols, size, document, width)
        got = [(s, k) for s, a, b in zip(seg.tolist(), first.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)]
        assert set(got) == covered


def test_jaccard(docs_of, words, edges, monkeypatch):
    rows = corpus(words, edges)
    want = brute_components(rows)
    assert sorted(repr(tuple(r)) for r in jj.jaccard_components(docs_of(rows)).collect()) == want
    # long lists chained, clusters in several blocks
    monkeypatch.setattr(jj, "LIST_ROWS", 4)
    monkeypatch.setattr(jj, "BLOCK_DOCS", 8)
    assert sorted(repr(tuple(r)) for r in jj.jaccard_components(docs_of(rows)).collect()) == want


def test_keep_one(docs_of, words):
    t = " ".join(words(50, 1))
    rows = [(5, t), (3, t), (4, " ".join(words(50, 2))), (6, None), (7, None), (None, t)]
    assert sorted(map(repr, (r["doc_id"] for r in jj.keep_one(docs_of(rows)).collect()))) == sorted(map(repr, [3, 4, 6, 7, None]))


def test_verified_components_random():
    rng = np.random.Generator(np.random.PCG64(2))
    base = [rng.choice(2**60, 60, replace=False).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(6)].copy()
        s[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 2**60, 1).astype(np.uint64)
        sets.append(np.unique(s))
    sets.append(np.zeros(0, np.uint64))
    got = jj.verified_components(sets)
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    assert got.tolist() == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}


def test_join_counted_is_a_join(spark):
    """Salted and broadcast keys give what a plain join gives."""
    from pyspark.sql import functions as F

    from tidemark.llm.scratch import join_counted

    left = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 40).cast("long").alias("k"), F.col("id").alias("v"), F.lit("a").alias("s"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 3 = 1").select("k", (F.col("k") * 2).alias("w"), "n", F.lit("b").alias("t"))
    want = sorted(tuple(r) for r in left.join(right.drop("n"), "k").select("k", "v", "s", "w", "t").collect())
    for most in (2, 10, 1000):
        assert sorted(tuple(r) for r in join_counted(left, right, ["k"], "n", most).select("k", "v", "s", "w", "t").collect()) == want
    assert join_counted(left, right.limit(0), ["k"], "n").count() == 0


def test_stages_keep_columns_of_any_name(spark, words):
    """Columns named like inner ones pass through the stages."""
    p = " ".join(words(30, 1))
    names = ["id", "th", "spans", "gone", "_id", "_th", "_spans", "_gone", "block", "label"]
    rows = [(1, p, len(p), *[f"{c}1" for c in names]), (2, p, len(p), *[f"{c}2" for c in names]), (3, "x " + p, len(p) + 2, *[f"{c}3" for c in names])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    cut = {r["doc_id"]: r for r in sd.cut_repeats(df).collect()}
    assert [cut[i]["text"] for i in (1, 2, 3)] == [p, "", "x"] and cut[3]["_spans"] == "_spans3" and cut[2]["id"] == "id2"
    assert [tuple(r) for r in jj.keep_one(df).collect()] == [rows[0]]
    assert sd.cut_repeats(df).columns == df.columns and jj.keep_one(df).columns == df.columns
