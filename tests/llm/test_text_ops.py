"""op1, op3, op4, op5 against brute force, libraries or held-out labels, and their edge cases."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, language_id, license_scans
from tidemark.llm.queries import QUERIES, tokenizer_path

# -- op3 --


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizer_path()), special_tokens={})


def digests(tik, text):
    ids = tik.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query(spark, sf, tik):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {d["doc_id"]: digests(tik, d["text"]) for d in docs}


def test_bpe_odd_texts(docs_of, tik, edges):
    rng = random.Random(1)
    stock = [*"abst'rvelmd  \n\t\r\u00a0\u3000 12½é中ß.,!''#S'RE", "'s", "'ll", "'re", " '", "😀", "\u0301", "the", " of", "\u0085", "\x1c", "\u200b", "<|endoftext|>"]
    rows = [(100 + k, "".join(rng.choices(stock, k=rng.choice([1, 2, 3, 5, 20, 80])))) for k in range(300)]
    rows += [*edges, (7, "a" * 5000), (8, " " * 3000), (9, "#" * 999 + "'s"), (10, "ab" * 40_000)]
    got = byte_bpe.byte_bpe(docs_of(rows), tokenizer_path()).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *digests(tik, t))) for i, t in rows)


def test_bpe_round_trip_and_offsets(docs_of, edges):
    rows = [*edges, (9, "It's  a test — ünïcode 😀\n\n end ")]
    out = byte_bpe.byte_bpe(docs_of(rows), tokenizer_path(), extra=("ids", "offsets", "decoded")).collect()
    texts = sorted((repr(i), t or "") for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["decoded"]) for r in out) == texts
    for r in out:
        assert len(r["offsets"]) == len(r["ids"]) + 1 and r["offsets"][-1] == len(r["decoded"].encode())
    assert byte_bpe.byte_bpe(docs_of(rows).limit(0), tokenizer_path()).count() == 0


# -- op1 --

LOW, HIGH = "abcdefghijklmnopqrstuvwxyzéñ", "ABCDEFGHIJKLMNOPQRSTUVWXYZÉÑ"
UP, DOWN = str.maketrans(LOW, HIGH), str.maketrans(HIGH, LOW)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def bench_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contaminated_documents(spark, docs_of, words, edges):
    items = [(k, " ".join(words(12 + 3 * k, 500 + k)).capitalize() + ".") for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    rng, rows = random.Random(2), list(edges)
    for k in range(80):
        w = items[k % 12][1].split()
        bound = int(0.2 * len(w) + 1e-9)
        for _ in range(rng.randint(0, bound)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((100 + k, " ".join(words(30, 1000 + k) + [x.translate(UP) + "!!" if k % 3 else x for x in w] + words(20, 2000 + k))))
    rows += [(400, items[0][1]), (401, " ".join(words(20_000, 5))), (402, " ".join(words(9_000, 6)) + " " + items[3][1])]
    hits = decontamination.contaminated(docs_of(rows), bench_frame(spark, items)).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in hits}
    norm = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in t.translate(DOWN).split()) if w]
    want = {}
    for i, t in rows:
        w = norm(t or "")
        for item, it in items[:12]:
            v = norm(it)
            # only windows that share half of the words can be near
            near = [s for s in range(len(w) - len(v) + 1) if len(set(w[s : s + len(v)]) & set(v)) * 2 >= len(set(v))]
            best = min((brute_distance(w[s : s + len(v)], v) for s in near), default=10**9)
            if best <= int(0.2 * len(v) + 1e-9):
                want[i, item] = best
    found = sum(got.get(k) == d for k, d in want.items())
    assert set(got) <= set(want) and found >= 0.97 * len(want) and len(want) >= 80
    assert all(got[k] == 0 for k in want if want[k] == 0 and k in got) and all(k in got for k in want if want[k] == 0)
    t = dict(r for r in rows if r[0] is not None)
    exact = next(r for r in hits if r["doc_id"] == 402)
    assert t[402].encode()[exact["start_byte"] : exact["end_byte"]].decode() + "." == items[3][1]
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs_of(rows), bench_frame(spark, items)).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}


def test_contaminated_by_dropped_and_inserted_words(spark, docs_of, words):
    items = [(k, " ".join(words(n, 700 + k))) for k, n in enumerate([15, 16, 25, 31, 40, 59] * 10)]
    rng, rows, edits = random.Random(4), [], {}
    for k, (_, t) in enumerate(items):
        w, bound = t.split(), int(0.2 * len(t.split()) + 1e-9)
        edits[k] = 1 if k % 12 == 0 else bound
        for _ in range(edits[k]):
            if k % 2 == 0:
                del w[rng.randrange(len(w))]
            else:
                w.insert(rng.randrange(1, len(w)), f"new{rng.random()}")
        lead, tail = (words(30, 3000 + k) if k // 2 % 2 else []), (words(20, 4000 + k) if k // 4 % 2 else [])
        rows.append((k, " ".join(lead + w + tail)))
    rows += [(500 + k, " ".join(w[: int(0.8 * len(w)) - 1])) for k, w in enumerate(t.split() for _, t in items)]  # too short
    hits = decontamination.contaminated(docs_of(rows), bench_frame(spark, items)).collect()
    assert all(r["doc_id"] == r["item_id"] for r in hits) and len({r["doc_id"] for r in hits}) >= 0.97 * len(items)
    text, item = dict(rows), dict(items)
    for r in hits:
        got = text[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().split()
        assert len(got) == r["n_words"] and brute_distance(got, item[r["item_id"]].split()) == r["distance"] <= edits[r["doc_id"]]
    # an item less one word is a text of its own
    assert {r["doc_id"]: r["distance"] for r in hits}[0] == 1


def test_short_items_null_ids_blocks_and_ties(spark, docs_of, words, monkeypatch):
    """Items of any length and without an id; blocks one after the other; equal items and passages."""
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (None, " ".join(words(20, 1))), (5, " ".join(words(30, 2))), (6, " ".join(words(30, 2))), (7, " ".join(words(1200, 3)))]
    near = words(30, 2)
    near[7] = "changed"
    rows = [(1, "x Alpha, y"), (2, "beta. gamma!"), (3, "gamma beta"), (4, "zero one two three four five"), (5, "a " + items[3][1] + " b"), (6, " ".join(near) + " mid " + " ".join(near)), (7, "z " + items[6][1]), (8, "one two three"), (None, "alpha")]
    want = {(1, 1, 0), (None, 1, 0), (2, 2, 0), (4, 3, 0), (5, None, 0), (6, 5, 1), (6, 6, 1), (7, 7, 0)}
    for size in (decontamination.BLOCK_WORDS, 60):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", size)
        hits = decontamination.contaminated(docs_of(rows), bench_frame(spark, items)).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in hits} == want and len(hits) == len(want)
        assert {r["start_byte"] for r in hits if r["doc_id"] == 6} == {0}
        assert {r["doc_id"] for r in decontamination.decontaminate(docs_of(rows), bench_frame(spark, items)).collect()} == {3, 8}
    none = bench_frame(spark, items).limit(0)
    assert decontamination.contaminated(docs_of(rows), none).count() == 0 and decontamination.decontaminate(docs_of(rows), none).count() == len(rows)
    assert decontamination.decontaminate(docs_of(rows).limit(0), bench_frame(spark, items)).count() == 0


def test_best_passages(words):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(5))
    a, b = rng.integers(1, 4, (60, 8)).astype(np.uint64), rng.integers(1, 4, (60, 12)).astype(np.uint64)
    n, size = rng.integers(3, 9, 60), rng.integers(2, 13, 60)
    for r, (d, s, e) in enumerate(zip(*decontamination.best_passages(a, b, n, size), strict=True)):
        x, y = a[r, : n[r]].tolist(), b[r, : size[r]].tolist()
        every = [(brute_distance(x, y[i:j]), i, abs(j - i - len(x))) for i in range(len(y) + 1) for j in range(i, len(y) + 1)]
        assert (d, s, abs(e - s - n[r])) == min(every) and e <= size[r]


def test_decontamination_empty(spark, docs_of):
    d, b = docs_of([(1, "a b c d e f g")]), bench_frame(spark, [(1, "a b c d e f g")])
    assert decontamination.contaminated(d.limit(0), b).count() == 0
    assert decontamination.contaminated(d, b.limit(0)).count() == 0
    assert decontamination.contaminated(d, b).count() == 1


def test_benchmark_in_blocks(spark, docs_of, words, monkeypatch):
    items = [(k, " ".join(words(15, k))) for k in range(8)]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 40)
    got = decontamination.contaminated(docs_of([(k, t) for k, t in items]), bench_frame(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(k, k, 0) for k in range(8)]


# -- op4 --


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, d).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edges):
    rows = [(i, t, "xx" if k % 2 else None) for k, (i, t) in enumerate(edges)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 4):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[5]["lang_pred"] in ("xx", "und")
    assert language_id.language_id(df.limit(0)).count() == 0
    unlabelled = df.select("doc_id", "text", df["lang"].substr(9, 1).alias("lang")).filter("false or lang is null")
    assert {r["lang_pred"] for r in language_id.language_id(unlabelled).collect()} == {"und"}


def test_language_ignores_labels(spark, words):
    a = [(i, " ".join(f"{w}ung der" for w in words(30, i)), "de") for i in range(40)]
    b = [(100 + i, " ".join(f"{w}tion the" for w in words(30, 100 + i)), "en") for i in range(40)]
    df = spark.createDataFrame(a + b, "doc_id long, text string, lang string")
    m = language_id.train(df)
    wrong = df.withColumn("lang", df["lang"].substr(9, 1))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(wrong, m).collect()} == {i: y for i, _, y in a + b}
    assert m.predict("x " * 10) == m.predict("x " * 10)


# -- op5 --


def test_license_scan(spark, sf, docs_of, words, edges):
    names = dict(license_scans.TEMPLATES)
    rows = [*edges, (50, " ".join(words(40, 1)) + "\nReleased under the MIT\nlicense.\n" + " ".join(words(40, 2)))]
    gpl = names["GPL-3.0"].split()
    rows += [(51, " ".join([*gpl[:11], "4."])), (52, " ".join([*gpl[:6], "a", "b", "c", *gpl[9:]])), (53, "licensed under apache"), (54, " ".join(words(20_000, 3)))]
    got = {(r["doc_id"], r["license"]): r for r in license_scans.license_scan(docs_of(rows)).collect()}
    assert set(got) == {(50, "MIT"), (51, "GPL-3.0")}
    t = dict(rows)[50].encode()
    assert t[got[50, "MIT"]["start_byte"] : got[50, "MIT"]["end_byte"]].decode().split() == ["Released", "under", "the", "MIT", "license"]
    assert got[50, "MIT"]["containment"] == 1 and 0.8 <= got[51, "GPL-3.0"]["containment"] < 1
    assert license_scans.license_scan(docs_of(rows).limit(0)).count() == 0


def test_license_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def shingles(t):
        w = [x for x in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for y in t.split()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = set()
    for d in docs:
        s = shingles(d["text"])
        for name, text in license_scans.TEMPLATES:
            v = set(shingles(text))
            n = len(shingles(text))
            if v & set(s) and any(len(v & set(s[i : i + n])) >= 0.8 * len(v) for i in range(len(s) - n + 1)):
                want.add((d["doc_id"], name))
    assert {(r["doc_id"], r["license"]) for r in QUERIES["op5_license_scans"](spark, sf).collect()} == want


def plain_ftrl(samples, languages, size, epochs, order):
    """Follow the regularised leader, coordinate by coordinate."""
    import math

    z = [[0.0] * len(languages) for _ in range(size)]
    n = [[0.0] * len(languages) for _ in range(size)]

    def w(i, k):
        if abs(z[i][k]) <= language_id.L1:
            return 0.0
        return -(z[i][k] - math.copysign(language_id.L1, z[i][k])) / ((language_id.BETA + math.sqrt(n[i][k])) / language_id.ALPHA + language_id.L2)

    for _ in range(epochs):
        for s in order(len(samples)):
            x, y = samples[s]
            scores = [sum(v * w(i, k) for i, v in x) for k in range(len(languages))]
            top = max(scores)
            e = [math.exp(v - top) for v in scores]
            old = {(i, k): w(i, k) for i, _ in x for k in range(len(languages))}
            for i, v in x:
                for k in range(len(languages)):
                    g = v * (e[k] / sum(e) - (k == y))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language_id.ALPHA
                    z[i][k] += g - sigma * old[i, k]
                    n[i][k] += g * g
    return [[w(i, k) for k in range(len(languages))] for i in range(size)]


def test_training_step_and_calibration_against_plain_code():
    import math

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(9))
    idf = 1 + rng.random(12)
    samples = []
    for i in range(60):
        y = "abc"[i % 3]
        at = np.unique(np.concatenate((rng.integers(0, 12, 3), [4 * "abc".index(y)] if i % 7 else [11])))
        samples.append((at, rng.integers(1, 4, len(at)), y, i % 5 == 0))
    model = language_id.fit(samples, idf)
    rows = []
    for at, c, y, out in samples:
        v = [(1 + math.log(k)) * idf[i] for i, k in zip(at, c, strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append(([*[(int(i), x / norm) for i, x in zip(at, v, strict=True)], (12, 1.0)], "abc".index(y), out))
    perm = np.random.Generator(np.random.PCG64(1))
    want = plain_ftrl([(x, y) for x, y, out in rows if not out], "abc", 13, language_id.EPOCHS, lambda m: perm.permutation(m).tolist())
    assert np.allclose(model.weights, want, atol=1e-9) and (model.weights == 0).any()

    def loss(t):
        total = 0.0
        for x, y, out in rows:
            if out:
                s = [sum(v * want[i][k] for i, v in x) / t for k in range(3)]
                total += math.log(sum(math.exp(v) for v in s)) - s[y]
        return total

    fine = min((loss(t), t) for t in np.exp(np.linspace(math.log(0.05), math.log(20), 2000)))
    assert loss(model.temperature) <= fine[0] * 1.001 + 1e-6 and loss(model.temperature) <= loss(1.0)


def test_language_stage_edges(spark, docs_of, edges, words):
    """Without labels only texts without letters go; ties, repeated rows, very long texts and any column names are fine."""
    rows = [*edges, (20, " ".join(words(60_000, 1))), (21, "same"), (21, "same")]
    none = spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, h string, f int")
    kept = sorted(map(repr, (r["doc_id"] for r in language_id.keep_identified(none).collect())))
    assert kept == sorted(map(repr, [i for i, t in rows if t and any(c.isalpha() for c in t)]))
    assert language_id.keep_identified(none.limit(0)).count() == 0
    one = none.withColumn("lang", F.lit("en"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(one).collect()} == {("en", 1.0), ("und", 0.0)}
