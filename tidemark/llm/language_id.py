"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all training documents.  The classifier learns by
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) from at most
``PER_LANGUAGE`` documents of each language, chosen by a hash of the id; a fifth of
these is kept out of it and fits the temperature of the soft-max.  Prediction is
map-only and sees nothing but the text.

What reaches the driver: ``FEATURES`` document frequencies, counts of the ``LANGUAGES`` most frequent
labels (rarer ones are not learned) and the sparse features of at most 2 x ``SAMPLE`` documents.  The
broadcast model is FEATURES x languages floats.

Defined results
---------------
* null or empty text, or no letters: ``und``, score 0.
* no labelled training document: every document is ``und``.
* one language only: that language, score 1.
* null id: counted as the empty text for the fold, so it may be trained on.
* repeated rows: predicted alike.  Ties: the language first in the alphabet.
* very long texts: all of it counts, in steps of bounded memory for many short ones.
* filtering without any labelled document: nothing can be called unclear, so only texts without letters go.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import LETTER, class_table
from .textops import small_batches, steps, text_bytes

#: Hashed n-gram features (a power of two), n from 1 to 3.
BITS = 14
FEATURES = 1 << BITS
#: Bound of the training sample, per language.
PER_LANGUAGE = 1500
#: Bounds of the languages learned and of the whole sample, shared evenly where there are many.
LANGUAGES, SAMPLE = 500, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text's lower-cased letter n-grams; runs of other characters are one edge."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = class_table()[cp] == LETTER
    x = np.where(letter, cp, 0)
    keep = letter | np.concatenate(([True], letter[:-1]))
    x = np.concatenate(([0], x[keep], [0])).astype(np.uint32)
    found = np.zeros(FEATURES, np.int64)
    h = x * np.uint32(0x9E3779B1)
    key = x != 0
    for n in (1, 2, 3):
        # an n-gram counts if it holds a letter; n itself is part of its key
        f = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        found += np.bincount((f >> np.uint32(32 - BITS))[key], minlength=FEATURES)
        if n < 3:
            m = len(h) - 1
            h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + x[n : n + m] * np.uint32(0x297A2D39)
            key = key[:m] | (x[n : n + m] != 0)
    at = np.flatnonzero(found)
    return at, found[at]


def _texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    raw, off = text_bytes(batch.column(text))
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES + 1 (bias) x languages
    temperature: float

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[at]
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def probabilities(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        s = (self.vector(at, count) @ self.weights[at] + self.weights[-1]) / self.temperature
        e = np.exp(s - s.max())
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        at, count = ngrams(text)
        if not len(at) or not self.languages:
            return "und", 0.0
        p = self.probabilities(at, count)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(samples: list[tuple[np.ndarray, np.ndarray, str, bool]], idf: np.ndarray) -> Model:
    """A model from (features, counts, language, kept out for calibration) samples."""
    languages = sorted({s[2] for s in samples})
    model = Model(languages, idf, np.zeros((len(idf) + 1, len(languages))), 1.0)
    if len(languages) < 2:
        return model
    z = np.zeros_like(model.weights)
    n = np.zeros_like(model.weights)
    train = [(np.append(a, len(idf)), np.append(model.vector(a, c), 1.0), languages.index(y)) for a, c, y, out in samples if not out and len(a)]
    rng = np.random.Generator(np.random.PCG64(1))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            at, v, y = train[i]
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            nn = n[at]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA
            z[at] += g - sigma * w
            n[at] = nn + g * g
    model.weights = weights(np.arange(len(idf) + 1))
    kept = [(a, c, languages.index(y)) for a, c, y, out in samples if out and len(a)]
    if kept:
        s = np.array([model.vector(a, c) @ model.weights[a] + model.weights[-1] for a, c, _ in kept])
        y = np.array([k for _, _, k in kept])

        def loss(t: float) -> float:
            x = s / t
            x = x - x.max(1, keepdims=True)
            return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        model.temperature = float(grid[np.argmin([loss(t) for t in grid])])
    return model


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES + 1, np.int64)  # the last counts documents
    for big in batches:
        for batch in steps(big):
            for t in _texts(batch):
                at, _ = ngrams(t)
                df[at] += 1
                df[-1] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["f", "n"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in steps(big):
            got = [ngrams(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array([a.astype("<u4").tobytes() for a, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())],
                ["lang", "h", "at", "n"],
            )


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows of ``df`` whose ``lang`` is not null."""
    small_batches(df.sparkSession)
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"))
    df_rows = {r["f"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    docs = df_rows.pop(FEATURES, 0)
    idf = np.zeros(FEATURES)
    for f, n in df_rows.items():
        idf[f] = np.log((1 + docs) / (1 + n)) + 1
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not top:
        return fit([], idf)
    each = min(per_language, max(1, SAMPLE // len(top)))
    shares = F.create_map(*[F.lit(x) for r in top for x in (r["lang"], int(min(1.0, each / r["n"]) * ((1 << 31) - 1)))])
    chosen = F.shiftrightunsigned("h", 33) <= shares[F.col("lang")]
    got = rows.filter(chosen).mapInArrow(_sample_features, "lang string, h long, at binary, n binary").orderBy("h", "lang").limit(2 * each * len(top)).collect()
    samples = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.int64), r["lang"], r["h"] % 5 == 0) for r in got]
    return fit(samples, idf)


def _predict(shipped):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for big in batches:
            for batch in steps(big):
                p = [model.predict(t) for t in _texts(batch)]
                keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array([x for x, _ in p]), pa.array([x for _, x in p])], [*[batch.schema.names[i] for i in keep], "lang_pred", "score"])

    return f


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shipped), "k long, lang_pred string, score double").withColumnRenamed("k", doc_id)


def fold(doc_id: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def language_id(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from fold 0 and 2, predicted for all rows."""
    model = train(df.filter(fold(doc_id) != 1), text, lang, doc_id)
    return predict(df, model, doc_id, text).select(doc_id, (fold(doc_id) == 1).alias("held_out"), "lang_pred", "score")


def _keep(shipped, text: str, min_score: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for big in batches:
            for batch in steps(big, text):
                if model.languages:
                    keep = [name != "und" and score >= min_score for name, score in map(model.predict, _texts(batch, text))]
                else:
                    keep = [len(ngrams(t)[0]) > 0 for t in _texts(batch, text)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return f


def keep_identified(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.4) -> DataFrame:
    """The rows of ``df`` whose language is identified with ``min_score``; the rest have no letters or too mixed ones.
    Without labels to learn from, only texts without letters go.  Columns of ``df`` may have any names."""
    model = train(df.filter(fold(doc_id) != 1), text, lang, doc_id)
    return df.mapInArrow(_keep(df.sparkSession.sparkContext.broadcast(model), text, min_score), df.schema)
