"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector over hashed character n-grams (lower-case letters; everything else is a gap). Each
language has several centroids, found by spherical k-means; the language of the centroid with the largest cosine wins. A
text of MIN_LETTERS letters or more is rejected if its cosine is below a part of that language's floor, the quantile LOW of
the cosines of such texts in the language's own sample, so that single mislabelled or junk rows do not set it. The part
grows with the number of different n-grams: a text of few (short, or one word over and over) is far from every centroid
whatever its language, and one of many comes nearer to all. Texts with fewer letters say too little to be refused.

Document frequencies cover all training rows. The centroids are fitted on a bounded sample: about SAMPLE different texts a
language (a parameter; all where a language has fewer), those with the smallest hashes, so nothing but text and lang is used
and a text of many rows counts once. The driver sees one number for each n-gram slot, and the centroids.

A null text or one without a letter is `und`, with score 0, and rejected. Empty training data make every text `und`.
Repeated rows get equal results; equal cosines go to the language that sorts first. Other columns pass through, those named
lang_pred, score or rejected are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots that n-grams are hashed to, n-gram lengths, centroids a language, sampled rows a language, k-means rounds.
SLOTS, GRAMS, CENTROIDS, SAMPLE, ROUNDS = 4096, (1, 2, 3), 3, 1500, 8
MIN_LETTERS = 40
#: Quantile of the sample's cosines that is the floor; part of it that a text of so many different n-grams must reach, as lines between the points.
LOW, ASKED = 0.01, ((40, 0.25), (90, 0.38), (400, 0.65))
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # by language


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None, slots: int = SLOTS) -> np.ndarray | None:
    """How often each slot's n-grams occur; None for a text without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
    out = np.zeros(slots, np.float32)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            mixed = h * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            own = mixed[codes[n // 2 : len(codes) - (n - 1 - n // 2)] > 0] if n > 1 else mixed[codes > 0]
            out += np.bincount(own % np.uint32(slots), minlength=slots)
    return out


def _n_letters(text: str, enough: int = MIN_LETTERS) -> int:
    """Number of letters, counted as far as it matters."""
    n = 0
    for c in text:
        n += c.isalpha()
        if n >= enough:
            break
    return n


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows, and the number of letters of each text."""
    found = [counts(t, len(idf)) for t in texts]
    letters = np.array([0 if c is None else _n_letters(t) for t, c in zip(texts, found)], int)
    x = np.zeros((len(texts), len(idf)), np.float32)
    for k, c in enumerate(found):
        if c is not None:
            x[k] = np.log1p(c) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0), letters


def asked(x: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Part of the floor that each text must reach; 0 for those too short to be refused."""
    return np.where(letters >= MIN_LETTERS, np.interp((x > 0).sum(1), *zip(*ASKED)), 0.0)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from rows far apart."""
    first = [0]
    near = x @ x[0]
    while len(first) < min(k, len(x)):
        first.append(int(near.argmin()))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows' text and lang alone; rows with a null lang are left out."""
    train = rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.col(text), F.lit("langid")).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                c = counts(t)
                if c is not None:
                    total += c > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SLOTS), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())],
                names=["slot", "n"])

    df = {r["slot"]: r["n"] for r in train.select("text").mapInArrow(frequencies,
        "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(k, 0))) + 1 for k in range(SLOTS)], np.float32)
    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "text"], kind="stable")
        x, letters = vectors(group["text"].tolist(), idf)
        x, letters = x[letters > 0], letters[letters > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c = _k_means(x, centroids)
        near = (x @ c.T).max(1)[letters >= MIN_LETTERS]
        floor = float(np.quantile(near, LOW)) if len(near) else 0.0
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [v.astype(float).tolist() for v in c], "floor": floor})

    span = 2**24
    # the sample: texts whose hash falls into the language's part of the range
    part = train.groupBy("lang").agg(F.greatest(F.approx_count_distinct("h"), F.lit(1)).alias("n")).select("lang",
        F.least(F.lit(span), F.ceil(sample * span / F.col("n"))).alias("most"))
    drawn = train.join(F.broadcast(part), "lang").where(F.pmod("h", F.lit(span)) < F.col("most"))  # a row for each language
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = sorted(drawn.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<double>, floor double").collect(),
        key=lambda r: (r["lang"], r["centroid"]))
    if not found:
        return Model([], np.zeros(0, int), np.zeros((0, SLOTS), np.float32), idf, np.zeros(0))
    names = sorted({r["lang"] for r in found})
    floors = {r["lang"]: r["floor"] for r in found}
    return Model(names, np.array([names.index(r["lang"]) for r in found], int),
        np.array([r["centroid"] for r in found], np.float32).reshape(-1, SLOTS), idf, np.array([floors[n] for n in names]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and rejected. No shuffle."""
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in keep]
    out = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())])
    languages = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                x, letters = vectors(b.column(names.index(text)).to_pylist(), model.idf)
                has = letters > 0
                if len(model.languages):
                    cosine = x @ model.centroids.T
                    best = cosine.argmax(1)
                    score, own = cosine[np.arange(len(x)), best], model.owner[best]
                    low = score < model.floors[own] * asked(x, letters)
                else:
                    score, own, low = np.zeros(len(x)), np.zeros(len(x), int), np.ones(len(x), bool)
                    has[:] = False
                own = np.where(has, own, len(model.languages))
                cols = [pa.array(languages[own], pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0), pa.float64()),
                    pa.array(low | ~has, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[f.name for f in out.fields])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
