"""Threshold-scaled document fingerprints (all shingle hashes below a fixed part of the hash range).

A sketch of a union is the union of the sketches, whatever the sizes, so sketches merge and give containment between very
unequal documents. Shingles are five words with A-Z in lower case (a text of fewer words is one shingle). Where no hash is
below the threshold, the smallest one stands in, so that only a text without words has an empty sketch; merging applies the
same rule again. A fingerprint is the base64 text of the sorted 48-bit hashes, eight characters each.

`with_next` pairs each document with the start of the next one by doc_id without a global sort in one task: documents are
dealt by doc_id ranges, each range is sorted, and the first document of each range is also sent to the range before it. The
ranges follow from the bytes of the texts: many pieces of equal rows are measured and put together. A doc_id of many rows (a missing one, say) is dealt over several ranges
by the hash of its texts; only rows with equal doc_id and text stay together.
Nulls are empty texts; a null doc_id comes first; repeated doc_ids follow each other by the hash of their text, then by
text. With a single document the next one is the document itself. An empty table gives an empty table; other columns are
not used.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, part of the hash range that is kept, bits of a hash.
WORDS, FRACTION, BITS = 5, 1 / 4, 48
#: Bytes of text in a range of doc_ids (there are as many ranges as shuffle partitions at least), pieces that the bytes are
#: counted by for each range, pieces that one doc_id may fill, quantiles of one query.
RANGE_BYTES, PIECES, MAX_SPLIT, STEP = 512 << 20, 4, 1 << 20, 1000
#: Stands for a missing doc_id: below every long that occurs as one.
NO_DOC = -(2**63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xBF58476D1CE4E5B9)
_MORE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Masks of the first 0 to 8 bytes of a little-endian word; bytes from which a word is hashed by itself.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MORE
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a column of texts, A-Z in lower case, and the number of words of each text.

    Works on the column's UTF-8 bytes, eight at a time, without a Python object for a text or a word."""
    column = column.cast(pa.string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(at[-1] - at[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    raw = np.zeros(size + 8 * (LONG_WORD // 8 + 1), np.uint8)
    raw[:size] = _LOWER[np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    inside = ~_SPACE[raw[:size]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = at[1:] > at[:-1]
    first[at[:-1][some]] = inside[at[:-1][some]]  # a word ends with its text
    last[at[1:][some] - 1] = inside[at[1:][some] - 1]
    first = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - first
    eight = np.ndarray((size + LONG_WORD,), "<u8", raw.data, strides=(1,))  # the eight bytes from each place on
    h = mixed((length.astype(np.uint64) * _MIX) ^ (eight[first] & _FIRST[np.minimum(length, 8)]))
    live = np.flatnonzero(length > 8)
    for k in range(8, LONG_WORD, 8):
        h[live] = mixed(h[live] ^ (eight[first[live] + k] & _FIRST[np.minimum(length[live] - k, 8)]))
        live = live[length[live] > k + 8]
    for k in live:
        h[k] = xxhash.xxh64_intdigest(raw[first[k] : first[k] + length[k]])
    return h, np.diff(np.searchsorted(first, at))


def slices(column: pa.Array, rows: int = 200, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs of a column of texts with so many rows and bytes at most, but for a single text."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = min(begin + rows, int(np.searchsorted(at, int(at[begin]) + size, "right")) - 1)
        end = max(begin + 1, min(end, len(column)))
        yield begin, end - begin
        begin = end


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a column of texts: sorted distinct 64-bit hashes, one text after the other, and where each text's
    begin (and the last ones end). A text of fewer words is one shingle."""
    h, n = word_hashes(column)
    begin = np.cumsum(n) - n
    count = np.maximum(n - size, 0) + (n > 0)
    at = np.flatnonzero(np.arange(len(h)) - np.repeat(begin, n) < np.repeat(count, n))
    words = np.repeat(np.minimum(n, size), count)
    out = words.astype(np.uint64)
    short = np.flatnonzero(words < size)
    for k in range(size):  # order matters: each step mixes before the next word comes in
        new = (out ^ h[np.minimum(at + k, len(h) - 1)]) * _MIX
        new ^= new >> np.uint64(29)
        new[short] = np.where(k < words[short], new[short], out[short])
        out = new
    out *= _PRIME
    out ^= out >> np.uint64(32)
    bounds = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][count > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def keep(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of sorted 48-bit hashes: those below the threshold, or the smallest."""
    low = hashes[: np.searchsorted(hashes, np.uint64(int(fraction * 2**BITS)))]
    return low if len(low) else hashes[:1]


def sketch(text: str | None, fraction: float = FRACTION) -> np.ndarray:
    return keep(np.unique(shingles(text) >> np.uint64(64 - BITS)), fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    return keep(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of the smaller set that the other one holds (two empty ones: 1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated size of the intersection by that of the union (two empty ones: 1)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).view(">u8").reshape(-1).astype(np.uint64)


def sketches(column: pa.Array, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sketch of each text of a column."""
    h, bounds = shingle_sets(column)
    h >>= np.uint64(64 - BITS)
    return [keep(np.unique(h[a:b]), fraction) for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id and fingerprint of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(to_text, sketches(b.column(1), fraction)), pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _cuts(src: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Distinct doc_ids that cut the rows into n pieces of about as many rows, and of those that fill several how many.

    In two steps: quantiles of all rows, STEP at most, and quantiles of the rows between two of these. So no query is written out
    with more than STEP numbers; the driver gets a number for each piece, in columns."""

    def quantiles(parts: int) -> Column:
        at = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
        return F.percentile_approx("doc_id", at, max(10_000, 2 * parts))

    coarse = min(n, STEP)
    first = src.agg(quantiles(coarse)).first()[0] or []
    fine = -(-n // coarse)
    often = {c: k * fine for c, k in Counter(first).items() if k > 1}
    cuts = sorted(set(first))
    if fine > 1 and cuts:
        bounds = np.array(cuts, np.int64)
        between = F.pandas_udf(lambda i: pd.Series(np.searchsorted(bounds, i.to_numpy(np.int64), "left"), index=i.index), "long")
        found = src.groupBy(between("doc_id").alias("part")).agg(quantiles(fine).alias("at")).select("at").toArrow().column(0).combine_chunks()
        again = Counter(found.flatten().to_pylist())
        often = {c: k for c, k in again.items() if k > 1} | often
        cuts = sorted(again.keys() | set(cuts))
    return np.array(cuts, np.int64), often


def by_range(docs: DataFrame) -> DataFrame:
    """(part, role, doc_id, h, text), sorted within partitions: each range of (doc_id, h) by itself, and at its end, with
    role 1, the first document of the next range (of the first one after the last). One shuffle of the texts."""
    spark = docs.sparkSession
    text, doc = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))
    src = docs.select(doc.alias("doc_id"), text.alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, often = _cuts(src, PIECES * max(least, -(-size // RANGE_BYTES)))
    hot = np.array(sorted(often), np.int64)
    split = np.array([min(MAX_SPLIT, often[c]) for c in hot.tolist()], np.uint64)

    def piece(ids: pd.Series, h: pd.Series) -> np.ndarray:
        own = ids.to_numpy(np.int64)
        out = np.searchsorted(cuts, own, "left").astype(np.int64) * (2 * MAX_SPLIT)
        if len(hot):  # behind its piece's other rows, as the cut itself is the last doc_id of its piece
            k = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
            top = (h.to_numpy(np.int64).astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
            out += np.where(hot[k] == own, 1 + ((top * split[k]) >> np.uint64(32)).astype(np.int64), 0)
        return out

    keyed = src.select("doc_id", F.xxhash64("text").alias("h"), "text")
    measured = keyed.select(F.pandas_udf(lambda i, h: pd.Series(piece(i, h), index=i.index), "long")("doc_id", "h").alias("piece"), "doc_id",
        "h", F.octet_length("text").alias("bytes"))
    found = measured.groupBy("piece").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.sum("bytes").alias("bytes"))
    found = found.select("piece", "x.*", "bytes").toArrow().sort_by("piece")  # numbers, PIECES rows a range
    firsts, upto, limit = [], 0, min(RANGE_BYTES, size // least + 1)
    for k, bytes_ in enumerate(found.column("bytes").to_pylist()):
        if not firsts or upto + bytes_ > limit:
            firsts.append(k)
            upto = 0
        upto += bytes_
    firsts = found.take(pa.array(firsts, pa.int64()))
    starts = firsts.column("piece").to_numpy()

    @F.pandas_udf("long")
    def part(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, piece(ids, h), "right") - 1, index=ids.index)

    dealt = keyed.select(part("doc_id", "h").alias("part"), F.lit(0).alias("role"), "doc_id", "h", "text")
    if len(firsts):
        before = spark.createDataFrame(pa.table({"doc_id": firsts.column("doc_id"), "h": firsts.column("h"),
            "part": pa.array((np.arange(len(firsts)) - 1) % len(firsts))}))
        again = keyed.join(F.broadcast(before), ["doc_id", "h"]).groupBy("doc_id", "h",
            "part").agg(F.min("text").alias("text"))  # a row for each range
        dealt = dealt.unionByName(again.select("part", F.lit(1).alias("role"), "doc_id", "h", "text"))
    return dealt.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "role", "doc_id", "h", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited text and to the next document.
    Edited: the last floor(n_chars / 2) code points give way to the first as many of the next document."""

    def results(pairs: list[tuple]) -> pa.RecordBatch:
        """pairs: doc_id, text, its sketch, the next text, its sketch."""
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
        out = []
        for (doc_id, t, own, _, other), e, new in zip(pairs, edited, sketches(pa.array(edited, pa.string()), fraction)):
            out.append({
                "doc_id": None if doc_id == NO_DOC else doc_id, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(),
                "fingerprint": to_text(own), "edited_fingerprint": to_text(new),
                "near_edited": containment(own, new), "near_next": containment(own, other), "jaccard_edited": jaccard(own, new),
                    "jaccard_next": jaccard(own, other),
            })
        return pa.RecordBatch.from_pylist(out, schema=_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, doc_id, text, sketch
        for whole in batches:
            for at, n in slices(whole.column(4)):
                b = whole.slice(at, n)
                pairs = []
                for part, role, doc_id, text, own in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), sketches(b.column(4), fraction)):
                    if last and last[0] == part:
                        pairs.append((*last[1:], text, own))
                    last = (part, doc_id, text, own) if role == 0 else None
                if pairs:
                    yield results(pairs)

    return by_range(docs).mapInArrow(run, RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), *[(c, pa.float64()) for c in ("near_edited", "near_next", "jaccard_edited", "jaccard_next")]])
