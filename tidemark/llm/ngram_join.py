"""Exact set similarity join on word shingles by universe partition and pigeonhole.

Two sets with a Jaccard similarity of p percent or more differ in H = floor((100 - p) (|r| + |s|) / (100 + p)) tokens at
most. The hash universe is cut into segments, as many as the size band asks for. A set indexes what it holds in its first
segments: a non-empty subset stands for one unit of distance (its own signature), a subset of DELETE_FROM tokens or more
for two (its own signature and those of its one-deletion neighbourhood). Segments are taken until H + 1 + slack units are
reached, so two similar sets agree in more units than the slack. The allocation by cost spends the slack: the cost of a
signature is the measured length of its list (the sets that hold it), and every set leaves its costliest lists, as many as
half of its smallest partner's slack. Sets that share a passage or a frequent phrase so leave the lists of that phrase.

Bands double in size; a set is indexed in its own band and, if its partners may be there, in the one below.

1. One pass over the texts gives each row's set (size, two hashes, parity bitmap) and the signatures of the sets. Equal
   sets become one node, by a hash of the whole set; sets whose first hash falls together are told apart by the second.
2. Each task sorts its signatures, and of the sets that share one within the task only the first goes on, so a signature
   that a third of all sets hold meets in one task with as many rows as there are tasks. Signatures are dealt to buckets
   whose number follows from the bytes of the texts, so a bucket's size, and its chance of clashes, are bounded.
3. In each signature group the most central set, by the sizes of all groups that it is in, is the star; the pairs of the
   star with the others are pruned by parity bitmaps: their Hamming distance never exceeds the sets' difference. Of each
   set the nearest such candidate is verified exactly, and components are formed.
4. In each signature group that is left, sets of different components are compared by bitmap, in blocks, first by a short
   fold of it and then by all of it; what passes is verified exactly, and the components are completed.

So every link between different sets is either verified or lies within a component already; no group is expanded to all
its pairs. Null texts and texts without words have an empty set and no link. Rows that repeat a doc_id are one class if
their sets are equal. A row with a null doc_id links as any other; its class id is null where no row of the class has one.
Extra columns are not used; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle
from tidemark.llm.components import components
from tidemark.llm.fingerprint import mixed, shingle_sets, slices

#: Percent of similarity, units of distance beyond the need, subset size from which deletions are indexed.
PERCENT, SLACK, DELETE_FROM = 75, 24, 5
#: Sets in one block of comparisons, sets verified in one group, signatures sorted at once, pairs compared at once.
BLOCK, STAR, CHUNK, PAIRS = 2048, 500, 400_000, 400_000
#: Bytes of text for a bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Bits of the smallest bitmap (short sets just below the similarity would pass a smaller one too often), and bits a token.
LEAST_BITS, TOKEN_BITS = 2048, 4
#: 64-bit words of the fold that is compared first.
FOLD = 16
#: A component is hot if it holds at least that part of all sets: bounds what is broadcast.
HOT_COMPONENTS = 2000
#: Segments of a band [l, 2l): l times this, from l on; below the first, single tokens.
SEGMENTS = ((256, 1.25), (128, 2), (64, 4))
SINGLE = 2**24
_C1 = np.uint64(0x9E3779B97F4A7C15)


def most_different(total: int, percent: int = PERCENT) -> int:
    return (100 - percent) * total // (100 + percent)


def slack_of(size: int) -> int:
    """Grows with the size, and never asks for more units than a set has."""
    return min(SLACK, size // 4)


def droppable(size: int, percent: int = PERCENT) -> int:
    """So many hot signatures a set of this size may leave: half the slack of its smallest possible partner."""
    return slack_of(-(-percent * size // 100)) // 2


def _segments(band: int) -> int:
    low = 1 << band
    return next((int(low * f) for start, f in SEGMENTS if low >= start), SINGLE)


def signatures(h: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of many sets (h: sorted distinct hashes, set after set), the set of each, and which sets lack slack."""
    size = np.diff(bounds)
    odd = np.zeros(len(size), bool)
    jobs = []  # (set, band, units needed)
    for k, z in enumerate(size.tolist()):
        band = z.bit_length() - 1
        for own, total in ((band, z + 100 * z // percent), (band - 1, z + (1 << band) - 1)):
            if own < 0 or own < band and -(-percent * z // 100) > (1 << band) - 1:
                continue
            if differ := most_different(total, percent):  # where it is 0, such partners are equal sets
                jobs.append((k, own, differ + 1 + slack_of(z)))
    if not jobs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), odd
    of_set, band, need = np.array(jobs, np.int64).T
    n = size[of_set]
    ends = np.cumsum(n)
    job = np.repeat(np.arange(len(n)), n)
    x = h[np.arange(ends[-1]) + np.repeat(bounds[of_set] - ends + n, n)]
    parts = np.array([_segments(k) for k in range(int(band.max()) + 1)], np.uint64)[band]
    segment = ((x >> np.uint64(32)) * parts[job]) >> np.uint64(32)  # ascending within a job, as h is
    new = np.ones(len(x), bool)
    new[1:] = segment[1:] != segment[:-1]
    new[ends[:-1]] = True
    first = np.flatnonzero(new)
    width = np.diff(np.append(first, len(x)))
    units = np.where(width >= DELETE_FROM, 2, 1)
    upto = np.cumsum(units)
    last = np.searchsorted(first, ends) - 1  # the last segment of each job
    before = np.concatenate([[0], upto[last[:-1]]])
    missing = np.maximum(0, need - (upto[last] - before))
    if (missing > np.array([slack_of(z) for z in n.tolist()])).any():
        raise ValueError("a set has too few segments")
    odd[of_set[missing > 0]] = True
    at = job[first]
    taken = upto - units - before[at] < need[at]
    token = mixed(x)
    total = np.add.reduceat(token, first)
    key = mixed(segment[first] + (band[at].astype(np.uint64) << np.uint64(32)) + _C1)
    own = np.flatnonzero(taken)
    more = np.repeat(np.where(taken & (width >= DELETE_FROM), np.arange(len(first)), -1), width)
    deleted = np.flatnonzero(more >= 0)
    more = more[deleted]
    sig = np.concatenate([mixed(total[own] + key[own]), mixed(total[more] - token[deleted] + key[more])])
    return sig, of_set[at[np.concatenate([own, more])]], odd


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the hashes by their low bits: TOKEN_BITS a token or more, a power of two, and LEAST_BITS at least. Its fold
    comes first."""
    bits = max(LEAST_BITS, 1 << (TOKEN_BITS * len(h) - 1).bit_length())
    parity = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    whole = np.packbits(parity.astype(np.uint8))
    return np.bitwise_xor.reduce(whole.view(np.uint64).reshape(-1, FOLD), axis=0).tobytes() + whole.tobytes()


class Bitmaps:
    """A column of bitmaps as rows of 64-bit words. The sizes are powers of two; a larger one folds to a smaller one."""

    def __init__(self, column: pa.Array):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.words = np.frombuffer(column.buffers()[2], np.uint8)[: at[-1]].view(np.uint64) if len(column) else np.empty(0, np.uint64)
        self.at, self.size = at[:-1] // 8, np.diff(at) // 8

    def fold(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The rows' bitmaps with so many words."""
        out = np.empty((len(rows), size), np.uint64)
        for n in np.unique(self.size[rows]):
            of = np.flatnonzero(self.size[rows] == n)
            step = max(1, PAIRS * FOLD // int(n))
            for k in range(0, len(of), step):
                part = of[k : k + step]
                whole = self.words[self.at[rows[part]][:, None] + np.arange(n)]
                out[part] = np.bitwise_xor.reduce(whole.reshape(len(part), n // size, size), axis=1)
        return out


def near(x: Bitmaps, a: np.ndarray, y: Bitmaps, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a of x, b of y) are within the limit by their whole bitmaps, and their Hamming distances."""
    size = np.minimum(x.size[a], y.size[b])
    d = np.empty(len(a), np.int64)
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        step = max(1, PAIRS * FOLD // int(n))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            d[part] = np.bitwise_count(x.fold(a[part], int(n)) ^ y.fold(b[part], int(n))).sum(1)
    ok = np.flatnonzero(d <= limit)
    return ok, d[ok]


def _set_ids(h: np.ndarray) -> tuple[int, int]:
    raw = h.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, seed)).astype(np.int64)) for seed in (1, 2))


# kinds of packed rows: first sets of a signature; the signatures of the others; and what is done: members, odd sets, rows
FIRST, COUNT, MEMBER, ODD, ROW = range(5)
_PAIRS = np.dtype([("x", "<i8"), ("y", "<i8")])
_FIRSTS = np.dtype([("x", "<u4"), ("y", "<i8")])


def _pack(a: np.ndarray, b: np.ndarray, kind: np.dtype = _PAIRS) -> bytes:
    out = np.empty(len(a), kind)
    out["x"], out["y"] = a, b
    return out.tobytes()


def _sorted_distinct(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, node) in order, and which are the first of their signature."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if len(sig):
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
    return sig, node, np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)


_DEALT = "bucket int, kind int, payload binary, doc_id long, text_hash long, n_shingles long, s1 long, s2 long"
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _DEALT.split(", ")]


def _batch(rows: dict[str, list | pa.Array], n: int) -> pa.RecordBatch:
    cols = [pa.array(rows[c], t) if isinstance(rows.get(c), list) else rows[c] if c in rows else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _batch(dict(zip(_NAMES, map(list, zip(*rows)))) if rows else {}, len(rows))


def _index(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Rows of all kinds but FIRST and COUNT: a ROW for each document (its bitmap is the payload, once in a task for each
    set), the members of all signature groups of two sets or more, and the odd sets.

    Signatures are kept as (bucket, 32 bits); two that fall together only give a candidate more."""
    width = np.uint64(-(-(1 << 32) // buckets))  # a bucket is a range of the signatures' upper half
    cut = np.uint64(int(width).bit_length())

    def short(sig: np.ndarray) -> np.ndarray:
        bucket = (sig >> np.uint64(32)) // width
        return ((bucket << np.uint64(32)) | ((sig - (bucket * width << np.uint64(32))) >> cut)).astype(np.int64)

    def deal(sig: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        sig, node, first = _sorted_distinct(short(sig), node)
        if not len(sig):
            return
        if not first.all():
            yield int(node[0] % buckets), MEMBER, _pack(sig[~first], node[~first])
        start = np.flatnonzero(first)
        own, more = sig[start], np.diff(np.append(start, len(sig))) - 1
        cuts = np.searchsorted(own, np.arange(buckets + 1, dtype=np.int64) << 32)
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            yield int(k), FIRST, _pack(own[a:b] & 0xFFFFFFFF, node[start[a:b]], _FIRSTS)
            if (some := more[a:b] > 0).any():
                yield int(k), COUNT, _pack(own[a:b][some], more[a:b][some])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sigs, nodes, odd, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = list(deal(np.concatenate(sigs), np.concatenate(nodes))) if sigs else []
            if odd:
                rows.append((odd[0] % buckets, ODD, _pack(np.array(odd), np.array(odd))))
            return _packed(rows)

        for whole in batches:
            for at, n in slices(whole.column(1)):
                b = whole.slice(at, n)
                h, bounds = shingle_sets(b.column(1))
                size = np.diff(bounds)
                ids = [_set_ids(h[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                fresh = []
                for k in np.flatnonzero(size).tolist():
                    if ids[k] not in seen:
                        seen.add(ids[k])
                        fresh.append(k)
                maps = [None] * len(ids)
                for k in fresh:
                    maps[k] = bitmap(h[bounds[k] : bounds[k + 1]])
                s1, s2 = ([i[k] for i in ids] for k in (0, 1))
                rows = {"bucket": b.column(3), "kind": [ROW] * len(ids), "payload": maps, "doc_id": b.column(0), "text_hash": b.column(2),
                    "n_shingles": size.tolist(), "s1": s1, "s2": s2}
                yield _batch(rows, len(ids))
                if not fresh:
                    continue
                fresh = np.array(fresh)
                n = size[fresh]
                ends = np.cumsum(n)
                some = h[np.arange(ends[-1]) + np.repeat(bounds[fresh] - ends + n, n)]
                found, of, lacks = signatures(some, np.concatenate([[0], ends]), percent)
                node = np.array(s1, np.int64)[fresh]
                odd += node[lacks].tolist()
                sigs.append(found)
                nodes.append(node[of])
                held += len(found)
                if held >= CHUNK:
                    yield flush()
                    seen, sigs, nodes, odd, held = set(), [], [], [], 0
        yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts, counts = -1, [], []

        def close() -> list[tuple[int, int, bytes]]:
            if not firsts:
                return []
            x = np.frombuffer(b"".join(firsts), _FIRSTS)
            sig, node, first = _sorted_distinct(x["x"].astype(np.int64) | (now << 32), x["y"])
            start = np.flatnonzero(first)
            total = np.diff(np.append(start, len(sig)))
            if counts:
                c = np.frombuffer(b"".join(counts), _PAIRS)
                total = total + np.bincount(np.searchsorted(sig[start], c["x"]), c["y"], len(start)).astype(np.int64)
            shared = total[np.cumsum(first) - 1] >= 2
            return [(now, MEMBER, _pack(sig[shared], node[shared]))] if shared.any() else []

        for b in batches:
            kinds = b.column(1).to_numpy()
            if (kinds > COUNT).any():
                yield b.filter(pa.array(kinds > COUNT))
            done = []
            for k in np.flatnonzero(kinds <= COUNT):
                bucket, payload = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                if bucket != now:
                    done += close()
                    now, firsts, counts = bucket, [], []
                (firsts if kinds[k] == FIRST else counts).append(payload)
            if done:
                yield _packed(done)
        if last := close():
            yield _packed(last)

    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")  # copies of a text go to buckets of their own
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), own.alias("bucket"))
    dealt = src.mapInArrow(emit, _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, _DEALT)


def _unpack(packed: DataFrame, kind: int, x: str, y: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0).to_pylist():
                p = np.frombuffer(payload, _PAIRS)
                for at in range(0, len(p), 100_000):
                    part = p[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part["x"].copy()), pa.array(part["y"].copy())], names=[x, y])

    return packed.where(F.col("kind") == kind).select("payload").mapInArrow(run, f"{x} long, {y} long")


def _limits(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return (100 - percent) * (na + nb) // (100 + percent)


def _near(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow the similarity, with their Hamming distance d. First by the folds: what they allow, a
    small part, goes on to the whole bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, na, nb = (c.to_numpy() for c in t.columns[:4])
            every = np.arange(len(a))
            ok, d = near(Bitmaps(t.column(4)), every, Bitmaps(t.column(5)), every, _limits(na, nb, percent))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(d)], names=["a", "b", "d"])

    for bits in ("fold", "bits"):
        a, b = (info.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col(bits).alias(f"bits{c}")) for c in ("a", "b"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = settle(both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long, d long"), "near")
    return pairs


#: Stands for a missing doc_id in joins.
NO_DOC = -(2**63)


def _place() -> list[Column]:
    """What finds a row's text again: its doc_id, of which there may be none, and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("place_id"), F.col("text_hash")]


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by their whole sets. Sets are dealt by a, with b's in salted groups; a
    set's text is fetched once for each STAR of the groups that it goes to."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    to = lambda key, salt, role: F.struct(F.col(key).alias("key"), salt.alias("salt"), F.lit(role).alias("role")).alias("at")
    b_at = pairs.join(size, "a").select(F.col("b").alias("node"), to("a", F.pmod(F.xxhash64("b"), "salts").cast("int"), 1))
    a_at = size.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("node",
        to("node", F.col("salt"), 0))
    goes = a_at.unionByName(b_at)
    many = goes.groupBy("node").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    goes = goes.join(many, "node").groupBy("node", F.pmod(F.xxhash64("at"), "parts").alias("part")).agg(F.collect_list("at").alias("at"))
    goes = goes.join(reps, "node").select("place_id", "text_hash", "node", "part", "at")
    texts = docs.select(*_place_of(docs), "text").join(goes, ["place_id", "text_hash"])
    texts = texts.groupBy("node", "part").agg(F.first("at").alias("at"), F.first("text").alias("text"))  # of repeated rows, one

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "salt", "role", "node", "h"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for whole in batches:
            for k, n in slices(whole.column(2)):
                part = whole.slice(k, n)
                h, bounds = shingle_sets(part.column(2))
                rows, held = [], 0
                for j, (node, at) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    raw = h[bounds[j] : bounds[j + 1]].tobytes()
                    for p in at:
                        rows.append((p["key"], p["salt"], p["role"], node, raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            out = []
            for key, salt, role, node, h in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(h, np.uint64)
                if role == 0:
                    now, own = (key, salt), h
                elif now == (key, salt):
                    both = len(np.intersect1d(own, h, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(h) - both):
                        out.append((key, node))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 2], names=["a", "b"])

    dealt = texts.select("node", "at", "text").mapInArrow(emit, "key long, salt int, role int, node long, h binary")
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(compare, "a long, b long")


def _place_of(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("place_id"), F.xxhash64("text").alias("text_hash")]


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a signature group that are of different components and pass the bitmap. Groups are cut into blocks
    that meet two by two. members: sig, node, comp, n_shingles, bits, g (size of the group)."""
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.select("sig", "node", "comp", "n_shingles", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "comp", "node", "n_shingles",
        "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(t: pa.RecordBatch, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups, which begin where cut says; their rows are in the order of their components."""
            p, q, own, comp, node, n = (c.to_numpy() for c in t.columns[1:7])
            bits = Bitmaps(t.column(7))
            new = np.ones(len(p), bool)
            new[1:] = comp[1:] != comp[:-1]
            new[cut] = True
            run_end = np.append(np.flatnonzero(new), len(p))[np.cumsum(new)]
            group_end = np.repeat(np.append(cut, len(p))[1:], np.diff(np.append(cut, len(p))))
            more = group_end - run_end  # rows of its group behind a row's component
            upto = np.cumsum(more)
            at = 0
            while at < len(p):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                m = more[at:end]
                i = np.repeat(np.arange(at, end), m)
                j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(run_end[at:end], m)
                at = end
                ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                ok &= (p[i] == q[i]) | (own[i] != own[j])
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                rows, to = np.unique(np.concatenate([i, j]), return_inverse=True)
                short = bits.fold(rows, FOLD)
                limit = _limits(n[i], n[j], percent)
                ok = np.bitwise_count(short[to[: len(i)]] ^ short[to[len(i) :]]).sum(1) <= limit
                i, j, limit = i[ok], j[ok], limit[ok]
                ok, _ = near(bits, i, bits, j, limit)
                a, b = node[i[ok]], node[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []  # of the group that is not at its end
        last = None
        for b in batches:
            sig, p, q = (b.column(k).to_numpy() for k in range(3))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            new[:1] = last is not None and last != (sig[0], p[0], q[0]) if len(sig) else False
            cut = np.flatnonzero(new)
            if not len(sig):
                continue
            last = (sig[-1], p[-1], q[-1])
            if not len(cut):
                held.append(b)
                continue
            yield from compare(_joined([*held, b.slice(0, cut[0])]), np.array([0])) if held or cut[0] else ()
            if len(cut) > 1:
                yield from compare(_joined([b.slice(cut[0], cut[-1] - cut[0])]), cut[:-1] - cut[0])
            held = [b.slice(cut[-1])]
        if held:
            yield from compare(_joined(held), np.array([0]))

    cut = dealt.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "comp")
    return cut.mapInArrow(run, "a long, b long").distinct()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch with buffers of its own, which begin at its first row."""
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0].take(pa.array(np.arange(batches[0].num_rows)))


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, comp (a number of the component; null for an empty set) and component_id (smallest
    doc_id that is reached over links) of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = settle(_index(docs, max(4 * parts, -(-size // BUCKET_BYTES)), percent), "signatures")
    sets = packed.where(F.col("kind") == ROW).select("doc_id", "text_hash", "n_shingles", "s1", "s2", F.col("payload").alias("bits"))
    full = sets.where("n_shingles > 0")
    distinct = _unpack(packed, MEMBER, "sig", "node")
    odd = _unpack(packed, ODD, "node", "y").select("node")
    # sets that share their first hash are told apart: each is in the groups of all of them and in one more with these,
    # which none leaves, and is named by its second hash
    clash = settle(full.groupBy("s1").agg(F.min("s2").alias("x"), F.max("s2").alias("y")).where("x <> y").select("s1"), "clashes")
    if clash.isEmpty():
        sets = sets.withColumn("node", F.col("s1"))
    else:
        sets = sets.join(clash.withColumn("clashes", F.lit(True)), "s1", "left").withColumn("node",
            F.when(F.col("clashes"), F.col("s2")).otherwise(F.col("s1")))
        names = sets.where("clashes").select(F.col("s1").alias("node"), F.col("s2").alias("other")).distinct()
        distinct, odd = (df.join(names, "node", "left").withColumn("node", F.coalesce("other", "node")).drop("other") for df in (distinct, odd))
        distinct = distinct.unionByName(names.select((-1 - F.pmod("node", F.lit(1 << 62))).alias("sig"), F.col("other").alias("node")))
    full = sets.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    info = full.groupBy("node").agg(first.alias("x"), F.first("n_shingles").alias("n_shingles"), F.max("bits").alias("bits"))
    fold, whole = F.substring("bits", 1, 8 * FOLD).alias("fold"), F.expr(f"substring(bits, {8 * FOLD + 1})").alias("bits")
    info = settle(info.select("node", "n_shingles", fold, whole, F.col("x.doc_id").alias("doc_id"), F.col("x.text_hash").alias("text_hash")), "sets")
    reps = info.select("node", *_place())

    distinct = settle(distinct.distinct(), "members")
    # small sides of joins by signature are written first: with a plain exchange on both sides Spark can split hot ones
    sizes = settle(distinct.groupBy("sig").agg(F.count("*").alias("g")), "sizes")
    members = settle(distinct.join(sizes, "sig").where("g > 1"), "members")
    # the most central member of a group is its star: the one whose signatures most sets hold, in all
    central = members.groupBy("node").agg(F.sum("g").alias("weight"))
    stars = settle(members.join(central, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("x")).select("sig",
        F.col("x.node").alias("a")), "stars")
    pairs = members.join(stars, "sig").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    close = _near(pairs, info, percent)
    best = close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = settle(_verified(best, docs, reps, percent), "links")
    comp = components(links)

    label = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    apart = close.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    # a set leaves its costliest lists, but for those that a set without slack holds
    least = F.least(F.lit(SLACK), F.floor(F.ceil(percent * F.col("n_shingles") / 100) / 4))
    costly = Window.partitionBy("node").orderBy(F.desc("g"), "sig")
    live = members.where("g > 2").join(info.select("node", "n_shingles"), "node")  # of two, one is the star
    live = live.withColumn("stays", F.row_number().over(costly) > F.floor(least / 2))
    live = live.join(comp, "node", "left").select("sig", "node", "g", "stays", F.coalesce("comp", "node").alias("comp"))
    lacking = settle(members.join(odd, "node").select("sig").distinct(), "lacking")
    stays = F.col("stays") | (F.col("sig") < 0)
    if not lacking.isEmpty():
        live = live.join(lacking.withColumn("lacks", F.lit(True)), "sig", "left")
        stays = stays | F.coalesce("lacks", F.lit(False))
    kept = settle(live.where(stays).select("sig", "node", "g", "comp"), "kept")
    groups = settle(kept.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig"), "groups")
    across = _across(kept.join(groups, "sig").join(info.select("node", "n_shingles", "bits"), "node"), percent)
    rest = settle(apart.unionByName(across).distinct().join(best.withColumn("was", F.lit(True)), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = settle(_verified(rest, docs, reps, percent), "links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    named = sets.join(comp, "node", "left").select("doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("comp"))
    smallest = named.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    smallest = settle(smallest, "smallest")
    hot = smallest.where(F.col("n") >= max(2, -(-(smallest.agg(F.sum("n")).first()[0] or 0) // HOT_COMPONENTS))).drop("n")
    hot = F.broadcast(hot)  # the sizes sum up to all rows, so these are HOT_COMPONENTS at most
    rest = named.where("n_shingles > 0").join(hot.select("comp"), "comp", "left_anti").join(smallest.drop("n"), "comp")
    empty = named.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return reduce(DataFrame.unionByName, [named.join(hot, "comp"), rest, empty])


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which one document of each component stays: that with the smallest doc_id (none comes last),
    then the smallest hash of its text. Rows that repeat doc_id and text are one document; rows without words stay."""
    found = settle(classes(docs, percent), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    best = found.where("comp is not null").groupBy("comp").agg(first).select("x.doc_id", "x.text_hash")
    stay = best.unionByName(found.where("comp is null").select("doc_id", "text_hash"))
    stay = stay.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("stay_id"), F.col("text_hash").alias("stay_text"))
    # columns of the two tables themselves: docs may have columns of any name
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)) == stay["stay_id"]) & (F.xxhash64(docs["text"]) == stay["stay_text"])
    return docs.join(stay, same, "left_semi")
