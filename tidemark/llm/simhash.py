"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A fingerprint holds the majority bits of the 64-bit hashes of a text's three-word shingles. Documents of equal fingerprints
are one node from the start. The trie of the distinct fingerprints is joined with itself: pairs of trie nodes are taken down
together, bit by bit, with the number of bits that differ so far, and a pair goes no further once that passes the budget.

Spark deals the trie by its subtrees. Four bit orders put each quarter of the bits on top; of four quarters, three differing
bits leave one untouched, so two linked fingerprints meet in one subtree of the four tries, whose root is a pair with itself.
Each fingerprint is sent four times, eight bytes each. A subtree of more than SUBTREE leaves (near copies share most bits) is
dealt again in the same way, by quarters of the bits below its root, until it is small or has so few bits left that its
leaves are bounded; nothing is left out. Within a task the trie is a sorted array, a node a range of it, and the node pairs
of all subtrees are taken down together in blocks of PAIRS. Of the links found only a spanning forest goes on, so a group
gives fewer rows than it has leaves; components are formed over these.

A null text is empty; a text without words has the fingerprint zero, which links as any other. Rows that repeat a doc_id are
rows of their own and link by their fingerprints. A row without a doc_id links too; its class id is null where no row of the
class has one. Extra columns are not used; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle
from tidemark.llm.components import components
from tidemark.llm.fingerprint import slices

#: Words of a shingle, seed of its hash, bits that may differ.
WORDS, SEED, DIFFER = 3, 42, 3
#: Leaves of a subtree that one task joins (or 2 to the bits left, at most 2 ** FEW_BITS), node pairs taken down at once.
SUBTREE, FEW_BITS, PAIRS = 16_384, 16, 200_000
#: A component is hot if it holds at least that part of all fingerprints, a fingerprint if of all rows: bounds what is broadcast.
HOT = 2000
# The primes of XXH64.
PRIMES = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, PRIMES)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The bits of a byte as the bytes of a 64-bit word: sums of up to 255 of them count eight bits at once.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, first: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many ranges of a byte array, all at once. raw: with eight bytes more than the ranges need."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))  # the eight bytes from each place on
    at, left = first.astype(np.int64), length.astype(np.int64)
    start = lambda n, x: np.full(n, np.uint64((seed + x) % 2**64))
    h = start(len(at), PRIMES[4])
    long = np.flatnonzero(left >= 32)
    if len(long):
        acc = [start(len(long), x) for x in (PRIMES[0] + PRIMES[1], PRIMES[1], 0, -PRIMES[0])]
        live, to = np.arange(len(long)), at[long]
        rest = left[long]
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[to[live] + 8 * k])
            to[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[long], at[long], left[long] = x, to, rest
    h += length.astype(np.uint64)
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), np.uint64), eight[at[live]]), 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    h[live] = _rotl(h[live] ^ ((eight[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left >= 1)
        h[live] = _rotl(h[live] ^ (raw[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a column of texts (words of lower-case A-Z, joined by one space), and where each text's begin."""
    column = column.cast(pa.string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size_of = int(at[-1] - at[0])
    if not size_of:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    raw = _LOWER[np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    inside = ~_SPACE[raw]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    some = at[1:] > at[:-1]
    last[at[1:][some] - 1] = inside[at[1:][some] - 1]  # a word ends with its text
    end = np.flatnonzero(last) + 1
    n = np.diff(np.searchsorted(end, at, "right"))  # words of each text
    if not len(end):
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    # the words with one space behind each: a shingle is a range of this
    upto = np.cumsum(inside)[end - 1]
    stop = upto + np.arange(len(end))  # of each word there
    packed = np.full(int(stop[-1]) + 9, 32, np.uint8)
    packed[np.arange(upto[-1]) + np.repeat(np.arange(len(end)), np.diff(upto, prepend=0))] = raw[inside]
    begin = np.concatenate([[0], stop[:-1] + 1])
    of = np.cumsum(n) - n
    count = np.maximum(n - size, 0) + (n > 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    word = np.arange(bounds[-1]) + np.repeat(of - bounds[:-1], count)
    to = np.minimum(word + size, np.repeat(of + n, count)) - 1
    return xxh64(packed, begin[word], stop[to] - begin[word]), bounds


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that are set in over half of them; zero for an empty run."""
    count = np.diff(bounds)
    parts = -(-count // 255)
    start = np.repeat(bounds[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros(len(count), np.uint64)
    if len(start):
        sums = np.empty((len(start), 8), np.uint64)
        for k in range(8):
            sums[:, k] = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * k)).astype(np.uint8)], start)
        full = np.flatnonzero(count)
        ones = np.add.reduceat(sums.view(np.uint8).astype(np.int64), (np.cumsum(parts) - parts)[full])
        set_ = 2 * ones > count[full][:, None]
        out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def simhash(column: pa.Array) -> np.ndarray:
    return majority(*shingle_hashes(column))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the fingerprint of each row as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(simhash(part.column(1)).view(np.int64))], names=["doc_id", "f"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, f long")


def trie_pairs(v: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int, budget: int = DIFFER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in v (sorted within each root's range) whose values differ in budget bits or fewer.

    low, high: the ranges of the roots, each a pair with itself; their values agree above bit (the topmost bit below the
    roots). A block of node pairs is a range of the stack; the deepest block is taken down first, so the stack stays small."""
    zero = np.zeros(len(low), np.int64)
    stack = [(low, high, low, high, zero, bit)]
    while stack:
        a0, a1, b0, b1, d, bit = stack.pop()
        if len(a0) > PAIRS:
            half = len(a0) // 2
            stack += [(*(x[half:] for x in (a0, a1, b0, b1, d)), bit), (*(x[:half] for x in (a0, a1, b0, b1, d)), bit)]
            continue
        alone = (a1 - a0 == 1) & (b1 - b0 == 1)
        one = np.flatnonzero(alone & (a0 != b0))  # two leaves: all bits that are left at once
        i, j = a0[one], b0[one]
        ok = np.bitwise_count(v[i] ^ v[j]) <= budget
        if ok.any():
            yield i[ok], j[ok]
        if bit < 0:  # all bits are the same in a node: equal values, which are one leaf
            continue
        own = np.flatnonzero(~alone)
        if not len(own):
            continue
        a0, a1, b0, b1, d = (x[own] for x in (a0, a1, b0, b1, d))
        a, b = _fork(v, a0, a1, bit), _fork(v, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        below = [(a0, a, b0, b, d), (a, a1, b, b1, d), (a0, a, b, b1, d + 1), (a[~same], a1[~same], b0[~same], b[~same], d[~same] + 1)]
        x = [np.concatenate(c) for c in zip(*below)]
        live = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget) & ((x[0] != x[2]) | (x[1] - x[0] > 1))
        if live.any():
            stack.append((*(c[live] for c in x), bit - 1))


def _fork(v: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where in each range, whose values agree above the bit, those begin that have it set."""
    low, high = low.copy(), high.copy()
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        on = (v[mid] >> np.uint64(bit)) & np.uint64(1) == 1
        high[live] = np.where(on, mid, high[live])
        low[live] = np.where(on, low[live], mid + 1)
    return low


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while (label[x] != x).any():
        x = label[x]
    return x


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, root): of n places each that pairs link, over others or directly, to a smaller one; the root is the smallest."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            label = label[label]
            i, j = _roots(label, i), _roots(label, j)
            apart = i != j
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
    root = _roots(label, label.copy())
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def turned(v: np.ndarray, fixed: int, turn: int) -> np.ndarray:
    """v with the bits below the topmost fixed ones turned so that their quarter number turn is on top."""
    rest = 64 - fixed
    by = np.uint64(rest // 4 * turn)
    mask = np.uint64((1 << rest) - 1)
    low = v & mask
    if by:
        low = ((low << by) | (low >> (np.uint64(rest) - by))) & mask
    return (v & ~mask) | low


_LEAVES = "path long, top long, v long, f long"


def _deal(leaves: DataFrame, fixed: int) -> DataFrame:
    """(path, top, v, f), four times for each of (path, v, f), whose v agree in the topmost fixed bits within a subtree.
    path: the turns so far; top: the bits of v that are fixed from now on. Rows of equal path and top are a subtree."""
    cut = np.uint64((64 - fixed) - (64 - fixed) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, v = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for turn in range(4):
                new = turned(v, fixed, turn)
                cols = [pa.array(x) for x in (4 * path + turn, (new >> cut).view(np.int64), new.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, b.column(2)], names=["path", "top", "v", "f"])

    return leaves.select("path", "v", "f").mapInArrow(run, _LEAVES)


def _joined(leaves: DataFrame, fixed: int) -> DataFrame:
    """Links (a, b) that connect what the subtrees' links connect. leaves: whole subtrees, of the same number of fixed bits."""

    def links(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        path, top, v, f = (np.concatenate(c) for c in zip(*held))
        new = np.ones(len(v), bool)
        new[1:] = (path[1:] != path[:-1]) | (top[1:] != top[:-1])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(v))
        some = high - low > 1
        a, b = forest(len(v), trie_pairs(v.view(np.uint64), low[some], high[some], 63 - fixed))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            cols = tuple(c.to_numpy() for c in b.columns)
            if n + len(cols[0]) > PAIRS and held:  # what has ended by the last row of the batch
                x = tuple(np.concatenate(c) for c in zip(*held, cols))
                back = np.flatnonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1]))
                cut = int(back[-1]) + 1 if len(back) else 0
                if cut:
                    yield from links([tuple(c[:cut] for c in x)])
                held, n = [tuple(c[cut:] for c in x)], len(x[0]) - cut
            elif len(cols[0]):
                held.append(cols)
                n += len(cols[0])
        if n:
            yield from links(held)

    dealt = leaves.repartition("path", "top").sortWithinPartitions("path", "top", "v")  # within a subtree, signs are the same
    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints f of nodes; over them each reaches all that it reaches over pairs of
    DIFFER differing bits or fewer."""
    leaves, fixed, out = nodes.select(F.lit(0).cast("long").alias("path"), F.col("f").alias("v"), "f"), 0, []
    while True:
        leaves = settle(_deal(leaves, fixed), "leaves")
        fixed += (64 - fixed) // 4
        sizes = leaves.groupBy("path", "top").agg(F.count("*").alias("n"))
        large = settle(sizes.where(F.col("n") > SUBTREE).select("path", "top"), "large")
        if 64 - fixed <= FEW_BITS or large.isEmpty():
            return reduce(DataFrame.unionByName, [*out, _joined(leaves, fixed)])
        out.append(_joined(leaves.join(large, ["path", "top"], "left_anti").select(*leaves.columns), fixed))
        leaves = leaves.join(large, ["path", "top"], "left_semi").select(*leaves.columns)


def _looked_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows joined with found by key. found: with n, the number of rows of each key; keys of many rows are broadcast, of
    which there are HOT at most, as the n sum up to all rows."""
    total = found.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") >= max(2, -(-total // HOT))
    hot = F.broadcast(found.where(many).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(found.where(~many).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = settle(fingerprints(docs), "fingerprints")
    nodes = settle(rows.groupBy("f").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "nodes")
    comp = components(links(nodes)).select(F.col("node").alias("f"), "comp")
    linked = settle(nodes.join(comp, "f"), "linked")
    smallest = settle(linked.groupBy("comp").agg(F.count("*").alias("n"), F.min("low").alias("component_id")), "smallest")
    named = _looked_up(linked.select("f", "comp", F.col("n").alias("rows")), "comp", smallest).select("f", F.col("rows").alias("n"), "component_id")
    alone = nodes.join(comp, "f", "left_anti").select("f", "n", F.col("low").alias("component_id"))
    found = settle(named.unionByName(alone), "classes")
    return _looked_up(rows, "f", found).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
