"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of their ids is linked in a corpus.

All tokens of A and B are sorted by their start (lexsort) and the running maximum of their ends is taken: where a token starts
at that maximum nothing spans its start, so both tokenizers end there and a group begins. Within the groups, each A token is
expanded to the B tokens that its bytes overlap.

A text is put together from units, runs between spaces that neither tokenizer merges across: a unit's tokens, groups and
links do not depend on what stands around it, so each Python worker aligns a unit once and remembers it (up to KEPT units,
then it begins anew; a bound of memory only). What a document needs beyond its own units is the corpus-wide count of its
links. Documents are cut into blocks of so many units or bytes; a block gives its documents as numbers of its units, the
units' links, and its distinct id pairs with their counts. Counts are summed by pair over all blocks, and each block gets
back those of its own pairs: what is shuffled is a row for each block and distinct pair, not one for each link. A frequent
pair has as many rows there as there are blocks.

A null or empty text, and one whose joined token bytes of either tokenizer differ from it, has no tokens: zeros and an empty
digest. Rows are independent, repeated ones count each time; columns other than the text pass through, those named as a
result are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settle
from tidemark.llm.fingerprint import slices

MARK = "▁"
#: Units (and megabytes of them) that a worker remembers; units and bytes of text after which a block ends.
KEPT, KEPT_MB, BLOCK_UNITS, BLOCK_BYTES = 300_000, 32, 200_000, 64 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: A space may stand before the next unit unless one of these comes before it: white space by either tokenizer's rule.
_OPEN = re.compile(r"[\s\x00-\x1f\u180e] ")


def coalesce(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups and links of two lists of intervals (start, end), each in order and without overlap within itself.

    Gives the group of each interval of a and of b, and the places (in a, in b) of all overlapping pairs, by a."""
    start, end = np.concatenate([a[:, 0], b[:, 0]]), np.concatenate([a[:, 1], b[:, 1]])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.searchsorted(b[:, 1], a[:, 0], "right")  # b that ends behind a's start, up to b that starts at a's end
    n = np.searchsorted(b[:, 0], a[:, 1], "left") - first
    of = np.repeat(np.arange(len(a)), n)
    return group[: len(a)], group[len(a) :], of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def units_of(text: str) -> list[str]:
    """A space and the text (not empty), cut before spaces that follow no white space; each unit without its first space."""
    parts = text.split(" ")
    if not (text[0] == " " or text[-1] == " " or _OPEN.search(text)):
        return parts
    out, held = [], []
    for p in parts:
        held.append(p)
        if p and not _OPEN.match(p[-1] + " "):
            out.append(" ".join(held))
            held = []
    if held and out:  # spaces at the end
        out[-1] = " ".join([out[-1], *held])
    return out or [text]


class Aligner:
    """Aligns units once and remembers them. A unit's number is its place in the arrays below."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        # byte-level entries: printable bytes stand for themselves, the others follow from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in self.a.id_to_token(i)) if all(c in byte_of for c in self.a.id_to_token(i) or "") else b""
            for i in range(size)]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(MARK, " ").encode()
            for i in range(self.b.get_piece_size())]
        most = max(size, len(self.b_bytes))
        self.signed = np.array([[f"{i}{sign}" for i in range(most)] for sign in ("", ";", "|", ",")], object)
        self.a_len, self.b_len = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        within = re.compile("(?!" + _OPEN.pattern[:-1] + "). ", re.S)
        if any(within.search(x.decode("utf-8", "ignore")) for x in (*self.a_bytes, *self.b_bytes)):
            raise ValueError("a token that spans a space behind other text: units cannot be cut there")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []  # "a,a|b;a|b,b" of each unit
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1 where the bytes differ
        self.pairs = np.zeros(0, np.int64)  # links as a id << 32 | b id, unit after unit
        self.held = 0

    def full(self) -> bool:
        return len(self.place) > KEPT or self.held > KEPT_MB << 20

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the units of each text; those not seen before are aligned together."""
        cut = [units_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(u for us in cut for u in us if u not in self.place))
        for at in range(0, len(new), 20_000):
            self._align(new[at : at + 20_000])
        return [np.fromiter(map(self.place.__getitem__, us), np.int64, len(us)) for us in cut]

    def _align(self, new: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        raw = [b" " + u.encode() for u in new]
        join = lambda of, ids: b"".join(map(of.__getitem__, ids))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        same, tokens = np.ones(len(new), bool), []
        for ids, of, length in ((ids_a, self.a_bytes, self.a_len), (ids_b, self.b_bytes, self.b_len)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            if join(of, flat.tolist()) != b"".join(raw) or (np.add.reduceat(length[flat], np.cumsum(n) - n) != size).any():
                same &= [join(of, x) == r for x, r in zip(ids, raw)]  # some unit differs
            tokens.append((flat, n))
        (a, na), (b, nb) = ((flat[np.repeat(same, n)], np.where(same, n, 0)) for flat, n in tokens)
        spans = []  # all units one after the other
        for ids, length in ((a, self.a_len), (b, self.b_len)):
            end = np.cumsum(length[ids])
            spans.append(np.stack([end - length[ids], end], 1))
        ga, gb, i, j = coalesce(*spans)
        unit_a, unit_b = np.repeat(np.arange(len(new)), na), np.repeat(np.arange(len(new)), nb)
        per = lambda x: np.bincount(x, minlength=len(new))
        first = np.ones(len(ga), bool)
        first[1:] = ga[1:] != ga[:-1]
        sizes = np.stack([na, nb, per(unit_a[first]), per(unit_a[i])], 1)
        sizes[~same] = -1
        # the tokens by group, A before B, each with the sign behind it
        side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        group = np.concatenate([ga, gb])
        order = np.lexsort((side, group))
        side, group, unit, ids = (x[order] for x in (side, group, np.concatenate([unit_a, unit_b]), np.concatenate([a, b])))
        sign = np.zeros(len(ids), np.int64)  # none at the end of a unit
        sign[:-1] = np.where(unit[1:] != unit[:-1], 0, np.where(group[1:] != group[:-1], 1, np.where(side[1:] != side[:-1], 2, 3)))
        written = self.signed[sign, ids].tolist()
        upto = np.cumsum(na + nb).tolist()
        begin = 0
        for u, end in zip(new, upto):
            self.place[u] = len(self.groups)
            self.groups.append("".join(written[begin:end]))
            begin = end
        self.held += int(size.sum()) + sum(map(len, self.groups[-len(new) :]))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, a[i] << 32 | b[j]])


_aligners: dict[tuple[int, int], Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    """One per Python worker and pair of tokenizers."""
    key = hash(a), hash(b)
    if key not in _aligners:
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def _encoded(docs: DataFrame, a_path: str, b_path: str, text: str, groups: str | None) -> DataFrame:
    """Rows of documents (their columns, counts, digest, and units by number) and one row for each block: the links of its units,
    as places in its sorted distinct id pairs, and these pairs with their numbers of links."""
    keep = [f for f in docs.schema.fields if f.name not in (*COUNTS, "groups_sha256", groups, text)]
    own = [T.StructField(f"doc_{k}", f.dataType) for k, f in enumerate(keep)]
    out = T.StructType([T.StructField("block", T.LongType()), *own, *[T.StructField(c, T.LongType()) for c in COUNTS[:4]],
        *[T.StructField(c, T.StringType()) for c in ("groups_sha256", "groups")],
        *[T.StructField(c, T.BinaryType()) for c in ("units", "links", "sizes", "pairs", "counts")]])
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        models = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*models.value)
        block, local, n_local, size = TaskContext.get().partitionId() << 20, np.zeros(0, np.int64), 0, 0
        seen: list[np.ndarray] = []  # units of the block by local number
        used = np.zeros(0, np.int64)  # how often each occurs
        types: dict[str, pa.DataType] = {}

        def row(n: int, cols: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, types[f.name]) for f in out.fields], names=out.names)

        def close() -> pa.RecordBatch:
            unit = np.concatenate(seen) if seen else np.zeros(0, np.int64)
            links = np.maximum(aligner.sizes[:, 3], 0)
            n, end = links[unit], np.cumsum(links)[unit]
            at = np.arange(n.sum()) + np.repeat(end - np.cumsum(n), n)
            pairs, place = np.unique(aligner.pairs[at], return_inverse=True)
            counts = np.bincount(place, np.repeat(used[: len(unit)], n), len(pairs)).astype(np.int64)
            live = {"links": place.astype("<u4"), "sizes": n.astype("<u4"), "pairs": pairs, "counts": counts}
            return row(1, {"block": pa.array([block])} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in live.items()})

        for whole in batches:
            plain = (pa.int64(), pa.string(), pa.binary())
            types = {f.name: plain[0 if isinstance(f.dataType, T.LongType) else 1 if isinstance(f.dataType, T.StringType) else 2] for f in out.fields}
            types |= {f.name: c.type for f, c in zip(own, whole.columns)}
            for at, n in slices(whole.column(len(own)), 1000, 4 << 20):
                b = whole.slice(at, n)
                texts = b.column(len(own)).to_pylist()
                found = aligner.places(texts)
                fine = [bool(len(x)) and bool((aligner.sizes[x, 0] >= 0).all()) for x in found]
                if len(local) < len(aligner.groups):
                    local = np.concatenate([local, np.full(len(aligner.groups) - len(local), -1)])
                met = np.unique(np.concatenate([x for x, ok in zip(found, fine) if ok] or [np.zeros(0, np.int64)]))
                fresh = met[local[met] < 0]
                local[fresh] = n_local + np.arange(len(fresh))
                n_local += len(fresh)
                seen.append(fresh)
                found = [x if ok else x[:0] for x, ok in zip(found, fine)]
                units = [local[x].astype("<u4") for x in found]
                used = np.concatenate([used, np.zeros(n_local - len(used), np.int64)])
                used += np.bincount(np.concatenate(units), minlength=n_local)
                written = [";".join(map(aligner.groups.__getitem__, x.tolist())) for x in found]
                counts = np.array([aligner.sizes[x].sum(0) for x in found]).reshape(-1, 4)
                digest = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                yield row(n, {"block": pa.array(np.full(n, block)), "units": pa.array([u.tobytes() for u in units], pa.binary()),
                    "groups_sha256": pa.array(digest, pa.string())} | dict(zip([f.name for f in own], b.columns))
                    | {c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS[:4])} | ({"groups": pa.array(written, pa.string())} if groups else {}))
                size += sum(len(t) for t in texts if t)
                if n_local > BLOCK_UNITS or size > BLOCK_BYTES or aligner.full():
                    yield close()
                    if aligner.full():
                        aligner.forget()
                    block, local, n_local, size, seen, used = block + 1, np.zeros(0, np.int64), 0, 0, [], np.zeros(0, np.int64)
        if seen:
            yield close()

    src = docs.select(*[F.col(f"`{f.name}`").alias(f"doc_{k}") for k, f in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, out)


def _pairs(encoded: DataFrame) -> DataFrame:
    """(block, pair, n) of the blocks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in b.columns)):
                pairs, counts = (np.frombuffer(x, np.int64) for x in (pairs, counts))
                for k in range(0, len(pairs), 100_000):
                    x, n = pairs[k : k + 100_000], counts[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), pa.array(x), pa.array(n)], names=["block", "pair", "n"])

    return encoded.where("pairs is not null").select("block", "pairs", "counts").mapInArrow(run, "block long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair (a << 32 | b) in the whole corpus, and whether no pair of its b has more."""
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    counts = settle(pairs.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", b, "n"), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: str | None = None) -> DataFrame:
    """The other columns of docs with n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their
    B id), count_sum (their counts, all together), groups_sha256 and, if named, the groups themselves as text.

    A: a byte-level vocabulary for the tokenizers library; it gets a space and the text. B: a model for sentencepiece, which
    adds that space."""
    keep = [f.name for f in docs.schema.fields if f.name not in (*COUNTS, "groups_sha256", groups, text)]
    encoded = settle(_encoded(docs, a_path, b_path, text, groups), "aligned")
    counted = settle(pair_counts(_pairs(encoded)), "counted")
    back = _pairs(encoded).select("block", "pair").join(counted, "pair")
    own = [f"doc_{k}" for k in range(len(keep))]
    rows = encoded.select(F.when(F.col("units").isNull(), 1).otherwise(2).alias("kind"), "block", F.lit(None).cast("long").alias("pair"),
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), "links", "sizes", "units", *own, *COUNTS[:4],
        "groups_sha256", "groups")
    rows = rows.unionByName(back.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")
    out = T.StructType([*[rows.schema[c] for c in (*own, *COUNTS[:4], "groups_sha256", "groups")],
        *[T.StructField(c, T.LongType()) for c in COUNTS[4:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, ...]] = []
        value = np.zeros((0, 2), np.int64)  # n_best and count_sum of each unit of the block
        for b in batches:
            kind = b.column(0).to_numpy()
            for cut in np.split(np.arange(len(kind)), np.flatnonzero(np.diff(kind)) + 1):
                part = b.slice(cut[0], len(cut)) if len(cut) else b
                if not len(cut):
                    continue
                if kind[cut[0]] == 0:
                    pairs.append((part.column(2).to_numpy(), part.column(4).to_numpy(zero_copy_only=False).astype(np.int64), part.column(3).to_numpy()))
                elif kind[cut[0]] == 1:
                    for links, sizes in zip(part.column(5).to_pylist(), part.column(6).to_pylist()):
                        order = np.argsort(np.concatenate([x[0] for x in pairs])) if pairs else []
                        best, n = ((np.concatenate([x[k] for x in pairs])[order] if pairs else np.zeros(0, np.int64)) for k in (1, 2))
                        links, ends = np.frombuffer(links, "<u4"), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))])
                        upto = [np.concatenate([[0], np.cumsum(x[links])]) for x in (best, n)]
                        value = np.stack([c[ends[1:]] - c[ends[:-1]] for c in upto], 1)
                        pairs = []
                else:
                    units = [np.frombuffer(u, "<u4") for u in part.column(7).to_pylist()]
                    sums = np.array([value[u].sum(0) for u in units], np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([*part.columns[8:], pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=out.names)

    found = rows.mapInArrow(run, out)
    return found.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], *COUNTS, "groups_sha256", *([F.col("groups").alias(groups)] if groups else []))
