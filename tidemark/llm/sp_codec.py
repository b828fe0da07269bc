"""SentencePiece BPE encoding and decoding by backtracking over longest matches.

A segmentation is the merge result exactly when every two neighbouring pieces are compatible: merging the text of both
again from characters gives those two pieces. So the encoder walks from left to right, tries the longest piece that starts
here (an Aho-Corasick automaton finds all of them in one pass), falls back to shorter prefixes, steps back when nothing
fits, and keeps a bitfield of end positions that are known to fail. Texts are cut first where no piece can span the
boundary, and the pieces of frequent parts are remembered per Python worker.

Nulls and empty texts give the begin and end ids only. Rows are independent: ties, repeated rows and extra columns pass
through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Parts remembered per worker, and piece pairs whose compatibility is remembered. Bounds of memory only: results never depend on them.
CACHE_PARTS, CACHE_PAIRS = 300_000, 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceCodec:
    """Encoder and decoder for one merge-type model with byte fallback and an identity normaliser."""

    def __init__(self, model: str | bytes):
        """model: the file, or what is in it."""
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model if isinstance(model, bytes) else _content(model))
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if train.model_type != 2 or not train.byte_fallback or kinds & {USER, UNUSED}:
            raise ValueError("a merge-type model with byte fallback and without user-defined or unused pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("an identity normaliser that escapes white space is needed")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.surface = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else train.unk_surface.encode()
            if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.opens = [p.type == NORMAL and p.piece.startswith(MARK) for p in proto.pieces]
        self.known = {c for p in self.score for c in p}
        self.odd = {c for c in self.known if c not in self.score}
        pairs = {a + b for p in self.score for a, b in zip(p, p[1:])}
        if any(p[1] == MARK and p[0] != MARK or "\n" in p for p in pairs):
            self.part = re.compile(".+", re.S)
        else:
            self.part = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
        self.reachable = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]}
        names = sorted(self.reachable)
        self.text_of, self.len_of = names, [len(p) for p in names]
        self.id_of = [self.ids[p] for p in names]
        at = {p: k for k, p in enumerate(names)}
        self.shorter = [next((at[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in at), -1) for p in names]
        self.matches = ahocorasick.Automaton()
        for k, p in enumerate(names):
            self.matches.add_word(p, k)
        self.matches.make_automaton()
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces by plain merging: the pair of the best score first, the leftmost of equal ones."""
        own, score = list(text), self.score
        while len(own) > 1:
            best, at = None, -1
            for k in range(len(own) - 1):
                s = score.get(own[k] + own[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own

    def compatible(self, a: int, b: int) -> bool:
        key = a * len(self.text_of) + b
        found = self.fits.get(key)
        if found is None:
            left, right = self.text_of[a], self.text_of[b]
            found = self.merge(left + right) == [left, right]
            if len(self.fits) < CACHE_PAIRS:
                self.fits[key] = found
        return found

    def _known_part(self, s: str) -> list[int]:
        """Backtracking over a part whose characters all are pieces."""
        n = len(s)
        longest = [-1] * (n + 1)
        len_of, shorter, fits, size = self.len_of, self.shorter, self.fits, len(self.text_of)
        for end, k in self.matches.iter(s):
            longest[end - len_of[k] + 1] = k
        failed = bytearray(n + 1)
        out: list[int] = []
        pos, k = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + len_of[k]
                if not failed[end]:
                    ok = True
                    if last >= 0:
                        ok = fits.get(last * size + k)
                        if ok is None:
                            ok = self.compatible(last, k)
                    if ok:
                        out.append(k)
                        pos, k = end, longest[end]
                        break
                k = shorter[k]
                if k < 0:
                    if last < 0:
                        raise ValueError("no segmentation")
                    failed[pos] = 1
                    out.pop()
                    pos -= len_of[last]
                    k = last
                    break
        return [self.id_of[k] for k in out]

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def encode_part(self, s: str) -> list[int]:
        known = self.known
        if all(map(known.__contains__, s)):
            if self.odd and any(map(self.odd.__contains__, s)):
                return [i for p in self.merge(s) for i in ([self.ids[p]] if p in self.ids else self._bytes(p))]
            return self._known_part(s)
        out: list[int] = []
        run = ""
        for c in s:  # nothing merges across an unknown character
            if c in known:
                run += c
                continue
            if run:
                out += self.encode_part(run)
                run = ""
            out += self._bytes(c)
        return out + (self.encode_part(run) if run else [])

    def packed(self, text: str | None) -> bytes:
        """All ids with begin and end id, as little-endian unsigned 32-bit integers."""
        get, parts, out = self.parts.get, self.parts, [self._pack([self.bos])]
        if text:
            for s in self.part.findall(self.prefix + text.replace(" ", MARK)):
                ids = get(s)
                if ids is None:
                    ids = self._pack(self.encode_part(s))
                    if len(parts) < CACHE_PARTS and len(s) < 64:
                        parts[s] = ids
                out.append(ids)
        out.append(self._pack([self.eos]))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, the space that the encoder put in front goes, byte pieces join to characters."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix:
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and self.opens[first]:
                raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per Python worker and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the packed ids of a text column (binary, little-endian unsigned 32-bit; begin and end ids included) and, if
    named, the text that they decode to. No shuffle: each row is encoded where it is read. The model file is read where this
    is called."""
    out = T.StructType([*[f for f in docs.schema.fields if f.name not in (ids, decoded)], T.StructField(ids, T.BinaryType()),
        *([T.StructField(decoded, T.StringType())] if decoded else [])])
    keep = [f.name for f in docs.schema.fields if f.name not in (ids, decoded)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`")]))

    model = docs.sparkSession.sparkContext.broadcast(_content(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                packed = [own.packed(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(packed, pa.binary())]
                if decoded:
                    cols.append(pa.array([own.decode(np.frombuffer(p, "<u4").tolist()) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return src.mapInArrow(run, out)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
