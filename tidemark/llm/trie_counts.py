"""Token counts under a unigram model, with forward scores shared over a trie.

A pre-token is a word with the piece mark in front. Its best segmentation maximises the sum of the pieces' scores; the
forward score of a prefix (best score, and the fewest pieces that give it) depends on the prefix alone, so it is computed
once for each trie node: pre-tokens with a common prefix share the work, and a terminal node gives its token count. The trie
is that of the distinct pre-tokens of a batch, and it is walked in their order: each shared prefix of the batch is computed
once, whatever came before, and only the path to the present word is held. Counts of words are remembered by a Python worker
until there are KEPT of them, and then anew; that bounds memory and changes no result. No shuffle: a text's count is the sum
over its own words.

The vocabulary is a given public one, never trained: piece scores follow Zipf's law over the piece ranks. A character that
no piece covers costs its UTF-8 bytes as single byte tokens.

Null and empty texts have no tokens. Rows are independent, so ties and repeated rows need no rule; an empty table gives an
empty table. Other columns pass through, those named n_pretokens or n_tokens are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.fingerprint import slices

MARK = "▁"
#: Words whose counts a worker remembers; rows and bytes of text whose distinct words are one trie.
KEPT, BATCH_ROWS, BATCH_BYTES = 400_000, 10_000, 4 << 20
#: Score of one byte token.
BYTE_SCORE = -25.0


def zipf_scores(model_path: str) -> dict[str, float]:
    """Scores of the normal pieces of a model file by their rank r: -log(r + 1) - log(sum of 1 / (k + 1))."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = [p.piece for p in proto.pieces if p.type == 1]
    norm = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - norm for k, p in enumerate(pieces)}


class ForwardTrie:
    """Forward scores over tries of pre-tokens. A node is the score and token count of its prefix and the open pieces:
    vocabulary nodes that a longer prefix may still complete, with the score and count where each piece began."""

    def __init__(self, scores: dict[str, float]):
        self.pieces: tuple = ({}, None)  # children by character, score of the piece that ends here
        for piece, score in scores.items():
            at = self.pieces
            for c in piece[:-1]:
                at = at[0].setdefault(c, ({}, None))
            at[0][piece[-1]] = (at[0].get(piece[-1], ({}, None))[0], score)
        self.steps = 0  # nodes computed
        self.counts: dict[bytes, int] = {}

    def _below(self, node: tuple, c: str) -> tuple:
        """The node for one more character, from the open pieces of the prefix alone."""
        score, n, still = node[0], node[1], []
        raw = len(c.encode("utf-8", "surrogatepass"))
        best, fewest = score + BYTE_SCORE * raw, n + raw
        for s0, n0, piece in (*node[2], (score, n, self.pieces)):
            piece = piece[0].get(c)
            if piece is not None:
                if piece[0]:
                    still.append((s0, n0, piece))
                if piece[1] is not None:
                    s = s0 + piece[1]
                    if s > best or s == best and n0 + 1 < fewest:
                        best, fewest = s, n0 + 1
        self.steps += 1
        return best, fewest, tuple(still)

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """(word, token count) of distinct words (UTF-8), in the order of the trie: what a word shares with the one before it is
        not computed again."""
        path, before = [(0.0, 0, ())], ""
        for raw in sorted(words):
            word = MARK + raw.decode("utf-8", "surrogatepass")
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                path.append(self._below(path[-1], c))
            before = word
            yield raw, path[-1][1]

    def count(self, texts: list[list[bytes]]) -> list[int]:
        """The token count of each list of words."""
        if len(self.counts) > KEPT:
            self.counts = {}
        self.counts.update(self.walk({w for words in texts for w in words if w not in self.counts}))
        return [sum(map(self.counts.__getitem__, words)) for words in texts]


_tries: dict[str, ForwardTrie] = {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with n_pretokens and n_tokens (long). The model file is read where this is called."""
    keep = [f for f in docs.schema.fields if f.name not in ("n_pretokens", "n_tokens")]
    names = [f.name for f in keep]
    out = T.StructType([*keep, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    scores = docs.sparkSession.sparkContext.broadcast(zipf_scores(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _tries:  # one for each worker and model
            _tries[model_path] = ForwardTrie(scores.value)
        for whole in batches:
            for at, n in slices(whole.column(names.index(text)), BATCH_ROWS, BATCH_BYTES):
                b = whole.slice(at, n)
                # UTF-8 words, so that only ASCII white space splits
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in b.column(names.index(text)).to_pylist()]
                counts = pa.array([*map(len, words)], pa.int64()), pa.array(_tries[model_path].count(words), pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, *counts], names=[f.name for f in out.fields])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)
