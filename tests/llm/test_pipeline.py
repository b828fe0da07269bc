"""The whole pipeline against a brute-force version in plain Python."""

import collections
import hashlib
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import MODEL, brute_join, brute_lines, words
from test_small_parts import brute_targets

DATA = "/root/testdata/sf0.001"


def brute_mix(docs):
    """docs: (doc_id, text, source) -> copies of each doc_id."""
    size = {d: len(words(t)) for d, t, _ in docs}
    names = sorted({s for *_x, s in docs}, key=lambda s: (s is None, s or ""))
    total = [sum(size[d] for d, _, s in docs if s == n) for n in names]
    out = {}
    for n, all_, target in zip(names, total, brute_targets(total, [(3, 1, 2)[k % 3] for k in range(len(names))])):
        passes, rest = divmod(round(target), all_) if all_ else (0, 0)
        upto = 0
        for d in sorted((d for d, _, s in docs if s == n), key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest(), d)):
            before, upto = upto, upto + size[d]
            once = before < rest and (upto <= rest or upto - rest <= rest - before)
            out[d] = passes + once if size[d] else 0
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")
def test_pipeline_equals_brute_force(spark):
    import sentencepiece

    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]  # no document of these tables is far from all languages
    kept = {d: t for d, _, _, t in brute_lines([(d, t) for d, t, *_x in docs])}
    stays = {d for d, _, c in brute_join(list(kept.items())) if d == c}
    copies = brute_mix([(d, kept[d], s) for d, _, _, s in docs if d in stays])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter()
    for d, _, lang, source in docs:
        if copies.get(d):
            ids = library.encode(kept[d], add_bos=True, add_eos=True)
            want[d, lang, source, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest()] += copies[d]
    got = collections.Counter((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256)
        for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and len(got) > 100


def test_stages_keep_their_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, "").count() == 0


def test_stages_on_odd_rows(spark, odd_docs):
    """Each stage's decisions on rows with nulls, ties, repeated and very long texts, and with columns of clashing names."""
    docs = odd_docs.withColumns({"comp": F.lit(1), "n_lines": F.lit(2), "rejected": F.lit("x"), "taken": F.lit(3), "lines": F.lit(4)}).cache()
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    of = lambda name: stages[name](spark, docs, "")
    got = collections.Counter((r.doc_id, r.text) for r in of("language_id").collect())
    assert got <= collections.Counter((d, t) for d, t, _ in rows if any(c.isalpha() for c in t or "")) and len(got) > 5
    lines = collections.Counter((r.doc_id, r.text, r.n_chars) for r in of("line_dedup").collect())
    length = {(r.doc_id, r.text): r.n_chars for r in docs.collect()}
    want = collections.Counter()
    for d, _, dropped, text in brute_lines([(d, t) for d, t, _ in rows]):
        want[d, text] += 1
    assert collections.Counter((d, t) for d, t, _ in lines.elements()) == want
    assert all(n == length.get((d, t), len(t)) for d, t, n in lines if (d, t) in length or t)
    kept = collections.Counter((r.doc_id, r.text) for r in of("ngram_join").collect())
    component = collections.defaultdict(set)
    for d, n, c in brute_join([(d, t) for d, t, _ in rows]):
        component[d].add((n, c))
    for d, t, _ in rows:
        alone = not words(t) or d is None or d in {c for _, c in component[d]}
        assert ((d, t) in kept) == alone or d is None, (d, t)
    assert sum(kept.values()) >= 9
    taken = of("mixing").collect()
    assert all(words(r.text) for r in taken) and max(collections.Counter((r.doc_id, r.text) for r in taken).values()) <= 4  # a repeated row, twice
    assert of("sentencepiece").where("n_tokens = 2").count() == sum(not (t or "") for _, t, _ in rows)
