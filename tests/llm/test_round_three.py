"""Filter interaction audit, SimHash trie join and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, fingerprint, queries, simhash, token_align

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ---- filter interaction audit


def failed(rows):
    """The letters that each row fails."""
    texts = defaultdict(list)
    for r in rows:
        texts[r["text"] or ""].append(-1 if r["doc_id"] is None else r["doc_id"])
    for r in rows:
        t, w = r["text"] or "", words_of(r["text"])
        yield "".join(c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t),
            min(texts[t]) < (-1 if r["doc_id"] is None else r["doc_id"]))) if x)


def audited(rows, good, toxic):
    out, per = {}, Counter()
    fails = list(failed(rows))
    parts = {r["lang"] or "" for r in rows}
    for part in parts:
        own = [(r["doc_id"], f) for r, f in zip(rows, fails) if (r["lang"] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                per[part, c] += len(gone)
                out[part, order, step + 1] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == c for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: (*v, per[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def some_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_of_odd_rows(odd_docs, some_labels):
    docs = odd_docs.unionByName(odd_docs.where("doc_id is null")).unionByName(odd_docs.where("doc_id = 6").withColumn("doc_id", F.lit(60)
        .cast("long"))).withColumn("mask", F.lit("x")).withColumn("digest", F.lit(1))
    found = result(filter_audit.audit(filter_audit.cells(docs, some_labels), "ABCDE"))
    assert found == audited(docs.collect(), {1, 6}, {1, 2, 7})


def test_audit_of_nothing(spark, no_docs, some_labels):
    assert filter_audit.audit(filter_audit.cells(no_docs, some_labels), "ABCDE").collect() == []


def test_path_counts_are_those_of_all_orders():
    for k in range(1, 6):
        reach, leave = filter_audit.path_counts(k)
        taken = Counter()
        for order in permutations(range(k)):
            state = 0
            for f in order:
                taken[state, f] += 1
                state |= 1 << f
        assert all(reach[s] * leave[s | 1 << f] == n for (s, f), n in taken.items())


def test_shapley_sums_to_all_removals(spark):
    cells = spark.createDataFrame([("x", m, m + 1, 1, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.edges(cells, 3).select("filter", "shapley").distinct().collect()
    assert sum(r["shapley"] for r in rows) == 6 * sum(range(2, 9))  # each order removes all that fail anything
    with pytest.raises(ValueError):
        filter_audit.edges(cells, 8)


# ---- ranges of fingerprints


@pytest.mark.parametrize("step", [2, 7, 1000])
def test_ranges_cut_in_two_steps(spark, monkeypatch, step):
    """More pieces than one query has quantiles, with a doc_id of a third of all rows: same results, ranges of bounded size."""
    monkeypatch.setattr(fingerprint, "STEP", step)
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    rng = random.Random(8)
    rows = [(7 if k % 3 == 0 else rng.randrange(-50, 400), f"text {k} " + "x" * rng.randrange(60)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprint.by_range(docs)
    sizes = [r.n for r in dealt.where("role = 0").groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()]
    assert sum(sizes) == sum(len(t) for _, t in rows) and max(sizes) <= 4 * 2000
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0], h[r[1]], r[1]))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        want.append((d, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.edited_sha256) for r in fingerprint.with_next(docs).collect()) == sorted(want)


# ---- SimHash


def simhash_of(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(rows):
    """rows: (doc_id, fingerprint); the smallest doc_id that each reaches."""
    n, f = len(rows), np.array([x for _, x in rows], np.uint64)
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 3).tolist():
            a, b = find(i), find(i + 1 + j)
            top[max(a, b)] = min(a, b)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, f"{x:016x}", low.get(find(k))) for k, (d, x) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_hashes_of_any_length_equal_the_library():
    raw = np.frombuffer(random.Random(1).randbytes(4000), np.uint8)
    first = np.arange(0, 300)
    length = np.array([k % 150 for k in first])
    wanted = [xxhash.xxh64_intdigest(raw[a : a + n].tobytes(), 42) for a, n in zip(first, length)]
    assert simhash.xxh64(raw, first, length).tolist() == wanted


def test_simhash_of_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("f", F.lit("x")).withColumn("n", F.lit(1))
    rows = [(r["doc_id"], simhash_of(r["text"])) for r in docs.collect()]
    assert ordered(simhash.join(docs).collect()) == ordered(linked(rows))
    assert simhash.join(no_docs).collect() == []


def test_simhash_of_a_whole_table(spark):
    rows = [(r["doc_id"], simhash_of(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert ordered(queries.op12_simhash(spark, SF).collect()) == ordered(linked(rows))


@pytest.fixture(scope="module")
def near_values():
    """Values around few centres, up to seven bits off; a whole cube of the lowest bits; some by themselves."""
    rng, out = random.Random(5), set(range(64))
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for k in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << k
            out.add(x)
    return sorted(out | {rng.getrandbits(64) for _ in range(100)})


def test_trie_pairs_equal_all_pairs(near_values):
    v = np.array(near_values, np.uint64)
    found = set()
    for i, j in simhash.trie_pairs(v, np.array([0]), np.array([len(v)]), 63):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert found == {(i, i + 1 + j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 3).tolist()}


@pytest.mark.parametrize("most", [16_384, 40])
def test_large_subtrees_are_dealt_again(spark, monkeypatch, near_values, most):
    monkeypatch.setattr(simhash, "SUBTREE", most)
    signed = [x - (1 << 64) if x >> 63 else x for x in near_values]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "f long")).collect()
    place = {x: k for k, x in enumerate(signed)}
    moved, root = simhash.forest(len(signed), iter([tuple(np.array([place[r[c]] for r in links]) for c in ("a", "b"))]))
    found = np.arange(len(signed))
    found[moved] = root
    wanted = linked(list(enumerate(near_values)))
    assert found.tolist() == [r[2] for r in wanted]


# ---- alignment


def aligned(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    per, total = [], Counter()
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
        if not t or any(b"".join(x) != (" " + t).encode() for x in raw):
            per.append(None)
            continue
        spans = []
        for x, own in zip(ids, raw):
            at, out = 0, []
            for i, y in zip(x, own):
                out.append((at, at + len(y), i))
                at += len(y)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [tuple([i for s, e, i in x if lo <= s and e <= hi] for x in spans) for lo, hi in zip([0, *ends], ends)]
        links = [(i, j) for s, e, i in spans[0] for s2, e2, j in spans[1] if s < e2 and s2 < e]
        total.update(links)
        per.append((ids, groups, links))
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    for x in per:
        if x is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        ids, groups, links = x
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (*map(len, ids), len(groups), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest())


ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "don't  stop \n\n  now", "x\n y\n  z", "tab\t tab", "<|endoftext|> <s></s> <unk>", "▁ mark",
    "café 日本語 \U0001f600    x", "\x1c \x85 ᠎ y", "　 z   q", "12 345  6789", "nul\x00 nul", "\r\n \r\n", "w" * 3000,
    "one two three one two three", "one two three one two three", "� ﻿ b", "á é 가 q"]


def test_alignment_of_odd_texts(spark, no_docs):
    import public_tokenizers

    docs = spark.createDataFrame([(k, t, 1, "y") for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string, units int, block string")
    rows = token_align.align(docs, public_tokenizers.path(A), public_tokenizers.path(B), groups="pairs").orderBy("doc_id").collect()
    assert [tuple(r[c] for c in (*token_align.COUNTS, "groups_sha256")) for r in rows] == list(aligned(ODD_TEXTS))
    assert [(r["units"], r["block"]) for r in rows] == [(1, "y")] * len(ODD_TEXTS)
    assert all(hashlib.sha256(r["pairs"].encode()).hexdigest() == r["groups_sha256"] for r in rows if r["pairs"])
    assert token_align.align(no_docs, public_tokenizers.path(A), public_tokenizers.path(B)).collect() == []


def test_alignment_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op13_token_align(spark, SF).orderBy("doc_id").collect()
    wanted = [(d["doc_id"], *x) for d, x in zip(docs, aligned([d["text"] for d in docs]))]
    assert [tuple(r[c] for c in ("doc_id", *token_align.COUNTS, "groups_sha256")) for r in rows] == wanted


def test_blocks_and_memory_change_nothing(monkeypatch):
    """Small blocks and a short memory, without Spark: the rows of the documents stay the same."""
    import public_tokenizers

    models = [open(public_tokenizers.path(x), "rb").read() for x in (A, B)]
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=50)) for _ in range(40)]
    one, other = token_align.Aligner(*models), token_align.Aligner(*models)
    monkeypatch.setattr(token_align, "KEPT", 50)
    for k in range(0, 40, 5):
        part = texts[k : k + 5]
        x, y = one.places(part), other.places(part)
        assert [";".join(one.groups[i] for i in p) for p in x] == [";".join(other.groups[i] for i in p) for p in y]
        if other.full():
            other.forget()


def test_intervals_with_gaps_and_overlaps_across():
    a = np.array([[0, 2], [2, 3], [5, 9]])
    b = np.array([[0, 1], [1, 3], [6, 7], [7, 12]])
    ga, gb, i, j = token_align.coalesce(a, b)
    assert (ga.tolist(), gb.tolist()) == ([0, 0, 1], [0, 0, 1, 1])
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    assert [len(x) for x in token_align.coalesce(a[:0], b[:0])] == [0, 0, 0, 0]
