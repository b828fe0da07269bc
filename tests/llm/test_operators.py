"""The operators as Spark jobs: odd rows, empty tables, clashing columns, and brute force on the given tables."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, fingerprint, html_density, langid, line_runs, mixing, ngram_join, queries, sp_codec, trie_counts, warc
from tidemark.llm.common import scratch_path, settle
from tidemark.llm.components import components

MODEL = queries.public_tokenizers.path(queries.MODEL)
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- lines


def brute_lines(docs, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(-(2**63) if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(held[key(x)]) >= min_docs and (-(2**63) if d is None else d) < max(held[key(x)]) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_lines_on_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({"lines": F.lit("mine"), "r1": F.lit(1), "n_lines": F.lit("old"), "gone": F.lit(2)})
    got = line_runs.drop_repeated_lines(docs)
    assert {"lines", "r1", "gone"} <= set(got.columns)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows_of(got)),
        key=repr) == brute_lines([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_lines_count_a_repeated_doc_id_once(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(5, line), (5, line + "\nmore of it"), (6, line)], "doc_id long, text string")
    assert [r["n_dropped"] for r in rows_of(line_runs.drop_repeated_lines(docs))] == [0, 0, 0]
    more = docs.unionByName(spark.createDataFrame([(7, line)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in rows_of(line_runs.drop_repeated_lines(more))) == [(5, 1), (5, 1), (6, 1), (7, 0)]
    missing = spark.createDataFrame([(None, line), (None, line + "\nmore of it"), (6, line)], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in rows_of(line_runs.drop_repeated_lines(missing))) == 0


def test_lines_of_no_rows(no_docs):
    assert line_runs.drop_repeated_lines(no_docs).count() == 0


def test_runs_compact_and_anti_join(spark):
    """Batches that arrive one by one: unseen lines are inserted, seen ones update the count, and runs are compacted by level."""
    runs = line_runs.LineRuns(spark)
    batch = lambda *ks: spark.createDataFrame([(k, -k, d) for k, d in ks], "h1 long, h2 long, doc_id long")
    steps = [(((1, 90), (2, 90), (2, 80)), set(), [1]), (((2, 70), (3, 70)), {2}, [0, 1]), (((4, 60), (1, 50)), {1}, [1, 1]),
        (((4, 40), (2, 40), (5, 30)), {4, 2}, [0, 0, 1])]
    for rows, seen, levels in steps:
        assert {r.h1 for r in runs.meet(batch(*rows)).where("seen").collect()} == seen
        runs.add(batch(*rows))
        assert [int(bool(x)) for x in runs.levels] == levels
    assert {r.h1: (r.n_docs, r.last_doc) for r in runs.compacted().collect()} == {1: (2, 90), 2: (4, 90), 3: (1, 70), 4: (2, 60), 5: (1, 30)}
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs_")}
    runs.drop()
    assert len(before) == 1 and not [t for t in spark.catalog.listTables() if t.name in before]


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_lines_in_any_number_of_batches(spark, batches):
    rng = random.Random(batches)
    lines = [f"a line of the text with number {k}" for k in range(40)] + ["short", ""]
    docs = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    got = line_runs.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows_of(got)), key=repr) == brute_lines(docs)


# ---- n-gram join


def brute_join(docs, percent=75):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    smallest = {}
    for k, (d, _) in enumerate(sets):
        r = root(k)
        known = [x for x in (smallest.get(r), d) if x is not None]
        smallest[r] = min(known) if known else None
    return sorted(((d, len(s), smallest[root(k)]) for k, (d, s) in enumerate(sets)), key=repr)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=repr)


def test_join_on_odd_rows(odd_docs, no_docs):
    assert joined(odd_docs.withColumns({"node": F.lit(1), "comp": F.lit(2)})) == brute_join([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert joined(no_docs) == []


def test_join_of_large_groups(spark, monkeypatch):
    """Groups over every limit: hot signatures, blocks that meet two by two, salted stars, chained near copies."""
    for name, n in (("BLOCK", 7), ("STAR", 3), ("CHUNK", 500), ("PAIRS", 40), ("HOT_COMPONENTS", 3), ("BUCKET_BYTES", 500)):
        monkeypatch.setattr(ngram_join, name, n)
    import random

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, docs = text(60), text(150), []
    for k in range(25):
        docs.append((100 + k, text(40) + passage + text(40)))  # unrelated, but for a passage
        near = list(base)
        near[rng.randrange(150)] = f"x{k}"
        docs.append((200 + k, near))
        docs.append((300 + k, list(base)))
    chain = text(200)
    for k in range(12):  # each like the next, the ends unlike
        docs.append((400 + k, list(chain)))
        chain[15 * k : 15 * k + 10] = text(10)
    rng.shuffle(docs)
    docs = [(d, " ".join(w)) for d, w in docs]
    assert joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute_join(docs)


@pytest.mark.parametrize("kept", [3, 1])
def test_join_of_sets_whose_hashes_clash(spark, monkeypatch, kept):
    own = ngram_join._set_ids
    monkeypatch.setattr(ngram_join, "_set_ids", lambda h: (own(h)[0] % kept, own(h)[1]))
    docs = [(d, " ".join(f"w{(d // 3) * 1000 + k + d % 3}" for k in range(80))) for d in range(30)]
    assert joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute_join(docs)


def test_join_links_rows_without_a_doc_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "end"])
    docs = [(1, " ".join(base)), (None, near), (None, near + " more"), (None, "a text that is unlike all of the others"),
        (None, "another text that is unlike the rest here"), (2, None), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert joined(df) == brute_join(docs)
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in ngram_join.one_of_each(df).collect()) == [(0, "a text th"), (0, "another t"),
        (1, "w0 w1 w2 "), (2, ""), (2, "")]
    alone = spark.createDataFrame(docs[1:3], "doc_id long, text string")
    assert [(r.n_shingles, r.component_id) for r in ngram_join.join(alone).orderBy("n_shingles").collect()] == [(56, None), (57, None)]
    assert ngram_join.one_of_each(alone).count() == 1
    assert ngram_join.one_of_each(df.limit(0)).count() == 0
    named = df.withColumns({"stay_id": F.lit(1), "stay_text": F.lit(2), "text_hash": F.lit(3), "comp": F.lit(4)})
    assert ngram_join.one_of_each(named).columns == named.columns


@needs_data
def test_join_of_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert joined(docs) == brute_join([(r.doc_id, r.text) for r in docs.collect()])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100, 300: 300, 301: 300, 302: 300}


# ---- language


@needs_data
def test_language_of_held_out_rows(spark):
    got = queries.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98 and got.where("rejected").count() == 0


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(odd_docs.withColumn("score", F.lit("old")), model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.rejected)
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_language_rejects_what_it_has_not_seen(spark, size):
    """Random letters and other languages go and every given document stays, with mislabelled rows in the sample too."""
    if not Path(f"/root/testdata/{size}").exists():
        pytest.skip("the given tables are not here")
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n))
        for n in (12, 15, 30, 60, 100, 300, 1000, 2000, 5000, 20000)]
    unseen = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie, że chrząszcz brzmi w trzcinie.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    ]
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.where("lang = 'en' and length(text) between 200 and 400").orderBy("doc_id").limit(1).select(F.lit(-1).alias("doc_id"), "text",
        F.lit("de").alias("lang"))
    for train in (docs, docs.unionByName(wrong)):
        model = langid.fit(train)
        new = spark.createDataFrame([(t,) for t in junk + unseen], "text string")
        assert [r.text[:50] for r in langid.predict(new, model).where("not rejected").collect()] == []
        assert langid.predict(docs, model).where(F.col("rejected") & F.col("text").rlike(r"\p{L}")).count() == 0


@needs_data
def test_language_equals_brute_force(spark):
    """The whole query against plain nearest centroids: n-grams counted one by one, cosines with every centroid."""
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    known = [r.text for r in docs.where(~langid.held_out() & F.col("lang").isNotNull()).collect()]

    def grams(text):
        t = "".join(c if c.isalpha() else "\0" for c in (text or "").lower())
        t = "\0" + t + "\0"
        out = collections.Counter()
        for n in langid.GRAMS:
            for i in range(len(t) - n + 1):
                if t[i + n // 2] != "\0" if n > 1 else t[i] != "\0":
                    h = 0
                    for k in range(n):
                        h = (h * 0x01000193 + ord(t[i + k]) + k + 1) % 2**32
                    h = h * 0x9E3779B1 % 2**32
                    out[(h ^ h >> 15) % langid.SLOTS] += 1
        return out if any(c.isalpha() for c in t) else None

    seen = [g for t in known if (g := grams(t)) is not None]
    df = collections.Counter(k for g in seen for k in g)
    assert model.idf == pytest.approx([math.log((1 + len(seen)) / (1 + df[k])) + 1 for k in range(langid.SLOTS)], rel=1e-5)
    got = {r.doc_id: r for r in queries.op3_language(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g, mine = grams(r.text), got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if g is None:
            assert (mine.lang_pred, mine.score, mine.rejected) == ("und", 0, True)
            continue
        x = {k: math.log1p(n) * float(model.idf[k]) for k, n in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in model.centroids]
        best = max(cosines)
        assert mine.score == pytest.approx(best, abs=1e-4)
        assert mine.lang_pred in {model.languages[o] for o, c in zip(model.owner, cosines) if c > best - 1e-4}


def test_language_learns_from_text_and_lang_alone(spark):
    rows = [(k, f"the text of row number {'abcdefghij'[k % 10]} and more of it" if k % 2
        else f"der text der zeile {'abcdefghij'[k % 10]} und mehr davon", "en" if k % 2 else "de") for k in range(200)]
    one, two = (langid.fit(spark.createDataFrame([(k * m, t, lang) for k, t, lang in rows],
        "doc_id long, text string, lang string").repartition(n)) for m, n in ((1, 2), (-7, 5)))
    assert (one.centroids == two.centroids).all() and (one.floors == two.floors).all() and one.languages == ["de", "en"]
    many = spark.createDataFrame([(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} text", f"l{k}") for k in range(600)],
        "doc_id long, text string, lang string")
    assert len(langid.fit(many).languages) == 600


# ---- quality rules


def test_quality_counts_of_odd_rows(odd_docs, no_docs):
    def brute(t):
        w = words(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        hit = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    got = sorted((tuple(r[c] for c in ("doc_id", *divergence.BASE)) for r in rows_of(divergence.judge(odd_docs))), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in odd_docs.collect()), key=repr)
    assert divergence.judge(no_docs).count() == 0


@needs_data
def test_quality_keeps_good_and_drops_bad(spark):
    """On the half of the labels that the limits were not fitted to."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = divergence.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"),
        "doc_id").where("not base_failed and doc_id % 2 = 1")
    share = {r["quality"]: r["x"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("x")).collect()}
    assert share[1] > 0.97 and share[0] < 0.35


def test_quality_takes_any_language_and_clashing_names(spark):
    """A language that no list was made for: its common words come from the corpus, and junk in it is told from it."""
    rng = random.Random(6)
    vocabulary = [f"{a}{b}ka" for a in "mntsl" for b in "aeiou"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(25)],
        k=n) + [f"zu{rng.randrange(10**6)}" for _ in range(n // 3)])
    docs = [(k, text(200), "xx") for k in range(60)] + [(99, " ".join("".join(rng.choice("0123456789#$%") for _ in range(6))
        for _ in range(200)), "xx"), (100, text(200), None), (101, None, "yy"), (102, "", "yy")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"words": F.lit(1), "common": F.lit(2), "n": F.lit(3),
        "d": F.lit(4), "kept": F.lit(5), "n_words": F.lit("x")})
    lists = divergence.common_words(df)
    held = collections.Counter(w for _, t, lang in docs if lang and t for w in set(t.split()))
    assert lists == {"xx": [w for w, n in sorted(held.items(), key=lambda x: (-x[1], x[0])) if n >= 0.05 * 61][:24]} and len(lists["xx"]) > 10
    got = {r["doc_id"]: r["kept"] for r in rows_of(divergence.judge(df))}
    assert all(got[k] for k in range(60)) and got[100] and not (got[99] or got[101] or got[102])


# ---- fingerprints


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd_docs.collect()))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.with_next(odd_docs).collect()))
    want = []
    for k, (d, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)
    assert fingerprint.with_next(no_docs).count() == 0 and fingerprint.fingerprints(odd_docs).count() == len(rows)
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprint.with_next(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


@needs_data
def test_fingerprints_of_given_documents(spark):
    """The whole query against sketches and likeness worked out with plain sets."""
    import base64

    def sketch(text):
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        own = {int(fingerprint.shingles(b" ".join(w[i : i + n]).decode())[0]) >> 16 for i in range(len(w) - n + 1)} if w else set()
        low = {x for x in own if x < 2**48 // 4}
        return low or set(sorted(own)[:1])

    def likeness(a, b):
        return float(not a and not b) if not a or not b else len(a & b) / min(len(a), len(b))

    coded = lambda s: base64.b64encode(b"".join(x.to_bytes(6, "big") for x in sorted(s))).decode()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    want, own = {}, [sketch(t) for _, t in docs]
    for k, (d, t) in enumerate(docs):
        edited = t[: len(t) - len(t) // 2] + docs[(k + 1) % len(docs)][1][: len(t) // 2]
        new = sketch(edited)
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), coded(own[k]), coded(new), likeness(own[k], new),
            likeness(own[k], own[(k + 1) % len(docs)]))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
        for r in queries.op5_fingerprint(spark, DATA).collect()}
    assert got == want


def test_fingerprints_of_a_doc_id_with_many_rows(spark, monkeypatch):
    """A missing doc_id of half of all rows is dealt over several ranges, and its rows still follow each other."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 400)
    monkeypatch.setattr(fingerprint, "PIECES", 16)
    docs = spark.range(300).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("some text of row "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("h"), F.lit(2).alias("part"))
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.x, r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("x")).collect())
    want = sorted((d, hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(k + 1) % 300][2][: len(t) // 2]).encode()).hexdigest()) for k,
        (d, _, t) in enumerate(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256) for r in fingerprint.with_next(docs).collect()) == want
    dealt = fingerprint.by_range(docs).where("role = 0").groupBy("part").count().collect()
    assert len(dealt) > 10 and max(r["count"] for r in dealt) < 60
    long = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(F.col("id") < 8, 100).otherwise(1)).alias("text"))
    dealt = fingerprint.by_range(long).where("role = 0").groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()
    assert max(r["n"] for r in dealt) <= 500 + 5 and len(dealt) >= 9


# ---- tokens


def test_tokens_of_odd_rows(odd_docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sp_codec.encode(odd_docs.withColumn("ids", F.lit("old")), MODEL, decoded="decoded")
    for r in got.collect():
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert sp_codec.unpack(bytes(r.ids)) == want and r.decoded == library.decode(want)
    assert sp_codec.encode(no_docs, MODEL).count() == 0
    counts = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in trie_counts.count_tokens(odd_docs.withColumn("n_tokens", F.lit(0)), MODEL).collect()}
    assert counts[4] == counts[5] == counts[8] == (0, 0) and counts[10][0] == 1 and counts[6][0] == 120_000
    assert trie_counts.count_tokens(no_docs, MODEL).count() == 0


@needs_data
def test_token_counts_equal_brute_force(spark):
    """The whole query against a plain Viterbi over each word of each text."""
    scores = trie_counts.zipf_scores(MODEL)

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            raw = len(word[e - 1].encode())
            options = [(best[e - 1][0] + trie_counts.BYTE_SCORE * raw, -best[e - 1][1] - raw)]
            options += [(best[s][0] + scores[word[s:e]], -best[s][1] - 1) for s in range(max(0, e - 20), e) if word[s:e] in scores]
            x = max(options)
            best.append((x[0], -x[1]))
        return best[-1][1]

    assert max(map(len, scores)) <= 20
    docs = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = {w: brute(trie_counts.MARK + w.decode()) for w in {w for ws in docs.values() for w in ws}}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.op4_token_counts(spark, DATA).collect()}
    assert got == {d: (len(ws), sum(counts[w] for w in ws)) for d, ws in docs.items()}


# ---- pages and archives


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "http://a", "<article><p>" + "x" * 200_000 + "</p></article>"), (2, None, "<article><p>" + "x" * 200_000 + "</p></article>"),
        (3, "u", None), (4, "u", ""), (5, "u", "<p>short"), (6, "v", "<p>short"), (7, "w", "y" * 120), (7, "w", "y" * 120), (8, "w", "y" * 120),
            (None, "n", "z" * 300), (9, "é ß", "<p>世界" * 9000), (9, "é ß", "<p>世界" * 9000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_give_back_odd_pages(spark, odd_pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(odd_pages.withColumn("d", F.lit(1)), path)
    got = collections.Counter((r["name"].split(":")[2], r["payload_bytes"], r["payload_digest"], r["kind"],
        (r["refers_to"] or "::").split(":")[2] or None, r["intact"]) for r in rows_of(warc.reassemble(warc.read_records(spark, path))))
    want = collections.Counter()
    rows = odd_pages.collect()
    for r in rows:
        raw = (r.html or "").encode()
        first = min((x.page_id for x in rows if x.page_id is not None and (x.html or "") == (r.html or "")), default=None)
        again = len(raw) >= 100 and r.page_id is not None and first < r.page_id
        want[("" if r.page_id is None else str(r.page_id), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
            str(first) if again else None, True)] += 1
    assert got == want


def test_archives_of_no_pages(spark, odd_pages):
    path = scratch_path(spark, "warc-none")
    warc.write_archives(odd_pages.limit(0), path)
    assert warc.reassemble(warc.read_records(spark, path)).count() == 0


def test_a_missing_segment_is_not_intact(spark, odd_pages):
    path = scratch_path(spark, "warc-cut")
    warc.write_archives(odd_pages.where("page_id = 1"), path)
    records = settle(warc.read_records(spark, path), "records")
    assert records.count() > 2 and [r.intact for r in warc.reassemble(records).collect()] == [True]
    assert [r.intact for r in warc.reassemble(records.where("segment <> 2")).collect()] == [False]


@pytest.mark.parametrize("packed", [False, True])
def test_a_mixed_foreign_archive_loses_nothing(spark, tmp_path, packed):
    """Versions 1.0 and 1.1, plain files that Spark splits and gzip files of several members, broken records, revisits."""
    import gzip

    from test_small_parts import warc_record

    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [warc_record(head + b"page %d WARC/1.0\r\n" % k + b"z" * 300, f"1.{k % 2}", name=f"p{k}") for k in range(200)]
    records.insert(50, warc_record(b"gone", length=99, name="broken"))
    records.insert(0, warc_record(b"software: x", kind="warcinfo", name="info"))
    digest = hashlib.sha256(b"page 3 WARC/1.0\r\n" + b"z" * 300).hexdigest()
    for name, to, said in (("r1", "p3", digest), ("r2", "p4", digest), ("r3", "nowhere", digest)):
        records.append(warc_record(head, kind="revisit", name=name).replace(b"Content-Length",
            f"WARC-Refers-To: <{to}>\r\nWARC-Payload-Digest: sha256:{said}\r\nContent-Length".encode()))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / ("a.warc.gz" if packed else "a.warc")).write_bytes(b"".join(map(gzip.compress, records)) if packed else b"".join(records))
    (folder / ("b.warc.gz" if packed else "b.warc")).write_bytes(gzip.compress(warc_record(head + b"b", name="b")) if packed
        else warc_record(head + b"b", name="b"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r["name"]: r for r in rows_of(warc.reassemble(warc.read_records(spark, str(folder))))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == {f"p{k}" for k in range(200)} | {"broken", "b", "r1", "r2", "r3"}
    assert all(bytes(got[f"p{k}"]["payload"]) == b"page %d WARC/1.0\r\n" % k + b"z" * 300 and got[f"p{k}"]["intact"]
        for k in range(200)) and not got["broken"]["intact"]
    assert (got["r1"]["payload_bytes"], got["r1"]["payload_digest"], got["r1"]["intact"]) == (317, digest, True)
    assert not got["r2"]["intact"] and not got["r3"]["intact"] and got["r3"]["payload_digest"] is None


def test_extraction_of_odd_pages(odd_pages):
    got = rows_of(html_density.extract(odd_pages.withColumn("n_chars", F.lit("old"))))
    assert len(got) == 12 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[1] == 200_000 and {r["page_id"]: r["text"] for r in got}[3] == ""
    assert html_density.extract(odd_pages.limit(0)).count() == 0


@needs_data
def test_extraction_of_given_pages(spark):
    """The whole query against a plain cut: each given page has one article element of headings and paragraphs."""
    import html

    def brute(page):
        page = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", "", page or "", flags=re.S)
        m = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)
        blocks = re.split("\0", re.sub("</?(?:p|h1)>", "\0", re.sub("<br>", " ", m[1]))) if m else []
        return "\n".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks)))

    want = {(r.page_id, r.url, brute(r.html), len(brute(r.html))) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op1_html_density(spark, DATA)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_extraction_keeps_columns_with_clashing_names(spark):
    got = html_density.extract(spark.createDataFrame([("<p>one two", "x", 5)], "html string, text string, chars int"))
    assert got.columns == ["html", "chars", "text", "n_chars"] and got.first().text == "one two"


# ---- mixing


def test_mix_of_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumns({"lane": F.lit(1), "taken": F.lit("old"), "end": F.lit(3), "row": F.lit(4)})
    got = rows_of(mixing.mix(docs))
    assert len(got) == 14 and all(r["size"] == len(words(r["text"])) and r["taken"] % max(1, r["size"]) == 0
        and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert mixing.mix(no_docs).count() == 0


def test_mix_comes_near_targets_and_repeats(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = [sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (2, 9)]
    assert got[0] == got[1]
    by = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(by) == 8 and all(abs(r.taken - r.target) <= 40 for r in by)


def test_mix_of_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a"] if k % 3 == 0 else ["b"] if k % 3 == 1 else ["b", "a", "a"]) for k in range(300)]
    got = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")))
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * 3000, abs=40)


# ---- SQL twins


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [sql.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()),
        key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)
