"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with those of the corpus's languages by
Jensen-Shannon distance (base 2, 0 to 1). A language's common words are the WORDS that most of its documents hold, of those
that a SHARE of them hold; its references are the mean histograms of its documents that pass the base rules. So both follow
the data, whatever the languages. A document passes if one language is near enough in both histograms. Documents with fewer
than MIN_WORDS words fail the base rules; short ones skip the comparisons that are too noisy for their length. Everything is
DataFrame functions, and no text is shuffled: common words are counted within each row.

A null text has no words and fails. Repeated rows are judged alike. A null lang adds to no reference; with no reference at
all (an empty table, no known language) the distances are null and only the base rules decide. Columns of the input other
than doc_id, text and lang are not used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, SPACES, settle

#: Common words of a language, part of its documents that hold each, and buckets of words in which that part is looked for.
WORDS, SHARE, BUCKETS = 24, 0.05, 65_536
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Guards and limits of the divergence rules, fitted to one half of the labelled documents and measured on the other: from
#: LONG_WORDS words both histograms count, from SHORT_WORDS words the character classes alone with a wider limit, below neither.
LONG_WORDS, MAX_CLASS_LONG, MAX_WORD_LONG = 120, 0.2, 0.26
SHORT_WORDS, MAX_CLASS_SHORT = 30, 0.32
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
_MARKS = "aA0 .#"
_FROM = string.ascii_lowercase + string.ascii_uppercase + string.digits + SPACES + PUNCTUATION + SYMBOLS
_TO = "a" * 26 + "A" * 26 + "0" * 10 + " " * 6 + "." * len(PUNCTUATION) + "#" * len(SYMBOLS)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _equal_neighbour(run: str, x: Column, i: Column) -> Column:
    near = lambda k: F.coalesce(F.get(run, i + k)["h"] == x["h"], F.lit(False))
    return near(-1) | near(1)


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """By language: the words that most of its documents hold, the commonest first, equal ones in their order.

    A word that a SHARE of the documents holds is in a bucket of words that counts as many or more; only words of such buckets
    are counted one by one, so the vocabulary is never shuffled."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("docs")))  # a row for each language
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    words = known.select("lang", _words(F.col("text")).alias("words"))
    pairs = words.select("lang", F.explode(F.array_distinct("words")).alias("w")).withColumn("b", bucket(F.col("w")))
    held = words.select("lang", F.explode(F.array_distinct(F.transform("words", bucket))).alias("b"))
    often = F.col("n") >= SHARE * F.col("docs")
    full = held.groupBy("lang", "b").agg(F.count("*").alias("n")).join(sizes, "lang").where(often).select("lang", "b")
    counts = pairs.join(F.broadcast(full), ["lang", "b"]).groupBy("lang", "w").agg(F.count("*").alias("n"))  # BUCKETS a language at most
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counts.join(sizes, "lang").where(often).withColumn("place", F.row_number().over(best)).where(F.col("place") <= WORDS)
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "place").collect():  # WORDS a language at most
        out.setdefault(r["lang"], []).append(r["w"])
    return out


def features(docs: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """One row per document: base counts, character classes and the counts of the common words of all languages."""
    listed = sorted({w for ws in lists.values() for w in ws})
    cut = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    cut = cut.select(
        "doc_id", "lang", _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("lines"), F.length("text").alias("chars"),
            F.translate("text", _FROM[26:] + _FROM[:26], _TO[26:]).alias("rest0"),  # without lower-case letters
    )
    none = F.array().cast("array<string>")
    common = F.sort_array(F.filter("words", lambda w: w.isin(listed))) if listed else none
    cut = cut.select("*", F.size("words").alias("n"), common.alias("common"))
    # the sorted common words: where each begins, and so how many there are
    places = F.when(F.size("common") > 0, F.sequence(F.lit(0), F.size("common") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | (F.get("common", i - 1) != F.get("common", i)))
    cut = cut.select("*", first.alias("first"))
    # windows found twice: hashes of all windows, sorted with their places only where any is repeated
    cut = cut.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("w1"))
    starts = F.sequence(F.lit(0), F.col("n") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("w1", i + k) for k in range(WINDOW)]))
    cut = cut.select("*", F.when(F.col("n") >= WINDOW, windows).alias("windows"))
    cut = cut.select("*", F.when(F.size("windows") != F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("run"))
    cut = cut.select("*", F.sort_array(F.transform(F.filter("run", lambda x, i: _equal_neighbour("run", x, i)), lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("at", i - 1)))),
        F.lit(0), lambda a, x: a + x)
    # characters by class: the text gets shorter with each class that is counted, the commonest ones first
    order = [CLASSES[0], "space", *[c for c in CLASSES[1:-1] if c != "space"]]
    marks = dict(zip(CLASSES, _MARKS))
    for k, c in enumerate(order[1:]):
        cut = cut.select("*", F.replace(f"rest{k}", F.lit(marks[c]), F.lit("")).alias(f"rest{k + 1}"))
    left = [F.col("chars"), *[F.length(f"rest{k}") for k in range(len(order))]]
    classes = cut.select("*", *[(x - y).alias(c) for c, x, y in zip(order, left, left[1:])])
    return classes.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), (F.col("chars") - F.col("space")).cast("long").alias("word_chars"),
            F.col("symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*CLASSES[:-1], left[-1]).alias("classes"),
        F.transform("first", lambda x, k: F.struct(F.get("common", x).alias("w"),
            (F.coalesce(F.get("first", k + 1), F.size("common")) - x).alias("c"))).alias("common"),
    )


def references(feats: DataFrame, lists: dict[str, list[str]]) -> dict[str, tuple[list[float], list[float]]]:
    """By language: the mean shares of the character classes, and of its common words and all other words, over all
    documents that pass the base rules; each document weighs the same."""
    n = F.col("n_words")
    known = feats.where(F.col("lang").isin(list(lists)) & ~failed_base())
    share = lambda k: F.get("classes", F.lit(k)) / F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    sums = known.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(share(k)).alias(f"c{k}") for k in range(len(CLASSES))])
    words = known.select("lang", "n_words", F.explode("common").alias("x")).groupBy("lang", "x.w").agg(F.sum(F.col("x.c") / n).alias("c"))
    sums, words = sums.orderBy("lang").collect(), {(r["lang"], r["w"]): r["c"] for r in words.collect()}
    out = {}
    for r in sums:
        own = [words.get((r["lang"], w), 0.0) / r["n"] for w in lists[r["lang"]]]
        out[r["lang"]] = [round(r[f"c{k}"] / r["n"], 9) for k in range(len(CLASSES))], [round(x, 9) for x in [*own, max(0.0, 1 - sum(own))]]
    return out


def _part(x: Column, y: Column) -> Column:
    """What a pair of shares adds to the Jensen-Shannon divergence, base 2."""
    half = lambda a: F.when(a > 0, a * F.log2(a * 2 / (x + y))).otherwise(0.0)
    return (half(x) + half(y)) / 2


def _known(refs: dict[str, tuple[list[float], list[float]]], lists: dict[str, list[str]]) -> Column:
    """The references as a constant array, a struct for each language. A word that a document lacks adds half its share to the
    divergence, so 'absent' is the sum for none of the words, and a document is charged for those alone that it holds."""
    of = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.array(*[
        F.struct(F.lit(lang).alias("lang"), of(classes).alias("classes"), F.map_from_arrays(of(lists[lang]), of(words[:-1])).alias("words"),
            F.lit(words[-1]).alias("rest"), F.lit(sum(words[:-1]) / 2).alias("absent"))
        for lang, (classes, words) in refs.items()
    ])


def _distances(ref: Column) -> Column:
    """Jensen-Shannon distances of a row's common words and character shares from a language's."""
    n = F.col("n_words")

    def step(acc: Column, x: Column) -> Column:
        q = F.try_element_at(ref["words"], x["w"])
        return F.when(q.isNull(), acc).otherwise(F.struct((acc["own"] + x["c"]).alias("own"), (acc["sum"] + _part(x["c"] / n, q) - q / 2).alias("sum")))

    words = F.aggregate("common", F.struct(F.lit(0).cast("long").alias("own"), ref["absent"].alias("sum")), step,
        lambda acc: acc["sum"] + _part((n - acc["own"]) / n, ref["rest"]))
    classes = F.aggregate(F.zip_with("shares", ref["classes"], _part), F.lit(0.0), lambda acc, x: acc + x)
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return F.struct(root(words).alias("word"), root(classes).alias("class"), ref["lang"].alias("lang"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance and word_distance to the nearest language, and kept."""
    lists = common_words(docs)
    feats = settle(features(docs, lists), "features")
    refs = references(feats, lists)
    n = F.col("n_words")
    near = feats.select("*", F.aggregate("classes", F.lit(0), lambda a, x: a + x).alias("chars"))
    near = near.select("*", F.transform("classes", lambda x: x / F.col("chars")).alias("shares"), failed_base().alias("base_failed"))
    nothing = F.array().cast("array<struct<word:double,class:double,lang:string>>")
    near = near.select("*", F.when(n > 0, F.transform(_known(refs, lists), _distances) if refs else nothing).otherwise(nothing).alias("d"))
    passes = lambda f: F.exists("d", f) | (F.size("d") == 0)
    both = passes(lambda x: (x["class"] <= MAX_CLASS_LONG) & (x["word"] <= MAX_WORD_LONG))
    fine = F.when(n >= LONG_WORDS, both).when(n >= SHORT_WORDS, passes(lambda x: x["class"] <= MAX_CLASS_SHORT)).otherwise(True)
    near = near.select("doc_id", *BASE, "base_failed", F.array_min("d").alias("best"), (~F.col("base_failed") & fine).alias("kept"))
    told = [F.col("best.class").alias("class_distance"), F.col("best.word").alias("word_distance"), F.col("best.lang").alias("nearest")]
    return near.select("doc_id", *BASE, "base_failed", *told, "kept")
