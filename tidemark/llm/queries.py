"""The registered queries of the corpus operators: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    divergence,
    filter_audit,
    fingerprint,
    html_density,
    langid,
    line_runs,
    mixing,
    ngram_join,
    simhash,
    sp_codec,
    token_align,
    trie_counts,
    warc,
)
from tidemark.llm.common import scratch_path, sha256_utf8, table

MODEL = "piece_bpe_32k.model"


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents")).select("doc_id", *divergence.BASE, "base_failed", "kept")


def _op2_sql() -> str:
    """The rules in DuckDB SQL, made from the constants of the operator."""
    d = divergence
    marks = dict(zip(d.CLASSES, d._MARKS))
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    visible = "".join(c for c in d._FROM if c not in "\t\n\x0b\x0c\r")
    image = "".join(t for f, t in zip(d._FROM, d._TO) if f not in "\t\n\x0b\x0c\r")
    shape = f"translate(regexp_replace(t, '[\t\n\x0b\x0c\r]', ' ', 'g'), {quote(visible)}, {quote(image)})"
    of = lambda c: f"length(s) - length(replace(s, {quote(marks[c])}, ''))"
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} * 2 / ({a} + {b})) ELSE 0 END"
    jsd = lambda a, b: f"sqrt(greatest(sum(({half(a, b)} + {half(b, a)}) / 2), 0))"
    pairs = ", ".join(f"({k}, {quote(c)})" for k, c in enumerate(d.CLASSES))
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, {shape} AS s FROM t),
win AS (SELECT doc_id, i, ws[i:i + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE
    regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
cls AS (SELECT doc_id, unnest([{", ".join(of(c) for c in d.CLASSES[:-1])}, length(s) - ({" + ".join(of(c) for c in d.CLASSES[:-1])})]) AS c,
    generate_subscripts([{", ".join("0" for _ in d.CLASSES)}], 1) - 1 AS k, length(s) AS chars FROM w),
base AS (SELECT w.doc_id, w.lang, len(ws) AS n_words, length(s) - ({of("space")}) AS word_chars, {of("symbol")} AS n_symbols,
    coalesce(line.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
         FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
judged AS (SELECT *, n_words < {d.MIN_WORDS} OR 100 * n_repeat_words > {d.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base),
held AS (SELECT lang, unnest(list_distinct(ws)) AS word FROM w WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE text
    IS NOT NULL)),
docs AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
list AS (SELECT lang, word, CAST(place - 1 AS INTEGER) AS k FROM (SELECT held.lang, word, row_number() OVER (PARTITION BY held.lang ORDER BY
    count(*) DESC, encode(word)) AS place
         FROM held JOIN docs USING (lang) GROUP BY held.lang, word, docs HAVING count(*) >= {d.SHARE} * docs) WHERE place <= {d.WORDS}),
size AS (SELECT lang, count(*) AS size FROM list GROUP BY lang),
good AS (SELECT * FROM judged WHERE NOT base_failed AND lang IN (SELECT lang FROM size)),
n AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
qc AS (SELECT lang, k, round(sum(c / chars) / any_value(n.n), 9) AS q FROM cls JOIN good USING (doc_id) JOIN n USING (lang) GROUP BY lang, k),
cnt AS (SELECT doc_id, x AS word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) WHERE x IN (SELECT word FROM list) GROUP BY doc_id, x),
qw0 AS (SELECT list.lang, list.k, coalesce(sum(cnt.c / good.n_words) / any_value(n.n), 0) AS q FROM list JOIN n USING (lang) JOIN good USING
    (lang) LEFT JOIN cnt ON cnt.doc_id = good.doc_id AND cnt.word = list.word GROUP BY list.lang, list.k),
qw AS (SELECT lang, k, round(q, 9) AS q FROM qw0 UNION ALL SELECT qw0.lang, any_value(size), round(greatest(0, 1 - sum(q)), 9) FROM qw0 JOIN
    size USING (lang) GROUP BY qw0.lang),
pw0 AS (SELECT j.doc_id, list.lang, list.k, coalesce(cnt.c, 0) / j.n_words AS p, coalesce(cnt.c, 0) AS c, j.n_words FROM judged j JOIN list
    ON j.n_words > 0 JOIN n ON n.lang = list.lang LEFT JOIN cnt ON cnt.doc_id = j.doc_id AND cnt.word = list.word),
pw AS (SELECT doc_id, lang, k, p FROM pw0 UNION ALL SELECT doc_id, pw0.lang, any_value(size), (any_value(n_words) - sum(c)) /
    any_value(n_words) FROM pw0 JOIN size USING (lang) GROUP BY doc_id, pw0.lang),
dw AS (SELECT doc_id, lang, {jsd("p", "q")} AS d FROM pw JOIN qw USING (lang, k) GROUP BY doc_id, lang),
dc AS (SELECT cls.doc_id, qc.lang, {jsd("(c / chars)", "q")} AS d FROM cls JOIN qc USING (k) WHERE chars > 0 GROUP BY cls.doc_id, qc.lang),
near AS (SELECT doc_id, bool_or(dc.d <= {d.MAX_CLASS_LONG} AND dw.d <= {d.MAX_WORD_LONG}) AS near_both, bool_or(dc.d <= {d.MAX_CLASS_SHORT})
    AS near_class FROM dw JOIN dc USING (doc_id, lang) GROUP BY doc_id)
SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(CASE WHEN n_words >= {d.LONG_WORDS} THEN near_both WHEN n_words >= {d.SHORT_WORDS} THEN near_class END,
    true) AS kept
FROM judged j LEFT JOIN near USING (doc_id)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_counts.count_tokens(docs, public_tokenizers.path(MODEL)).drop("text")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_utf8(F.col("text")).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''),
    chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id < k.last_doc AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS
    i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(low.y, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN low ON low.x = t.doc_id
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sp_codec.encode(docs, public_tokenizers.path(MODEL), decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        sha256_utf8(F.col("decoded")).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.reassemble(warc.read_records(spark, path), keep_payload=False)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d*)", 1).try_cast("long")
    return back.select(page("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        page("refers_to").alias("refers_to"), "intact")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first < p.page_id THEN g.first END AS refers_to, true AS intact
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS src, source IS NULL AS none, coalesce(len(regexp_extract_all(text,
    '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5('mix:' || doc_id) AS h FROM documents),
s AS (SELECT src, none, sum(size) AS size FROM d GROUP BY src, none),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY none, encode(src)) - 1) % 3 AS INTEGER) + 1] AS w FROM s),
o AS (SELECT *, 2.0 * size / w AS stop, coalesce(sum(2 * size) OVER r, 0) AS full_before, sum(w) OVER (ORDER BY 2.0 * size / w, src ROWS
    BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, 1.5 * sum(size) OVER () AS total
      FROM w WINDOW r AS (ORDER BY 2.0 * size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((total - full_before) / w_left, stop) FILTER ((total - full_before) / w_left <= stop) AS x FROM o),
t AS (SELECT src, none, size AS source_size, CASE WHEN stop <= x THEN 2.0 * size ELSE w * x END AS target FROM o, level),
p AS (SELECT *, CAST(least(CASE WHEN abs(target - floor(target) - 0.5) < 1e-9 AND floor(target) % 2 = 0 THEN floor(target) ELSE
    round(target) END, 2 * source_size) AS BIGINT) AS quota FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size = 0 THEN 0 ELSE quota // p.source_size END AS passes, CASE
    WHEN p.source_size = 0 THEN 0 ELSE quota % p.source_size END AS rest,
        sum(d.size) OVER (PARTITION BY d.src, d.none ORDER BY h, d.doc_id) AS upto FROM d JOIN p ON d.src = p.src AND d.none = p.none)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (passes + CASE WHEN upto - size < rest AND (upto <= rest OR upto - rest <= rest - upto + size) THEN 1 ELSE 0 END) AS
    BIGINT) AS taken
FROM q
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
m AS (SELECT part, concat(CASE WHEN len(ws) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS f,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, f),
l AS (SELECT unnest(string_split('ABCDE', '')) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT o, k, substr(o, k, 1) AS l, substr(o, 1, k - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, o, k, l, sum(n) FILTER (NOT was AND NOT fails) AS kept, sum(n) FILTER (NOT was AND fails) AS removed,
        sum(n) FILTER (was AND fails) AS redundant, sum(n) FILTER (f = l) AS unique_fails, sum(g) FILTER (NOT was AND fails) AS good_lost,
        sum(x) FILTER (NOT was AND fails) AS toxic_lost
      FROM (SELECT *, contains(f, l) AS fails, translate(f, before, '') <> f AS was FROM c, s) GROUP BY part, o, k, l)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS
    removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) AS shapley
FROM r
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return token_align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_density": op1_html_density, "op2_divergence": op2_divergence, "op3_language": op3_language,
        "op4_token_counts": op4_token_counts, "op5_fingerprint": op5_fingerprint, "op6_line_dedup": op6_line_dedup,
            "op7_ngram_join": op7_ngram_join, "op8_sentencepiece": op8_sentencepiece, "op9_warc": op9_warc, "op10_mixing": op10_mixing,
        "op11_filter_audit": op11_filter_audit, "op12_simhash": op12_simhash, "op13_token_align": op13_token_align}


def oracle_sql() -> dict[str, str]:
    return {"op2_divergence": _op2_sql(), "op6_line_dedup": OP6_SQL, "op7_ngram_join": OP7_SQL, "op9_warc": OP9_SQL, "op10_mixing": OP10_SQL,
        "op11_filter_audit": OP11_SQL}
