"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that hold the line and the
largest doc_id among them. Batches come by doc_id from the largest down. Each meets the runs by a merge join of their buckets:
a line that no run holds (the anti-join) is new, and its largest doc_id in the batch is the one that keeps it for good; of a
line that a run holds only the number of documents goes on. What the batch adds becomes a run of level 0; two runs of a level
are compacted into one of the next by a merge join of their buckets, which needs no shuffle. Only the batch moves, never the
history. When all batches are in, lines of enough documents go everywhere but in the document that brought them.

Rows that repeat a doc_id are one document, whatever their texts; rows without one are one too, smaller than any other. A null or empty text is one empty
line. Lines of repeated rows with the largest doc_id stay in each of them. Input columns pass through, those named as a
result column are replaced; an empty table gives an empty table. Everything is DataFrame functions.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACES, scratch_path, settle

#: Code points of a key from which lines count, documents that must hold it, batches that the input is dealt into.
MIN_CHARS, MIN_DOCS, BATCHES = 20, 3, 4
#: Line rows of a bucket of the runs (there are as many buckets as shuffle partitions at least), and the most buckets that Spark
#: takes: from 4 x 10^11 line rows on they grow.
BUCKET_ROWS, MAX_BUCKETS = 4_000_000, 100_000
#: At most so many keys are hot: a key is, if it holds at least that part of all line rows. Bounds what is broadcast.
HOT_KEYS = 2_000
#: Stands for a missing doc_id: below every long that occurs as one.
NO_DOC = -(2**63)


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _two_hashes(*cols: Column) -> tuple[Column, Column]:
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, last_doc), kept as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, rows: int = 0):
        """rows: of lines that are to come."""
        self.spark, self.levels = spark, []
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(MAX_BUCKETS, max(self.tasks, -(-rows // BUCKET_ROWS)))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        if self.buckets > self.tasks:  # else the join or aggregation before has dealt the rows by bucket
            run = run.repartition(self.buckets, "h1", "h2")
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", scratch_path(self.spark, table)).saveAsTable(table)
        return table

    def meet(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with seen: whether a run holds the line. Where it is false, this is the merge anti-join."""
        seen = F.lit(False)
        for k, run in enumerate(filter(None, self.levels)):
            held = self.spark.table(run).select("h1", "h2", F.lit(True).alias(f"_held{k}"))
            keys = keys.join(held, ["h1", "h2"], "left")
            seen = seen | F.coalesce(f"_held{k}", F.lit(False))
        return keys.withColumn("seen", seen).drop(*[f"_held{k}" for k in range(len(self.levels))])

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (h1, h2, doc_id), one row for each document and line, and compacts full levels. No doc_id of a batch
        is larger than those of the batches before."""
        keys = self.meet(lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        run = self._write(keys.select("h1", "h2", "n_docs", F.when(~F.col("seen"), F.col("last_doc")).alias("last_doc")))
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append(None)
            if self.levels[level] is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self._compact(self.levels[level], run), None
            level += 1

    def _compact(self, a: str, b: str) -> str:
        old, new = self.spark.table(a).alias("a"), self.spark.table(b).alias("b")
        merged = old.join(new, ["h1", "h2"], "full_outer").select(
            "h1", "h2", (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
                F.coalesce("a.last_doc", "b.last_doc").alias("last_doc")
        )
        table = self._write(merged)
        for name in (a, b):
            self.spark.sql(f"DROP TABLE {name}")
        return table

    def compacted(self) -> DataFrame | None:
        """All runs as one; None before the first batch."""
        runs = [r for r in self.levels if r]
        while len(runs) > 1:
            runs = [self._compact(runs[0], runs[1]), *runs[2:]]
        self.levels = runs
        return self.spark.table(runs[0]) if runs else None

    def drop(self) -> None:
        """Takes the runs out of the catalog."""
        for run in filter(None, self.levels):
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with text replaced by what remains, and n_lines and n_dropped (long).

    Lines whose key has min_chars code points or more and is in min_docs documents or more go, except in the largest
    doc_id that holds it. The hashed lines are written once; texts are shuffled once, by their own row's hash.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    r1, r2 = _two_hashes(F.col("doc_id"), F.col("text"))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c != "text"]).alias("row"), "doc_id",
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), r1.alias("r1"), r2.alias("r2"))
    keys = F.transform("lines", line_key)
    h1, h2 = _two_hashes(F.col("key"))
    at = src.select("r1", "r2", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"),
        F.posexplode(keys).alias("pos", "key")).where(F.length("key") >= min_chars)
    parts = F.array(*[F.lit(k / batches) for k in range(1, batches)]) if batches > 1 else F.array(F.lit(1.0))
    cuts = docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), parts)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))  # 0 for the largest doc_ids
    hashed = settle(at.select("r1", "r2", "doc_id", "pos", h1.alias("h1"), h2.alias("h2"), batch.alias("batch")), "lines")
    total = hashed.count()
    runs = LineRuns(docs.sparkSession, total)
    try:
        for k in range(len(cuts) + 1):
            runs.add(hashed.where(F.col("batch") == k).select("h1", "h2", "doc_id").distinct())  # a document counts once for a line
        run = settle(runs.compacted().where(F.col("n_docs") >= min_docs), "repeated")
    finally:
        runs.drop()
    hot_from = max(min_docs, -(-total // HOT_KEYS))
    hot = F.broadcast(run.where(F.col("n_docs") >= hot_from))  # sum(n_docs) <= total, so these are HOT_KEYS keys at most
    rest = hashed.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(run.where(F.col("n_docs") < hot_from), ["h1", "h2"])
    gone = hashed.join(hot, ["h1", "h2"]).unionByName(rest).where(F.col("doc_id") < F.col("last_doc"))
    # a row's own lines only: repeated rows are alike and share an entry
    gone = gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))
    left = src.join(gone, ["r1", "r2"], "left")
    none = F.array().cast(T.ArrayType(T.IntegerType()))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return left.select(*[F.col(f"row.`{c}`") if c != "text" else text.alias("text") for c in keep],
        F.size("lines").cast("long").alias("n_lines"), F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"))
