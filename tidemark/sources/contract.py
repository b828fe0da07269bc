"""Ingestion of the four source files under a contract: fixed columns, types and order, with lineage and a manifest.

A file that breaks the contract stops the build with what differs; nothing is repaired silently. Blank lines hold no row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The contract.
EVENTS = T.StructType([T.StructField("timestamp", T.LongType(), False), T.StructField("visitorid", T.LongType(), False),
    T.StructField("event", T.StringType(), False), T.StructField("itemid", T.LongType(), False), T.StructField("transactionid", T.LongType())])
PROPERTIES = T.StructType([T.StructField("timestamp", T.LongType(), False), T.StructField("itemid", T.LongType(), False),
    T.StructField("property", T.StringType(), False), T.StructField("value", T.StringType())])
CATEGORIES = T.StructType([T.StructField("categoryid", T.LongType(), False), T.StructField("parentid", T.LongType())])
CONTRACT = {"events": (EVENTS, ["events.csv"]), "item_properties": (PROPERTIES, ["item_properties_part1.csv", "item_properties_part2.csv"]),
    "category_tree": (CATEGORIES, ["category_tree.csv"])}
INTERPRETABLE = ("categoryid", "available")
#: Where a raw row comes from: file, the first byte of its block, its place in the order of the scan; and its line, if it has
#: not as many cells as the contract has columns.
LINEAGE = ("source_file", "block", "place", "bad_line")
#: Differences that the error names; file blocks up to which their table is broadcast.
SHOWN, FEW_BLOCKS = 10, 100_000


class ContractError(ValueError):
    """A source file differs from the contract; the message lists the differences."""


def _header(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.text(path).limit(1).collect()
    return row[0][0].split(",") if row else []


def scan(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """The raw rows of a source: its columns as text, and LINEAGE. Raises ContractError on a wrong header."""
    schema, files = CONTRACT[source]
    paths = [f"{folder}/{f}" for f in files]
    found = {p: _header(spark, p) for p in paths}
    if wrong := {p: h for p, h in found.items() if h != schema.names}:
        raise ContractError("; ".join(f"{p}: columns {h}, expected {schema.names}" for p, h in wrong.items()))
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField("bad_line", T.StringType())])
    # without column pruning, as Spark compares the number of cells only where it parses all of them
    raw = spark.read.schema(text).options(header=True, enforceSchema=False, columnNameOfCorruptRecord="bad_line", columnPruning=False).csv(paths)
    return raw.select(*schema.names, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "bad_line")


def numbered(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of raw with row, their number among all data rows of their file, from 1. Blocks are counted, and a row's place in its
    block follows from its place in the scan: no task numbers all rows, and rows are not shuffled."""
    blocks = raw.groupBy("source_file", "block").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    blocks = blocks.select("source_file", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    if blocks.count() <= FEW_BLOCKS:
        blocks = F.broadcast(blocks)
    return rows.join(blocks, ["source_file", "block"]).withColumn("row", F.col("place") + F.col("_shift")).drop("_shift")


def _broken(f: T.StructField) -> Column:
    value = F.col(f.name)
    return value.isNotNull() & value.try_cast(f.dataType).isNull() | (F.lit(not f.nullable) & value.isNull())


def differences(raw: DataFrame, source: str) -> DataFrame:
    """(source, source_file, block, row, problem, column, value, line): every cell, and every row as a whole, that breaks the contract.

    cells: the row has too few or too many, as with an unquoted comma or a quote that does not end; quote: a quote is left within a
    cell; type: the cell is not of its column's type; empty: it may not be."""
    fields = CONTRACT[source][0].fields
    problem = lambda name, column, value: F.struct(F.lit(name).alias("problem"), F.lit(column).cast("string").alias("column"),
        value.alias("value"))
    whole = F.when(F.col("bad_line").isNotNull(), problem("cells", None, F.lit(None).cast("string")))
    cells = [F.when(F.col("bad_line").isNull(), F.when(F.col(f.name).contains('"'), problem("quote", f.name, F.col(f.name)))
        .when(_broken(f) & F.col(f.name).isNull(), problem("empty", f.name, F.col(f.name))).when(_broken(f), problem("type", f.name, F.col(f.name))))
        for f in fields]
    bad = raw.withColumn("x", F.explode(F.filter(F.array(whole, *cells), lambda x: x.isNotNull())))
    line = F.coalesce("bad_line", F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in fields]))
    bad = bad.select("source_file", "block", "place", "x.*", line.alias("line"))
    return numbered(raw, bad).select(F.lit(source).alias("source"), "source_file", "block", "row", "problem", "column", "value", "line")


def check(raw: DataFrame, source: str, diff: str | None = None) -> DataFrame:
    """raw, or ContractError with the number of differences by problem and column, and the first ones. All of them are written to
    diff, where it is given."""
    fields = CONTRACT[source][0].fields
    wrong = [F.col("bad_line").isNotNull(), *[_broken(f) | F.coalesce(F.col(f.name).contains('"'), F.lit(False)) for f in fields]]
    if not raw.where(F.coalesce(*[F.when(w, True) for w in wrong], F.lit(False))).limit(1).count():
        return raw
    found = differences(raw, source)
    if diff:
        found.write.mode("append").parquet(diff)
    counts = found.groupBy("problem", "column").count().orderBy("problem", "column").collect()  # few
    first = found.orderBy("source_file", "row", "column").limit(SHOWN).collect()
    raise ContractError(f"{source}: " + ", ".join(f"{r['count']} x {r['problem']}" + f" of {r['column']}" * bool(r["column"]) for r in counts) + "; first: "
        + "; ".join(f"{r['source_file']} row {r['row']} (block {r['block']}): {r['line']!r}" for r in first))


def typed(raw: DataFrame, source: str) -> DataFrame:
    """Raw rows with the contract's types. A row that breaks the contract stops the job that reads it."""
    cells = []
    for f in CONTRACT[source][0].fields:
        wrong = F.concat(F.lit(f"{source}: {f.name} breaks the contract: "), F.coalesce(F.col("bad_line"), F.col(f.name), F.lit("empty")))
        bad = F.col("bad_line").isNotNull() | _broken(f)
        cells.append(F.when(bad, F.raise_error(wrong).cast(f.dataType)).otherwise(F.col(f.name).try_cast(f.dataType)).alias(f.name))
    return raw.select(*cells, *LINEAGE[:3])


def read(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """The typed rows of a source with source_file, after a pass that raises ContractError with what breaks the contract."""
    return typed(check(scan(spark, folder, source), source), source).drop("block", "place")


def events(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Raw event rows, typed, with UTC time, the day in the zone of the analysis, quality flags and a stable event_id: the row's number
    in its file. Exact duplicates after the first are flagged, never dropped; they are found by counting, not by ordering equal rows."""
    columns = EVENTS.names
    rows = numbered(raw, typed(raw, "events")).withColumnRenamed("row", "event_id")
    key = F.struct(*columns)
    same = rows.groupBy(*columns).agg(F.min("event_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(key.alias("_key"), "_first")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("timestampadd(MILLISECOND, timestamp, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    return rows.join(same, key.eqNullSafe(F.col("_key")), "left").withColumns({
        "is_exact_duplicate": F.coalesce(F.col("event_id") > F.col("_first"), F.lit(False)), "event_time_utc": F.timestamp_millis("timestamp"),
        "us": F.col("timestamp") * 1000, "d": F.to_date(local),
        "is_known_event": F.col("event").isin("view", "addtocart", "transaction"), "has_transaction_id": F.col("transactionid").isNotNull(),
    }).drop("_key", "_first", "block", "place")


def read_events(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """events() of the source file, after the check of the contract."""
    return events(check(scan(spark, folder, "events"), "events"), zone)


def properties(raw: DataFrame) -> DataFrame:
    """Raw property rows, typed, with provenance and the category value as a number; a value that is none is flagged."""
    number = F.when(F.col("property") == "categoryid", F.col("value").try_cast("long"))
    return typed(raw, "item_properties").drop("block", "place").withColumns({"categoryid": number,
        "is_bad_category": (F.col("property") == "categoryid") & F.col("value").isNotNull() & number.isNull(),
        "is_interpretable": F.col("property").isin(*INTERPRETABLE)})


def read_properties(spark: SparkSession, folder: str, items: DataFrame | None = None) -> DataFrame:
    """Both parts as one. With items, only their rows are typed and checked, in one scan: the join is part of the scan's stage
    where items are few."""
    raw = scan(spark, folder, "item_properties")
    if items is None:
        return properties(check(raw, "item_properties"))
    wanted = items.select(F.col("itemid").cast("string").alias("itemid")).distinct()
    return properties(raw.join(wanted, "itemid", "left_semi").select(*raw.columns))


#: Bytes that the line reader leaves out at the start of a file.
_MARK = b"\xef\xbb\xbf"


def _digests(lines: DataFrame) -> DataFrame:
    """(file, sha256, rows) of each file from its lines (file, size, line), which come in order: a task reads a file whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def close() -> None:
            file, size, n, rows, total, plain, marked = now
            missing = size - total
            own = marked if missing >= len(_MARK) else plain
            if missing in (1, 1 + len(_MARK)):  # the last line ends with a line feed
                own.update(b"\n")
            found.append((file, own.hexdigest(), rows))

        for b in batches:
            for file, size, line in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != file:
                    if now:
                        close()
                    now = [file, size, 0, -1, -1, hashlib.sha256(), hashlib.sha256(_MARK)]
                piece = (b"\n" if now[2] else b"") + line
                now[2] += 1
                now[3] += bool(line.strip(b"\r"))  # blank lines hold no row; the first line is the header
                now[4] += len(line) + 1
                now[5].update(piece)
                now[6].update(piece)
        if now:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()))],
            names=["file", "sha256", "rows"])

    return lines.mapInArrow(run, "file string, sha256 string, rows long")


def hashed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """_digests of the files. A session of its own reads each file as one split, so its lines come to one task in their order: nothing
    is shuffled, sorted or held; SHA-256 goes through the bytes of a file one after the other by nature."""
    own = spark.newSession()
    for key, value in (("maxPartitionBytes", 1 << 60), ("openCostInBytes", 1 << 59), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{key}", str(value))
    m = F.col("_metadata")
    lines = own.read.option("lineSep", "\n").text(paths)
    return _digests(lines.select(m["file_name"].alias("file"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("line")))


def manifest(spark: SparkSession, folder: str, expected: dict[str, int] | None = None, commit: str | None = None) -> DataFrame:
    """One row per source file: path, bytes, SHA-256, modification time, data rows, expected rows (by file name, where given)
    and whether they agree, ingest time and code version. Any size of file: it is read as lines and hashed as a stream."""
    files = [(s, f, (expected or {}).get(f)) for s, (_, names) in CONTRACT.items() for f in names]
    paths = [f"{folder}/{f}" for _, f, _ in files]
    named = spark.createDataFrame(files, "source_id string, file string, expected_rows long")
    about = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), "path",
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))  # the content is not read
    digests = [(r["file"], r["sha256"], r["rows"]) for r in hashed_lines(spark, paths).collect()]  # a row per file of the contract
    out = named.join(about, "file").join(spark.createDataFrame(digests, "file string, sha256 string, rows long"), "file")
    return out.withColumns({"rows_as_expected": F.col("rows") == F.col("expected_rows"), "ingested": F.current_timestamp(), "commit": F.lit(commit)})
