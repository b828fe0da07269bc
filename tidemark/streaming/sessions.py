"""Sessions of an event stream, with late events bounded by a watermark, and kept as a fact that late events can still join.

The fact is three sets of files in a folder: sessions that no further event on time can reach (closed), those that one can (open), and
events that came behind the watermark (late). All are written by batch number, so a batch that runs again after a failure replaces
what it wrote. A session is known by its bounds and counts, and two are one if the gap between them is within the limit; that is
associative, so a batch needs the open sessions alone, and late events join whatever they touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.sessions import GAP, MINUTE

COUNTS = ("n_events", "n_view", "n_cart", "n_tx")
PARTS = "visitorid long, start_us long, end_us long, n_events long, n_view long, n_cart long, n_tx long"
EVENTS = "visitorid long, us long, event string"
STATE = "batch long, watermark long, open string"


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row per closed session of a stream (visitorid, event_time timestamp, event): its bounds and counts. A gap of
    exactly the limit stays within the session, as in batch."""
    of = lambda e: F.count_if(F.col("event") == e)
    return (
        events.withWatermark("event_time", late).groupBy("visitorid", F.session_window("event_time", gap).alias("w"))
        .agg(F.count("*").alias("n_events"), of("view").alias("n_view"), of("addtocart").alias("n_cart"), of("transaction").alias("n_tx"),
            F.max("event_time").alias("last"))
        .select("visitorid", F.col("w.start").alias("start"), "last", "n_events", "n_view", "n_cart", "n_tx")
    )


def parts(events: DataFrame) -> DataFrame:
    """Events as parts of sessions: one for each visitor and time."""
    of = lambda e, n: F.count_if(F.col("event") == e).alias(n)
    return events.groupBy("visitorid", F.col("us").alias("start_us"), F.col("us").alias("end_us")).agg(F.count("*").alias("n_events"),
        of("view", "n_view"), of("addtocart", "n_cart"), of("transaction", "n_tx"))


def joined(pieces: DataFrame, gap_us: int = GAP) -> DataFrame:
    """Sessions of parts: those of a visitor within the gap of each other are one. Parts may overlap. First within each day that a
    part begins on, then across the days' sessions, so a visitor with many events is no single task."""

    def merge(df: DataFrame, by: list[str]) -> DataFrame:
        own = Window.partitionBy("visitorid", *by).orderBy("start_us", "end_us")
        reach = F.max("end_us").over(own.rowsBetween(Window.unboundedPreceding, -1))
        opened = df.withColumn("_new", F.coalesce((F.col("start_us") - reach > gap_us).cast("int"), F.lit(1)))
        opened = opened.withColumn("_run", F.sum("_new").over(own))
        return opened.groupBy("visitorid", *by, "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
            *[F.sum(c).alias(c) for c in COUNTS]).drop("_run")

    days = merge(pieces.withColumn("_day", F.expr("start_us div 86400000000")), ["_day"]).drop("_day")
    return merge(days, [])


class SessionFact:
    """The sessions of a stream in a folder of the shared store. One stream writes it; sessions() reads it at any time."""

    def __init__(self, spark: SparkSession, folder: str, gap_us: int = GAP, late_us: int = 60 * MINUTE):
        self.spark, self.folder, self.gap_us, self.late_us = spark, folder, gap_us, late_us

    def _read(self, name: str, schema: str, batch: int) -> DataFrame:
        """What batches up to this one wrote."""
        try:
            found = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return found.where(F.col("batch") <= batch).drop("batch")

    def _state(self, before: int | None = None) -> tuple[int, int | None]:
        """The last batch that is whole (before another one), and its watermark."""
        try:
            rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/state")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, None
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.orderBy(F.desc("batch")).limit(1).collect()
        return (last[0]["batch"], last[0]["watermark"]) if last else (-1, None)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _open(self, batch: int) -> DataFrame:
        return self.spark.read.schema(PARTS).parquet(f"{self.folder}/open/batch={batch}") if batch >= 0 else self.spark.createDataFrame([], PARTS)

    def add(self, events: DataFrame, batch: int) -> None:
        """One micro-batch of events (visitorid, us, event). The watermark is that of the batches before, as in a stream: what lies
        behind it is late. A batch that is in the state already changes nothing."""
        last, mark = self._state()
        if batch <= last:
            return
        mark = -(2**62) if mark is None else mark
        events = events.select("visitorid", "us", "event").persist()
        try:
            on_time = events.where(F.col("us") >= mark)
            self._write(events.where(F.col("us") < mark), "late", batch)
            top = events.agg(F.max("us")).first()[0]
            after = mark if top is None else max(mark, top - self.late_us)
            now = joined(self._open(last).unionByName(parts(on_time)), self.gap_us).persist()
            try:
                out_of_reach = F.col("end_us") + self.gap_us < after
                self._write(now.where(out_of_reach), "closed", batch)
                self._write(now.where(~out_of_reach), "open", batch)
            finally:
                now.unpersist()
            row = [(batch, after, f"open/batch={batch}")]
            self.spark.createDataFrame(row, STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")  # the batch is whole
        finally:
            events.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feeds the fact from a stream of events (visitorid, us, event)."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def late(self) -> DataFrame:
        """The events that came behind the watermark."""
        return self._read("late", EVENTS, self._state()[0])

    def sessions(self, with_late: bool = True) -> DataFrame:
        """All sessions so far, open ones as they are. With late events, visitors who have some get their sessions joined anew;
        those of all others are read as they were written."""
        last, _ = self._state()
        known = self._read("closed", PARTS, last).unionByName(self._open(last))
        if not with_late:
            return known
        late = parts(self.late())
        who = late.select("visitorid").distinct()
        touched = known.join(who, "visitorid", "left_semi").unionByName(late)
        return known.join(who, "visitorid", "left_anti").unionByName(joined(touched, self.gap_us))
