"""The session fact of a stream: batches, late events, repeated batches and a stream of files against the batch fact."""

import datetime as dt
import random

import pytest

from tidemark.operators import sessions
from tidemark.streaming.sessions import EVENTS, PARTS, SessionFact, joined

MIN = sessions.MINUTE


def batch_fact(spark, rows):
    day = lambda us: dt.date(1970, 1, 1) + dt.timedelta(days=us // 86_400_000_000)
    e = spark.createDataFrame([(k, v, us, day(us), e, 1) for k, (v, us, e) in enumerate(rows)],
        "event_id long, visitorid long, us long, d date, event string, itemid long")
    return plain(sessions.session_fact(sessions.sessionize(e)))


def plain(df):
    return sorted((r.visitorid, r.start_us, r.end_us, r.n_events, r.n_view, r.n_cart, r.n_tx) for r in df.collect())


@pytest.fixture(scope="module")
def batches():
    """Six batches of two hours each; every event up to two hours late, so some are behind the watermark. One visitor has a third."""
    rng = random.Random(6)
    out = [[] for _ in range(7)]
    for k in range(900):
        us = rng.randrange(0, 12 * 60) * MIN + rng.choice([0, 0, 1])
        at = min(6, us // (120 * MIN) + rng.choice([0, 0, 0, 0, 1]))
        out[at].append((1 if k % 3 == 0 else rng.randrange(2, 60), us, rng.choice(["view", "addtocart", "transaction", "odd"])))
    return out


def test_stream_and_late_events_equal_the_batch(spark, tmp_path, batches):
    fact = SessionFact(spark, str(tmp_path / "fact"))
    for k, rows in enumerate(batches):
        fact.add(spark.createDataFrame(rows, EVENTS), k)
        fact.add(spark.createDataFrame(rows, EVENTS), k)  # the same batch again
    late = fact.late().count()
    assert late > 20 and plain(fact.sessions()) == batch_fact(spark, [x for b in batches for x in b])
    on_time = sum(r.n_events for r in fact.sessions(with_late=False).collect())
    assert on_time + late == 900


def test_a_batch_that_breaks_off_is_done_again(spark, tmp_path, batches, monkeypatch):
    fact = SessionFact(spark, str(tmp_path / "fact"))
    fact.add(spark.createDataFrame(batches[0], EVENTS), 0)
    before, write = plain(fact.sessions()), SessionFact._write

    def breaks(self, df, name, batch):
        write(self, df, name, batch)
        if name == "open":
            raise RuntimeError("lost")

    monkeypatch.setattr(SessionFact, "_write", breaks)
    with pytest.raises(RuntimeError):
        fact.add(spark.createDataFrame(batches[1], EVENTS), 1)
    assert plain(fact.sessions()) == before
    monkeypatch.setattr(SessionFact, "_write", write)
    fact.add(spark.createDataFrame(batches[1], EVENTS), 1)
    assert plain(fact.sessions()) == batch_fact(spark, batches[0] + batches[1])


def test_a_stream_of_files(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    fact = SessionFact(spark, str(tmp_path / "fact"))
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup",
        True).parquet(str(tmp_path / "in"))
    for more in (False, True):
        if more:  # one late event that makes one session of two
            spark.createDataFrame([(99, 5 * MIN, "view"), (99, 60 * MIN, "view"), (99, 32 * MIN, "view")], EVENTS).coalesce(1).write.parquet(
                str(tmp_path / "in/late"))
        q = fact.start(stream(), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    rows = [x for b in batches for x in b] + [(99, 5 * MIN, "view"), (99, 60 * MIN, "view"), (99, 32 * MIN, "view")]
    assert plain(fact.sessions()) == batch_fact(spark, rows)


def test_parts_may_overlap_and_be_empty(spark):
    one = lambda v, a, b: (v, a * MIN, b * MIN, 1, 1, 0, 0)
    df = spark.createDataFrame([one(1, 0, 100), one(1, 10, 20), one(1, 130, 130), one(1, 161, 161), one(2, 1435, 1439), one(2, 1465, 1470)], PARTS)
    assert [(r.visitorid, r.start_us // MIN, r.end_us // MIN, r.n_events) for r in joined(df).orderBy("visitorid", "start_us").collect()] == [
        (1, 0, 130, 3), (1, 161, 161, 1), (2, 1435, 1470, 2)]
    assert joined(df.limit(0)).collect() == [] and SessionFact(spark, "/tmp/none-such-fact").sessions().collect() == []
