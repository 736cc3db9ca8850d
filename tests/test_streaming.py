import datetime as dt

from pyspark.sql import functions as F

from martflow.operators import windows
from martflow.sources.store import SnapshotTable
from martflow.streaming import stream

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path, n=3):
    """The events in n files by time, and one late event that only moves the watermark."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    step = (hi - lo) // n + 1
    for i in range(n):
        e.filter(F.col("event_id").between(lo + i * step, lo + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e


def test_windows_equal_their_batch_twins(spark, tmp_path):
    e = parts(spark, tmp_path)
    last = e.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + INTERVAL 3 DAYS")).withColumn("event_type", F.lit("advance"))
    for name, width, slide in (("tumbling", "5 minutes", None), ("sliding", "10 minutes", "2 minutes")):
        got = []
        src = stream.files(spark, str(tmp_path / "in"), e.schema, per_trigger=10)
        out = stream.windowed(src, "ts", ["event_type"], "value", width, slide)
        q = stream.start(out, lambda b, _: got.extend(b.collect()), str(tmp_path / f"cp-{name}"))
        q.awaitTermination()
        before = len(got)
        if name == "tumbling":  # an event that moves the watermark closes the last windows
            last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.start(
            stream.windowed(stream.files(spark, str(tmp_path / "in"), e.schema), "ts", ["event_type"], "value", width, slide), lambda b,
            _: got.extend(b.collect()), str(tmp_path / f"cp-{name}")
        )
        q.awaitTermination()
        want = windows.window_sums(e, "ts", ["event_type"], "value", width, slide)
        assert len(got) >= before
        assert sorted(map(tuple, (r for r in got if r.event_type != "advance"))) == sorted(map(tuple, want.collect()))


def test_restart_and_replay_add_nothing_twice(spark, tmp_path):
    e = parts(spark, tmp_path)
    t = SnapshotTable(spark, f"file://{tmp_path}/sink")
    for cp in ("cp1", "cp1", "cp2"):  # a restart, then a replay from the start
        src = stream.files(spark, str(tmp_path / "in"), e.schema, per_trigger=1)
        stream.start(src, stream.merge_sink(t, ["event_id"]), str(tmp_path / cp)).awaitTermination()
    assert t.read().count() == e.count() == t.read().select("event_id").distinct().count()


def test_enrich_and_file_sink(spark, tmp_path):
    e = parts(spark, tmp_path)
    users = spark.range(5).select(F.col("id").alias("user_id"), F.lit("known").alias("status"))
    src = stream.files(spark, str(tmp_path / "in"), e.schema)
    stream.file_sink(stream.enriched(stream.filtered(src, "value", 50), users, ["user_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == e.filter("value > 50").count() and out.filter("status = 'known'").count() == e.filter("value > 50 AND user_id < 5").count()


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    got = []
    for batch in ([(t(1), "a", 1.0)], [(t(40), "a", 1.0)], [(t(2), "a", 99.0), (t(41), "a", 1.0)], [(t(90), "a", 1.0)]):
        spark.createDataFrame(batch, "ts timestamp_ntz, k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = stream.files(spark, str(tmp_path / "in"), "ts timestamp_ntz, k string, v double")
        stream.start(stream.windowed(src, "ts", ["k"], "v", "5 minutes"), lambda b, _: got.extend(b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.window_start, r.total) for r in got) == [(t(0), 1.0), (t(40), 2.0)]
