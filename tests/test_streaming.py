"""A stream fed file by file gives what the batch gives."""

import tempfile

from pyspark.sql import functions as F

from tapeloom.streaming import bars as stream


def test_delta_bars_over_many_files(spark, sf):
    folder = tempfile.mkdtemp(prefix="spark-")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(4):
        events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = stream.events_as_prints(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    got = stream.drain(stream.delta_bars(live, 40), folder)
    signed = {"B": 1, "A": -1, "N": 0}
    want, open_ = [], {}
    for r in stream.events_as_prints(events).orderBy("seq").collect():
        bar, first, volume, delta = open_.get(r.instrument, (0, -1, 0, 0))
        first, volume, delta = r.seq if first < 0 else first, volume + r.sz, delta + signed[r.side] * r.sz
        if abs(delta) >= 40:
            want.append((r.instrument, bar, first, r.seq, volume, delta))
            bar, first, volume, delta = bar + 1, -1, 0, 0
        open_[r.instrument] = (bar, first, volume, delta)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_late_prints_are_dropped(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = lambda *t: spark.createDataFrame([(i, x, "M0", 1, "B") for i, x in enumerate(t)], "seq long, s long, instrument string, sz long, side string").select("seq", F.timestamp_seconds("s").alias("ts"), "instrument", "sz", "side").coalesce(1)
    for part in (rows(0, 10, 70), rows(400), rows(401), rows(5, 410), rows(900)):
        part.write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(rows(0).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = stream.drain(stream.time_bars(live, "60 seconds", "60 seconds"), folder)
    assert sorted((r.bar_us // 10**6, r.prints) for r in got.collect()) == [(0, 2), (60, 1), (360, 3)]


def test_ofi_bars_and_stance_over_many_files_are_those_of_the_batch(spark, sf):
    from tapeloom.operators import flow, sequential

    folder = tempfile.mkdtemp(prefix="spark-")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(4):
        events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = stream.drain(stream.ofi_bars(stream.events_as_touches(live), 60, 3600, 3), f"{folder}/a")
    want = sequential.ofi_bars(flow.level1_ofi(stream.events_as_touches(events)), 60, 3600, 3).where("colour <> 'OPEN'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    many = stream.drain(stream.stance(stream.events_as_prints(live), 21600.0, 12.0, 5.0), f"{folder}/c")
    whole = stream.drain(stream.stance(stream.events_as_prints(stream.prints_stream(spark, sf, "events.parquet")), 21600.0, 12.0, 5.0), f"{folder}/d")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, whole.collect())) and many.count() > 20
