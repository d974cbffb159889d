"""Streams whose keys fall silent: what timers tell."""

import time

import pytest
from pyspark.sql import functions as F

from tidelog.streaming import events as streams


@pytest.fixture(autouse=True, scope="module")
def one_state_store(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


T0 = 1_700_000_000


def source(spark, tmp_path, files, schema):
    """One file a micro-batch; the column s becomes ts."""
    made = None
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + T0)).drop("s").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        made = frame.schema
        time.sleep(0.05)  # files are read in the order of their times
    return spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def seconds(ts):
    return ts.timestamp() - T0


def test_spans_end_in_silence(spark, tmp_path):
    files = [[("u", "mail", 0), ("u", "mail", 20), ("u", "maps", 60), ("v", "mail", 5)], [("u", "maps", 100), ("u", "maps", 600), ("u", None, 610)], [("w", "x", 5000)]]
    stream = source(spark, tmp_path, files, "who string, app string, s long")
    got = sorted(((k, v, seconds(a), seconds(b), n, why) for k, v, a, b, n, why in run(streams.spans(stream, "who", "app", gap_s=300), "spans")), key=repr)
    assert got == sorted([
        ("u", "mail", 0.0, 20.0, 2, "change"), ("u", "maps", 60.0, 100.0, 2, "gap"), ("u", "maps", 600.0, 600.0, 1, "change"),
        ("u", None, 610.0, 610.0, 1, "silence"), ("v", "mail", 5.0, 5.0, 1, "silence"),
    ], key=repr)  # fmt: skip  # nothing of u or v comes after these; w may still go on


def test_quiet_keys(spark, tmp_path):
    files = [[("a", 0), ("b", 0)], [("a", 300)], [("b", 2000)], [("c", 9000)]]
    stream = source(spark, tmp_path, files, "who string, s long")
    got = sorted((k, seconds(s)) for k, s in run(streams.quiet_keys(stream, "who", after_s=660), "quiet"))
    assert got == [("a", 300.0), ("b", 0.0), ("b", 2000.0)]  # a moved its timer; b fell silent twice


def test_speech_ends_in_silence(spark, tmp_path):
    on = [("k", b, True, b) for b in range(12)]
    files = [on[:7], on[7:], [("k", 300, False, 300), ("other", 0, True, 300)], [("other", 1, False, 9000)]]
    stream = source(spark, tmp_path, files, "who string, block long, speech boolean, s long")
    got = sorted(run(streams.on_speech(stream, "who", "block", "speech", at="ts", silence_s=60), "speech"))
    assert got == [("k", 0, 11, 12)]  # ended by its timer, long before block 300; "other" had too little speech
    untimed = run(streams.on_speech(stream.where("block < 20"), "who", "block", "speech"), "untimed")
    assert untimed == []  # without a timer the segment stays open


def test_the_clock_tells_silence(spark, tmp_path):
    """The last event is followed by nothing at all: no data and no event time, just the clock."""
    stream = source(spark, tmp_path, [[("a", 0), ("b", 10)]], "who string, s long")
    rows = streams.quiet_keys(stream, "who", after_s=1, by_clock=True)
    q = rows.writeStream.format("memory").queryName("clock").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 120
        while time.time() < end and spark.table("clock").count() < 2:
            time.sleep(0.5)
        assert sorted((r["key"], seconds(r["since"])) for r in spark.table("clock").collect()) == [("a", 0.0), ("b", 10.0)]
    finally:
        q.stop()
