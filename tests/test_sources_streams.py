import json
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.operators.entries import SCHEMA
from tidelog.sources import files, paged
from tidelog.streaming import events as streams


def test_days_and_trail(spark, tmp_path):
    (tmp_path / "2024-01-01.json").write_text(json.dumps([{"id": 1, "text": "a", "more": 1}, {"id": 2}]))
    assert {(r["id"], r["text"]) for r in files.read_days(spark, str(tmp_path)).collect()} == {(1, "a"), (2, None)}
    (tmp_path / "t.jsonl").write_text('{"at": "2024-01-01T00:00:00Z", "kind": "focus", "app": "x"}\n{"at": "2024-01-01T0')
    assert [r["app"] for r in files.read_trail(spark, str(tmp_path)).collect()] == ["x"]


def test_partitions(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2"), (3, "c", "d2")], "id long, text string, date_key string")
    path = str(tmp_path / "log")
    files.write_entries(e, path)
    files.write_entries(spark.createDataFrame([(2, "B", "d2")], "id long, text string, date_key string"), path)
    assert {(r["id"], r["text"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "B")}
    files.write_entries(e, path)
    files.delete_entries(spark, path, spark.createDataFrame([(3,)], "id long"), str(tmp_path / "staged"))
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {1, 2}
    now = files.files_manifest(spark, path, "*.parquet")
    changed, gone = files.refresh_plan(now, now)
    assert (changed.count(), gone.count()) == (0, 0)
    assert "created_at" in SCHEMA.fieldNames()


def test_mail_and_archives(spark, tmp_path):
    box = "From a@b Mon\nSubject: =?utf-8?B?w6l0w6k=?=\nFrom: x@y\nContent-Type: text/plain\n\nhello\n\nFrom c@d Tue\nSubject: two\nContent-Type: text/html\n\n<p>rich</p>\n"
    (tmp_path / "m.mbox").write_text(box)
    rows = files.read_mbox(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r["subject"], r["body"]) for r in rows] == [("été", "hello"), ("two", "rich")]
    assert files.decode_header(None) == ""
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(3):
            z.writestr(f"n{k}.md", f"text {k}")
    (tmp_path / "bad.zip").write_text("no archive")
    assert files.read_zips(spark, str(tmp_path)).count() == 3
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / f"My note {'0a' * 16}.md").write_text("body")
    assert [(r["title"], r["text"]) for r in files.read_folder(spark, str(tmp_path / "notes")).collect()] == [("My note", "body")]


def test_paged(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"page-{k:03d}.json").write_text(json.dumps({"items": [{"id": "a", "title": f"t{k}", "updated_at": str(k)}, {"id": f"b{k}"}]}))
    rows = paged.read_paged(spark, str(tmp_path))
    assert rows.count() == 6
    assert {r["id"]: r["title"] for r in paged.latest_by_remote(rows).collect()}["a"] == "t2"


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    """A state store for each shuffle partition is opened and closed by every stream."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 60, "a"), (1, 90, "b"), (1, 500, "b"), (2, 10, "a"), (1, 200000, "z")]
    src = spark.createDataFrame(rows, "user long, s long, app string").select("user", F.timestamp_seconds("s").alias("ts"), "app")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = {(r["key"], r["ts"].timestamp(), r["value"]) for r in run(streams.on_change(stream, "user", "app"), "changed").collect()}
    assert got == {(1, 0.0, "a"), (1, 90.0, "b"), (1, 500.0, "b"), (2, 10.0, "a"), (1, 200000.0, "z")}
    assert run(streams.without_copies(stream, "app"), "copies").count() == 3
    assert run(streams.once_a_day(stream, "user"), "daily").count() == 3
    assert {r["n"] for r in run(streams.slots(stream), "slots").collect()} == {4, 1}
    assert run(streams.sessions(stream, ["user"]), "sess").count() >= 2


def test_streams_with_memory(spark, tmp_path):
    shapes = [("u", 0, "text:1", ["text:1", "image:1"]), ("u", 10, "image:1", []), ("u", 20, "image:1", []), ("u", 30, "text:2", ["image:2"]), ("u", 900, "image:2", []), ("v", 5, "image:1", [])]
    src = spark.createDataFrame(shapes, "user string, s long, shape string, others array<string>").select("user", F.timestamp_seconds("s").alias("ts"), "shape", "others")
    src.coalesce(1).write.parquet(str(tmp_path / "shapes"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "shapes"))
    got = {(r["key"], r["ts"].timestamp(), r["shape"]) for r in run(streams.without_other_shapes(stream, "user", "shape", "others"), "shapes").collect()}
    assert got == {("u", 0.0, "text:1"), ("u", 20.0, "image:1"), ("u", 30.0, "text:2"), ("u", 900.0, "image:2"), ("v", 5.0, "image:1")}  # a left-over is let go once
    pictures = [("u", 0, 0b1111, "9x9"), ("u", 10, 0b1101, "9x9"), ("u", 20, 0b1111, "8x8"), ("u", 30, 0b11110000, "9x9"), ("u", 70, 0b1111, "9x9"), ("v", 1, -1, "9x9"), ("v", 2, -2, "9x9")]
    src = spark.createDataFrame(pictures, "user string, s long, bits long, size string").select("user", F.timestamp_seconds("s").alias("ts"), "bits", "size")
    src.coalesce(1).write.parquet(str(tmp_path / "pictures"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "pictures"))
    got = {(r["key"], r["ts"].timestamp()) for r in run(streams.without_same_pictures(stream, "user", "bits", "size"), "pictures").collect()}
    assert got == {("u", 0.0), ("u", 20.0), ("u", 30.0), ("u", 70.0), ("v", 1.0)}
    copies = [("text", "a", 0), ("text", "a", 60), ("url", "b", 0), ("url", "b", 7200), ("image", "c", 0)]
    src = spark.createDataFrame(copies, "kind string, what string, s long").select("kind", "what", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))  # a time of 0 is late by any watermark
    src.coalesce(1).write.parquet(str(tmp_path / "copies"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "copies"))
    assert Counter(r["kind"] for r in run(streams.without_copies_by_kind(stream, "kind", "what"), "by_kind").collect()) == {"text": 1, "url": 1, "image": 1}
    beats = spark.createDataFrame([("a", 0), ("a", 300), ("b", 0), ("b", 5000)], "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
    beats.coalesce(1).write.parquet(str(tmp_path / "beats"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "beats"))
    assert {(r["who"], r["since"].timestamp()) for r in run(streams.stale(stream, "who"), "stale").collect()} >= {("a", 300.0), ("b", 0.0)}
    q = streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    seen = []
    q = streams.maintain(stream, str(tmp_path / "at2"), lambda batch, k: seen.append(batch.count()))
    q.awaitTermination(120)
    assert seen == [4]
