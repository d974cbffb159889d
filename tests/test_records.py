from pyspark.sql import functions as F

from tidelog.functions import records
from tidelog.operators import media


def test_nested_columns(spark):
    lines = F.from_json(F.lit('[{"x":0,"y":5,"w":9,"h":10,"conf":0.9,"text":"menu"},{"x":0,"y":100,"w":9,"h":30,"conf":0.9,"text":"Big title"},{"x":0,"y":150,"w":9,"h":10,"conf":0.2,"text":"body"}]'), records.LINE)
    labels = F.from_json(F.lit('[{"name":"photo","conf":0.9},{"name":"cat","conf":0.5},{"name":"dog","conf":0.1}]'), "array<struct<name:string,conf:double>>")
    row = spark.range(1).select(
        records.body_lines(lines, F.lit(1000)).alias("body"), records.headline(lines).alias("head"), records.picked_labels(labels, ["photo"]).alias("labels"),
        records.colour_name(F.lit(250), F.lit(250), F.lit(250)).alias("white"), records.colour_name(F.lit(200), F.lit(20), F.lit(20)).alias("red"), records.line_of_words(lines)["h"].alias("h"),
        records.cited(F.array(F.lit(2), F.lit(9)), F.array(F.lit(10), F.lit(20))).alias("cited"), records.cited(F.lit(None).cast("array<int>"), F.array(F.lit(10))).alias("none"),
        F.try_variant_get(records.loose_json(F.lit('so: ```json\n{"a": 1}\n```')), "$.a", "int").alias("fenced"), records.loose_json(F.lit("no")).alias("bad"),
        records.duration(F.lit(3780)).alias("d"), records.parameters(F.lit("name-7.5b-chat")).alias("p"), records.relative_day(F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")).alias("day"),
    ).first()
    assert row["body"] == ["Big title", "body"]
    assert (row["head"], row["labels"], row["white"], row["red"], row["h"]) == ("Big title", ["cat", "photo"], "white", "red", 155.0)
    assert (row["cited"], row["none"], row["fenced"], row["bad"], row["d"], row["p"], row["day"]) == ([20], [10], 1, None, "1h 3m", 7.5, "yesterday")


def test_media(spark):
    schema = "url string, kind string, title string, width int, height int"
    a = spark.createDataFrame([("u1", None, "", 10, 5), ("blob:x", "video", "b", 1, 1), ("s.ts", "segment", "", 0, 0)], schema)
    b = spark.createDataFrame([("u1", "image", "t", 8, 9), ("u2", "video", None, None, None)], schema)
    assert {tuple(r) for r in media.merge_media(a, b).collect()} == {("u1", "image", "t", 10, 9), ("u2", "video", None, None, None)}
    items = spark.createDataFrame([(f"http://h/a/{k}.ts", "segment") for k in range(3)] + [(f"http://h/b/c/{k}.ts", "segment") for k in range(3)] + [("http://h/b/m.m3u8", "stream"), ("http://h/d/1.ts", "segment")], "url string, kind string")
    assert [(r["folder"], r["n"]) for r in media.segment_directories(items).collect()] == [("http://h/a/", 3)]
    models = spark.createDataFrame([("m-1-9", "v", 8, 1.0), ("m-1-10", "v", 8, 1.0), ("m-latest", "v", 8, 1.0)], "name string, vendor string, context int, price double")
    assert [(r["name"], r["resolved"]) for r in media.newest_alike(models).collect()] == [("m-latest", "m-1-10")]
    hours = spark.createDataFrame([("d", 1, 3), ("d", 2, 4), ("d", 5, 9), ("d", 6, 1)], "day string, hour int, n long")
    assert sorted(tuple(r) for r in media.hour_groups(hours, "day", 5).collect()) == [("d", 1, 2, 7), ("d", 5, 5, 9), ("d", 6, 6, 1)]
