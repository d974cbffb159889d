"""The vector store: what is embedded when, and cluster names."""

from pyspark.sql import functions as F

from tidelog.operators import vectors
from tidelog.plans import vector_store

MODEL = vector_store.hashed_words(8)


def log(spark, rows):
    return spark.createDataFrame(rows, "id long, date_key string, text string")


def test_texts_are_embedded_once(spark, tmp_path):
    path = str(tmp_path / "store")
    day1 = [(1, "2024-01-01", "low water at the quay"), (2, "2024-01-01", "low water at the quay"), (3, "2024-01-01", None), (4, "2024-01-01", "harbour " * 80)]
    first = vector_store.fill(log(spark, day1), path, "m", MODEL)
    n_long = vector_store.pieces(log(spark, day1).where("id = 4"), "m").select("hash").distinct().count()
    assert first == 1 + n_long and vector_store.missing(log(spark, day1), path, "m").count() == 0
    assert vector_store.fill(log(spark, day1), path, "m", MODEL) == 0
    got = {(r["id"], r["seq"]): r["v"] for r in vector_store.load(spark, path).collect()}
    assert got[1, 0] == got[2, 0] and any(got[1, 0]) and not any(k[0] == 3 for k in got)
    changed = [(1, "2024-01-01", "high water at the quay"), *day1[1:]]
    assert vector_store.fill(log(spark, changed), path, "m", MODEL) == 1
    day2 = [(5, "2024-01-02", "high water at the quay"), (6, "2024-01-02", "a bell rings")]
    assert vector_store.fill(log(spark, day2), path, "m", MODEL) == 1
    got = {(r["id"], r["seq"]): (r["day"], r["v"]) for r in vector_store.load(spark, path).collect()}
    assert got[1, 0][1] == got[5, 0][1] != got[2, 0][1] and got[5, 0][0] == "2024-01-02" and got[2, 0][0] == "2024-01-01"
    assert {r["id"] for r in vector_store.load(spark, path, "2024-01-02", "2024-01-02").collect()} == {5, 6}
    assert vector_store.fill(log(spark, day2), path, "other model", MODEL) == 2


def test_a_run_that_is_killed_goes_on(spark, tmp_path):
    path = str(tmp_path / "store")
    e = log(spark, [(k, "2024-01-01", f"text number {k}") for k in range(5)])
    half = vector_store.pieces(e.where("id < 2"), "m").withColumn("v", F.array(F.lit(9.0).cast("float")))
    half.select("hash", "v", "day").write.partitionBy("day").parquet(f"{path}/vectors")  # vectors without pieces yet
    assert vector_store.load(spark, path).count() == 0
    assert vector_store.fill(e, path, "m", MODEL) == 3
    assert vector_store.load(spark, path).count() == 5


def test_names_of_clusters(spark):
    rows = [(1, [1.0, 0.0], "Low tide walk"), (2, [1.0, 0.1], "Tide walk again"), (3, [1.0, 0.05], ""), (4, [0.0, 1.0], ""), (5, [0.0, 1.0], "截图 10:32"), (6, [0.1, 1.0], None), (7, [1.0, 1.0], "x"), (8, [1.0, 1.0], "walk")]
    frame = spark.createDataFrame(rows, "id long, v array<double>, title string")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 7)], "id long, leader long")
    got = {r["leader"]: r for r in vectors.name_clusters(members, frame).collect()}
    assert set(got) == {1, 4}
    assert got[1]["named_by"] == 3 and got[1]["title"] == got[1]["name"] == "Tide walk again"
    assert got[1]["words"] == "tide · walk" and got[4]["name"] == got[4]["words"] == ""
    untitled = frame.withColumn("title", F.when(F.col("id") < 3, F.concat(F.lit("截图 10:3"), F.col("id").cast("string"))).otherwise(F.col("title")))
    assert vectors.name_clusters(members, untitled).where("leader = 1").first()["name"] == "截图"  # no title says anything; its own words do
