"""Hubs of a graph are spread over tasks; the index is built without a shuffle of postings."""

import random

from pyspark.sql import functions as F

from tidelog.operators import graph
from tidelog.plans import index_store


def _brute(edges):
    root: dict = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {k: find(k) for k in list(root)}


def _rows_read(spark, group):
    """The rows that each task of a group of jobs read from shuffles."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    rows = []
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            for k in range(tasks.size()):
                metrics = tasks.apply(k).taskMetrics()
                rows.append(metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return rows


def test_components_of_hubs(spark):
    """A node with all edges, which is its component's largest: its rows, and later those of the root, are dealt over tasks."""
    n = 24_000
    rows = spark.range(n, numPartitions=4).selectExpr(f"CAST({n} AS LONG) AS a", "id AS b")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    kept = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    spark.sparkContext.setJobGroup("hubs", "hubs")
    try:
        got = graph.components(rows, heavy=1_000)
        assert {r["root"] for r in got.select("root").distinct().collect()} == {0} and got.count() == n + 1
        assert 0 < max(_rows_read(spark, "hubs")) < n // 6
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_any_shape(spark):
    """Random graphs with hubs, loops, nulls and copies, in chunks of a few edges, of numbers and of strings."""
    rng = random.Random(5)
    edges = [(rng.choice((0, 7, 900)) if rng.random() < 0.2 else rng.randrange(900), rng.randrange(1000)) for _ in range(700)]
    edges += [(k, k + 1) for k in range(2000, 2100)] + edges[:20] + [(5000, 5000)]
    want = _brute([(a, b) for a, b in edges if a != b])
    for heavy in (0, 3, 100_000):
        got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(8), heavy).collect()}
        assert got == want
    names = [(f"é{a}" if a % 2 else f"z{a}", f"é{b}" if b % 2 else f"z{b}") for a, b in edges]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(names, "a string, b string"), 3).collect()}
    assert got == _brute([(a, b) for a, b in names if a != b])
    u = [(r["u"], r["v"]) for r in graph.contracted(spark.createDataFrame(edges, "u long, v long").coalesce(1), 50).collect()]
    assert _brute([*u]) == want and len(u) < len(edges)


def test_build_shuffles_no_postings(spark, tmp_path):
    """Texts travel, not their postings; records without words stay records, and each slice is sorted by term."""
    n, words = 600, 80
    e = spark.range(n, numPartitions=2).select("id", F.when(F.col("id") % 100 == 0, "").otherwise(F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(words)])).alias("text"), F.timestamp_seconds("id").alias("created_at"))
    spark.sparkContext.setJobGroup("build", "build")
    try:
        store = index_store.build(e, str(tmp_path / "ix"), cells=2, files=3)
        read = sum(_rows_read(spark, "build"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n <= read < (n - 6) * words // 4
    assert store.postings.count() == (n - 6) * words and store.totals() == (n, (n - 6) * words)
    assert {r["df"] for r in store.df().collect()} == {n - 6}
    assert {(r["id"] % 100 == 0, r["n_tokens"]) for r in store.records.collect()} == {(True, 0), (False, words)}
    files = store.postings.groupBy(F.input_file_name().alias("f"), "cell").agg(F.count_distinct("id").alias("ids")).collect()
    assert len(files) == 6 and sum(r["ids"] for r in files) == n - 6
    for r in files:
        terms = [x["term"] for x in spark.read.parquet(r["f"]).select("term").collect()]
        assert terms == sorted(terms)
