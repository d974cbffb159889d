"""Findings of round 3: queries on inputs that the small tables lack."""

import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.operators import graph, hygiene, search, sessions, vectors
from tidelog.plans import registry
from tidelog.session import table

SF = "/root/testdata/sf0.001"


def test_page_keys_of_titles_that_end_like_counters(spark, tmp_path):
    """A page's own title may end in a cut telephone number, or begin with a number in brackets."""
    titles = ["A onorou thretionat +1 (626)", "(12) angry men", "Plan - 80x24", "Find in page tricks", "ab", "Untitled", " two  words "]
    frame = pd.DataFrame([(k, f"http://a.org/{k}/#x", f"<html><head><title>{t}</title></head><body>x</body></html>") for k, t in enumerate(titles)], columns=["page_id", "url", "html"])
    frame.to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(registry.ORACLES["page_keys"]).df().sort_values("id")
    got = registry.QUERIES["page_keys"](spark, str(tmp_path)).toPandas().sort_values("id")
    assert got[["id", "url_key", "title_key"]].values.tolist() == want[["id", "url_key", "title_key"]].values.tolist()
    assert len({r["page"] for r in registry.QUERIES["page_nodes"](spark, str(tmp_path)).collect()}) == len(titles)


@pytest.mark.parametrize(("floor", "most"), [(0.2, 7), (0.35, 16), (2.0, 5)])
def test_leader_clusters_over_many_blocks(spark, floor, most):
    """More leaders than a block holds (with a floor of 2 all lead, as at size) are the same as in one block."""
    v = registry._vectors(spark, SF).where("label < 3")
    name = lambda rows: {r["id"]: (r["key"], r["leader"]) for r in rows.collect()}
    got, want = name(vectors.leader_clusters(v, "label", "id", floor=floor, most=most)), name(vectors.leader_clusters(v, "label", "id", floor=floor))
    assert got == want and len(want) == v.where("v IS NOT NULL").count()
    assert max(pd.Series([k for k, _ in want.values()]).value_counts()) > 2 * most
    assert floor == 2.0 or len(set(want.values())) < len(want)


def test_leader_clusters_take_the_last_of_equal_leaders(spark):
    """Two leaders of other blocks at the same angle: the later one is joined."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 2.0])]
    got = vectors.leader_clusters(spark.createDataFrame([(i, 0, v) for i, v in rows], "id long, k int, v array<double>"), "k", "id", floor=0.7, most=1)
    assert {r["id"]: r["leader"] for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 2}


def test_overlap_of_long_segments(spark):
    """Segments of years are not dealt into every bin, and overlapping, repeated and empty ones count as before."""
    year = 31_536_000.0
    chunks = [("a", k, 600.0 * k, 600.0 * k + 600.0) for k in (0, 1, 7, 50_000)] + [("b", 1, 30.0, 1330.0), ("b", 2, 600.0, 700.0)]
    segments = [("a", "x", 100.0, 5 * year), ("a", "y", 0.0, 700.0), ("a", "y", 0.0, 700.0), ("a", "z", 650.0, 650.0), ("b", "x", 0.0, 40.0), ("b", "y", 39.0, 1e9), ("b", None, 1.0, 2.0), ("c", "x", 0.0, 9.0), ("a", "w", None, 5.0)]
    want = {}
    for k, c, lo, hi in chunks:
        secs = {}
        for kk, who, s, e in segments:
            if kk == k and who and s is not None:
                secs[who] = secs.get(who, 0.0) + max(0.0, min(hi, e) - max(lo, s))
        want[k, c] = min((-v, who) for who, v in secs.items() if v >= 0.2)
    rows = sessions.overlap_speakers(spark.createDataFrame(chunks, "k string, c int, start double, end double"), spark.createDataFrame(segments, "k string, speaker string, start double, end double"), "k", "c")
    assert {(r["k"], r["c"]): (-r["secs"], r["speaker"]) for r in rows.collect()} == want


@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_token_postings(spark, step):
    """Postings of texts of any length, empty ones and none, against plain loops, in steps of few tokens."""
    texts = {1: ["b", "a", "b"], 2: [], 3: None, 4: ["b"], 5: ["é", "中文", "a"] * 40, 6: ["a"]}
    rows = spark.createDataFrame(list(texts.items()), "id long, tokens array<string>").coalesce(1)
    want = {(t, i, tuple(k for k, x in enumerate(ts) if x == t), ts.count(t), len(ts)) for i, ts in texts.items() if ts for t in set(ts)}
    got = [(r["term"], r["id"], tuple(r["positions"]), r["n"], r["n_tokens"]) for r in search.token_postings(rows, step).collect()]
    assert set(got) == want and len(got) == len(want)


def test_long_records_are_grouped_in_time(spark):
    """A record of 200,000 words, all different, took time by their square."""
    rows = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: x.cast("string")).alias("text")).withColumn("text", F.array_join("text", " "))
    began = time.monotonic()
    assert search.postings(rows).agg(F.count("*"), F.sum("n")).first()[:] == (200_000, 200_000)
    assert time.monotonic() - began < 30


def test_much_furniture(spark):
    """More furniture than goes to tasks: the same views, and whole lines don't travel."""
    e = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("id"), "text")
    fur = hygiene.furniture(e)
    few, much = ({tuple(r) for r in hygiene.stripped(e, fur, in_tasks=n).collect()} for n in (20_000, 10))
    assert few == much and fur.count() > 10
    plan = hygiene.stripped(e, fur, in_tasks=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_texts_are_searched_once_for_entities(spark):
    """What entity rows are read from, twice or more, is a saved table and not the texts."""
    e = spark.createDataFrame([(1, "Kew walk", "https://a.org", "Kew is at AB1 2CD on 2024-01-05, 5 km"), (2, "Kew", None, "AB1 2CD again, 5 km")], "id long, title string, url string, text string")
    rows = graph.entity_rows(e)
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["key"] for r in graph.entity_index(rows).collect()} >= {"ab1 2cd", "5 km"}
