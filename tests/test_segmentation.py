"""Words of Han text: the learnt vocabulary, and cuts against all cuts there are."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidelog.operators import search, segmentation
from tidelog.plans import index_store
from tidelog.plans.retrieval import Index

WORDS = ["潮水", "码头", "灯塔", "航海图", "渔", "船", "海上风力", "看", "在", "的"]


def corpus(seed, n=120):
    draw = random.Random(seed)
    return ["".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 9))) + draw.choice(["，", " a1 ", "。"]) + "".join(draw.choice(WORDS) for _ in range(4)) for _ in range(n)]


def all_cuts(run, longest):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [0, *(k + 1 for k, m in enumerate(marks) if m), len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(ends)]
        if max(map(len, parts)) <= longest:
            yield parts


def test_the_likeliest_cut():
    draw = random.Random(4)
    for _ in range(60):
        scores = {"".join(draw.choice("甲乙丙丁") for _ in range(draw.randrange(1, 5))): -draw.randrange(1, 9) for _ in range(12)}
        cutter = segmentation.Cutter(scores)
        run = "".join(draw.choice("甲乙丙丁戊") for _ in range(draw.randrange(1, 10)))
        value = lambda parts: sum(scores.get(p, cutter.unknown if len(p) == 1 else -math.inf) for p in parts)  # noqa: B023, E731
        got = cutter.cut(run)
        assert "".join(got) == run and value(got) == max(map(value, all_cuts(run, cutter.longest)))
    assert segmentation.Cutter({}).cut("甲乙") == ["甲", "乙"]
    assert segmentation.Cutter({"甲乙": 0, "甲": 0, "乙": 0}).cut("甲乙甲") == ["甲乙", "甲"]  # the longer word at a tie


def test_the_vocabulary(spark):
    texts = corpus(5)
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "", "no such letters"]], "text string")
    n = Counter()
    for t in texts:
        for run in "".join(c if "一" <= c <= "鿿" else " " for c in t).split():
            n.update(run[i : i + k] for i in range(len(run)) for k in range(1, 5) if i + k <= len(run))
    total = sum(c for g, c in n.items() if len(g) == 1)
    want = {g: c for g, c in n.items() if len(g) == 1 or (c >= 5 and min(c * total / (n[g[:k]] * n[g[k:]]) for k in range(1, len(g))) >= 8)}
    got = {r["word"]: (r["n"], r["score"]) for r in segmentation.learn(rows, cohesion=8).collect()}
    assert got == {g: (c, math.floor(1000 * math.log(c / total) + 0.5) if math.log(c / total) > 0 else -math.floor(-1000 * math.log(c / total) + 0.5)) for g, c in want.items()}
    assert {"潮水", "码头", "灯塔", "航海图"} <= set(got)
    assert segmentation.learn(rows, most=3).count() == 3 and segmentation.learn(rows.limit(0)).count() == 0


def test_an_index_by_words(spark, tmp_path):
    texts = corpus(6)
    e = spark.createDataFrame([(k, t, k) for k, t in enumerate([*texts, "plain words only", None])], "id long, text string, n long").select("id", "text", F.lit("").alias("title"), F.timestamp_seconds("n").alias("created_at"))
    words = segmentation.learn(e, cohesion=8)
    index = Index(e).save(str(tmp_path / "ix"), words=words)
    cutter = index.store.cutter
    plain = {(t, k) for k, text in enumerate(texts) for w in "".join(c if c.isalnum() else " " for c in text).split() for t in ([w] if w.isascii() else cutter.cut(w))}
    assert {(r["term"], r["id"]) for r in index.post.where(f"id < {len(texts)}").collect()} == plain
    han = F.col("term").rlike(r"\p{IsHan}")
    assert index.post.where(han).count() < search.postings(e).where(han).count()  # fewer than bigrams
    assert search.query_phrases("看灯塔 Boats-x", cut=cutter.phrases) == [("看", "灯塔"), ("boats", "x")]
    tokens = [cutter.split("".join(c if c.isalnum() else " " for c in t).split()) for t in texts]
    want = {k for k, t in enumerate(tokens) if ("看", "灯塔") in itertools.pairwise(t)}
    assert want and {r["id"] for r in index.search("看灯塔", 1000).collect()} == want
    assert index_store.follow(str(tmp_path / "ix"), e.where("id = 0").withColumn("text", F.lit("灯塔灯塔")), 1)
    after = index_store.open_store(spark, str(tmp_path / "ix")).postings.where("id = 0").collect()
    assert [(r["term"], r["n"]) for r in after] == [("灯塔", 2)]
