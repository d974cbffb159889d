"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidelog.llm import resampling

FLAT = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain(docs, target, percent=10, max_n=1, buckets=10_000, min_words=20, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FLAT))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    made = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, made, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= min_words])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, features string, copies int")
    t = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resampling.resample(d, t, **options)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"max_n": 2, "buckets": 500, "percent": 35, "min_words": 3, "seed": 5}])
def test_random_texts(spark, options):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Éa", "été", "A", "ÀB", "漢字"]
    docs = [(k, draw.choice([" ", ", ", "-"]).join(draw.choice(words) for _ in range(draw.randrange(60)))) for k in range(120)]
    docs += [(200 + k, docs[7][1]) for k in range(90)] + [(300, None), (301, ""), (302, " .. "), (303, "long word " * 20_000)]
    target = [" ".join(draw.choice(words[:20]) for _ in range(30)) for _ in range(10)] + [None, ""]
    assert run(spark, docs, target, **options) == plain(docs, target, **options)


def test_edges(spark):
    docs = [(None, "a b c " * 10), (5, "a b c " * 10), (5, "a b c " * 10), (6, "x y " * 30)]
    assert run(spark, docs, ["a"], percent=60) == plain(docs, ["a"], percent=60)
    assert run(spark, docs, [], percent=100) == plain(docs, [], percent=100)
    assert run(spark, [], ["a"]) == []


def test_no_key_of_the_join_is_hot(spark):
    """Copies come from the broadcast table; the rest keeps its own key."""
    rows = spark.createDataFrame([(k, b"hot" if k % 2 else bytes([k % 250])) for k in range(4000)], "_id long, _key binary")
    weights = rows.groupBy("_key").count().selectExpr("_key", "count AS copies", "1L AS n_words", "1L AS n_features", "count AS weight")
    got = resampling.with_weights(rows, weights).collect()
    assert len(got) == 4000 and all(r.weight == (2000 if bytes(r._key) == b"hot" else 16) for r in got)


def test_drawn_rows(spark):
    docs = spark.createDataFrame([(k, f"w{k % 3} " * 25) for k in range(40)], "doc_id long, text string")
    judged = resampling.resample(docs, docs.where("doc_id = 0"), percent=25)
    kept = resampling.drawn(docs, judged)
    assert kept.columns == docs.columns and kept.count() == 10
