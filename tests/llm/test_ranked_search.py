"""Ranked lexical search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import ranked_search

FLAT = str.maketrans({c: c + 32 for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FLAT))


def plain(docs, items, k=50):
    made = [(i, Counter(terms(t))) for i, t in docs]
    made = [(i, c, sum(c.values())) for i, c in made if c]
    n_docs, total = len(made), sum(n for _, _, n in made)
    df = Counter(t for _, c, _ in made for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for doc_id, c, n in made:
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = ranked_search.search(d, q, **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def corpus(seed, n=300):
    draw = random.Random(seed)
    words = [f"t{int(draw.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "漢字", "A", "a"]
    docs = [(k, draw.choice([" ", ", "]).join(draw.choice(words) for _ in range(draw.randrange(40)))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(60)]  # ties
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(12)))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"k": 3, "step": 1, "portion": 50}, {"k": 7, "step": 2, "portion": 500, "block_terms": 10}])
def test_random_corpus(spark, options):
    docs, items = corpus(11)
    assert run(spark, docs, items, **options) == plain(docs, items, options.get("k", 50))


def test_edges(spark):
    docs = [(None, "red fish"), (1, None), (2, ""), (3, "..."), (4, "RED fish"), (4, "red Fish"), (5, "blue " * 30_000 + "red")]
    items = [(7, "red blue"), (7, "fish"), (None, "red"), (8, None), (9, ""), (10, "nothing there"), (11, "red red RED")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_the_threshold_stops_the_reading():
    """With k documents that hold the rare term, the common term's list is left early, ties included."""
    n, common, rare = 20_000, 0, 1
    ids = np.arange(n)
    has = ids % 1000 == 0
    sizes = np.where(has, 2, 1)
    term = np.concatenate([[common, rare] if h else [common] for h in has])
    impact = np.where(term == rare, 10**6, 1000 - np.repeat(ids, sizes) % 7)
    portion, best = ranked_search.Portion(ids, sizes, term, impact, 2), ranked_search.Best(10)
    portion.search(np.array([common, rare]), np.array([True, True]), best, 16)
    whole = {int(i): 10**6 * bool(h) + 1000 - int(i) % 7 for i, h in zip(ids, has, strict=True)}
    want = sorted(whole, key=lambda i: (-whole[i], i))[:10]
    assert best.ids.tolist() == want and portion.read < n / 100
    assert not portion.met.any()
