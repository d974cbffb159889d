"""The factors that op8 removes, against first occurrences looked up one by one."""

import random

from tidelog.llm import substring_dedup

WINDOW = 20


def repeated(docs):
    """For each document the words that a window covers which also starts earlier."""
    seen, out = set(), {}
    for i, text in docs:
        words = text.split()
        out[i] = set()
        for k in range(len(words) - WINDOW + 1):
            window = tuple(words[k : k + WINDOW])
            if window in seen:
                out[i].update(range(k, k + WINDOW))
            seen.add(window)
    return out


def test_factors(spark):
    draw = random.Random(21)
    passages = [[f"p{j}w{k}" for k in range(draw.randrange(25, 160))] for j in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(draw.randrange(1, 5)):
            p = draw.choice(passages)
            a = draw.randrange(0, len(p) - 22)
            words += [f"own{i}x{draw.randrange(9)}" for _ in range(draw.randrange(0, 30))] + p[a : a + draw.randrange(22, 200)]
        docs.append((i, " ".join(words)))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True)
    want, texts, longest = repeated(docs), {i: t.split() for i, t in docs}, 0
    for r in got.collect():
        words, spans = texts[r["doc_id"]], [(s["start"], s["end"], s["source"], s["source_start"]) for s in r["spans"]]
        for start, end, source, at in spans:  # each factor is a copy of something earlier
            assert (source, at) < (r["doc_id"], start) and texts[source][at : at + end - start] == words[start:end]
            longest = max(longest, end - start)
        for (a, b, c, d), (e, _, g, h) in zip(spans, spans[1:], strict=False):  # and ends where its source does
            assert not (e == b - WINDOW + 1 and g == c and h == d + e - a)
        assert {k for a, b, _, _ in spans for k in range(a, b)} == want[r["doc_id"]]
        assert r["kept_text"] == " ".join(w for k, w in enumerate(words) if k not in want[r["doc_id"]]) and r["n_removed"] == len(want[r["doc_id"]])
    assert longest > 60  # over several blocks
