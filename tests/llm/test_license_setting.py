"""The registered setting of the license scan, score included, against windows one by one."""

import random

from tidelog.llm import licenses, queries

SETS = [(label, set(licenses.words(n)), len(licenses.words(n))) for label, n in licenses.listed(licenses.NOTICES)]


def containments(text, threshold=900):
    """(label, share) of every line and every window of a template's length that holds enough of it."""
    lines = [set(licenses.words(x)) for x in text.split("\n")]
    flat = licenses.words(text)
    for label, t, size in SETS:
        need = -(-threshold * len(t) // 1000)
        if len(t & set(flat)) < need:
            continue
        blocks = [*lines, *(set(flat[k : k + size]) for k in range(max(1, len(flat) - size + 1)))]
        best = max(len(t & b) for b in blocks)
        if best >= need:
            yield label, best / len(t)


def brute(text):
    flat = licenses.words(text)
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(flat)) if flat[k : k + len(p.split())] == p.split()]
    found = list(containments(text))
    base = {label for _, label in places}
    at = [k for k, _ in places]
    return len(flat), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), max((c for _, c in found), default=0.0)


def rows_of(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows_of(queries.op2_license_scan(spark, sf)) == {i: brute(t) for i, t in docs.items()}


def test_full_texts_wherever_lines_break(spark):
    draw, rows = random.Random(12), []
    for label, text in licenses.FULL_TEXTS.items():
        tokens = text.split()
        for share in (0.0, 0.04, 0.3):  # some words are other ones
            some = [w if draw.random() >= share else "harbour" for w in tokens]
            broken = "".join(w + draw.choice([" ", " ", " ", "\n"]) for w in some)
            rows.append((len(rows), f"Copyright of the quay {label}\n{broken}\nlast words"))
    got = rows_of(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.NOTICES, wrapped=True))
    assert got == {i: brute(t) for i, t in rows}
    for k, label in enumerate(licenses.FULL_TEXTS):
        assert label in got[3 * k][5].split(",") and got[3 * k][6] == 1.0


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "under the MIT license", 5, "x"), (1, "under the MIT license", 6, "y"), (None, None, 7, "z"), (2, "", 8, "w")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, score int, labels string"), licenses.NOTICES, wrapped=True)
    assert sorted((r["doc_id"] or 0, r["labels"], r["n_words"]) for r in got.collect()) == [(0, "", 0), (1, "mit", 4), (1, "mit", 4), (2, "", 0)]
