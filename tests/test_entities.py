"""Entities in two passes, against a plain version over whole documents."""

from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from tidelog.config import STOP_WORDS
from tidelog.operators import graph
from tidelog.plans import registry

SF = "/root/testdata/sf0.001"
POST = regex.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}(?![A-Za-z0-9])")
DAY = regex.compile(r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])")
MEASURE = regex.compile(r"(?<![\p{L}0-9])[0-9]+(?:\.[0-9]+)? ?(?:kg|km|cm|mm|GB|MB|TB|%)(?![\p{L}0-9])")


def can_name(w):
    return len(w) >= 2 and any(c.isalpha() for c in w) and w not in STOP_WORDS and w not in graph.LABELS


def words(text):
    return [w for w in regex.findall(r"[\p{L}\p{N}]+", text.lower()) if can_name(w)]


def is_proper(text, m):
    """By looking around the word, character by character."""
    w, at = m[0], m.start()
    if any(c.isalpha() for c in w) and any(not c.isalpha() for c in w):
        return len(w) >= 2
    if len(w) < 3 or not w[0].isupper():
        return False
    if w.isupper():
        return True
    before = text[:at]
    cut = before.rstrip(" \t")
    inside = cut and len(before) - len(cut) <= 2 and not cut[-1].isspace() and cut[-1] not in '.!?。！？:："“(（[【'
    rest = text[m.end() :].removeprefix(",")
    return bool(inside) or (rest[:1] in (" ", "\t") and rest.lstrip(" \t")[:1].isupper())


def plain(records):
    heads = {i: " ".join(x for x in (t, u) if x is not None) for i, t, u, _ in records}
    full = {i: "\n".join(x for x in (heads[i], text) if x is not None) for i, _, _, text in records}
    titled = {w for h in heads.values() for w in words(h)}
    places = set()
    for text in full.values():
        found = list(POST.finditer(text))
        for m in found:
            near = text[max([0, m.start() - 60, *(f.end() for f in found if f.end() <= m.start())]) : m.start()] + " " + text[m.end() : min([len(text), m.end() + 60, *(f.start() for f in found if f.start() >= m.end())])]
            places.update(words(near))
    rows = set()
    for i, text in full.items():
        for kind, pattern in (("postcode", POST), ("date", DAY), ("quantity", MEASURE)):
            rows |= {(i, kind, m.lower()) for m in pattern.findall(text)}
        rest = regex.sub("|".join(p.pattern for p in (POST, DAY, MEASURE)), " ", text)
        names = {m[0].lower() for m in regex.finditer(r"[\p{L}\p{N}]+", rest) if is_proper(rest, m)}
        rows |= {(i, "place" if w in places else "name", w) for w in names if can_name(w)}
    return rows, titled


def plain_index(rows, titled, per=20, low=2, high=30):
    df = Counter((k, w) for _, k, w in rows)
    own = defaultdict(list)
    for i, k, w in rows:
        if low <= df[k, w] <= high:
            own[i].append((0 if k != "name" else 1 if w in titled else 2, df[k, w], w, k))
    kept = [(i, k, w, n, r) for i, found in own.items() for r, (_, n, w, k) in enumerate(sorted(found)[:per])]
    again = Counter((k, w) for _, k, w, _, _ in kept)
    return {x for x in kept if again[x[1], x[2]] >= low}


def test_whole_documents(spark):
    records = [tuple(r) for r in registry._entries(spark, SF).select("id", "title", "url", "text").collect()]
    rows, titled = plain(records)
    got = registry._entity_rows(spark, SF).collect()
    assert {(r["id"], r["kind"], r["key"]) for r in got} == rows
    assert all(r["titled"] == (r["key"] in titled) for r in got)
    index = {(r["id"], r["kind"], r["key"], r["df"], r["rank"]) for r in registry.QUERIES["entity_index"](spark, SF).collect()}
    assert index == plain_index(rows, titled) and index


TEXTS = [
    (1, "Low water", "Meet at Quay House, Harbour Road, Lerwick ZE1 0AA by nine in the morning, with boots and something warm to put on. We saw Foula from the boat."),
    (2, "Walk to Foula", "The boat left Lerwick late; NLB told us. Good weather. P3x and 12 km, 2024-05-01."),
    (3, None, "nothing here: Sunday comes. Then, Rain"),
    (4, "", None),
]


def records(spark):
    return spark.createDataFrame(TEXTS, "id long, title string, text string")


def test_gates(spark):
    got = {(r["id"], r["kind"], r["key"]) for r in graph.entity_rows(records(spark)).collect()}
    assert {(1, "postcode", "ze1 0aa"), (1, "place", "lerwick"), (2, "place", "lerwick"), (1, "place", "quay"), (2, "name", "nlb"), (2, "name", "p3x"), (1, "name", "foula"), (2, "quantity", "12 km"), (2, "date", "2024-05-01")} <= got
    assert not {k for _, _, k in got} & {"good", "sunday", "meet", "we", "boat"}
    words = {r["word"]: (r["titled"], r["place"]) for r in graph.dictionary(records(spark)).collect()}
    assert words["foula"] == (True, False)
    assert words["harbour"] == (False, True) and "nlb" not in words
    assert got == {(r["id"], r["kind"], r["key"]) for r in graph.entity_rows(records(spark), in_tasks=0).collect()}  # by a join


def test_han_words_need_a_head(spark):
    e = spark.createDataFrame([(1, "灯塔", "看灯塔在码头"), (2, "x", "灯塔码头航海图"), (3, None, "码头")], "id long, title string, text string")
    cut = lambda text: F.regexp_extract_all(text, F.lit("灯塔|码头|航海图|看|在"), F.lit(0))
    got = {(r["id"], r["key"]) for r in graph.entity_rows(e, han=cut).collect()}
    assert got == {(1, "灯塔"), (2, "灯塔"), (2, "航海图")}


def test_filling_goes_on(spark, tmp_path):
    e, path = records(spark), str(tmp_path / "found")
    assert [graph.fill(e, path, 1, most=3), graph.fill(e, path, 1, most=3), graph.fill(e, path, 1)] == [3, 1, 0]
    read = lambda: sorted(tuple(r) for r in graph.filled(spark, path, 1, graph.dictionary(e)).collect())
    assert read() == sorted(tuple(r) for r in graph.entity_rows(e).collect())
    assert graph.fill(e, path, 2) == 4  # other rules: all of them again
    assert len(read()) == graph.entity_rows(e).count()


def test_posting_lists(spark):
    rows = [tuple(r) for r in registry.QUERIES["entity_index"](spark, SF).select("id", "key", "rank").collect()]
    want = {}
    for i, key, rank in rows:
        if rank < 3:
            want.setdefault(key, set()).add(i)
    got = {r["key"]: r["ids"] for r in graph.vocab_postings(registry.QUERIES["entity_index"](spark, SF), cap=2, keep=3).collect()}
    assert got == {k: sorted(v)[:2] for k, v in want.items()}
