from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text, urls
from tidelog.plans.dates import chinese_number, parse_range, range_word

TODAY = date(2026, 9, 4)  # a Friday


@pytest.mark.parametrize(("q", "first", "last"), [
    ("what did I do yesterday", "2026-09-03", "2026-09-03"), ("today", "2026-09-04", "2026-09-04"), ("the day before yesterday", "2026-09-02", "2026-09-02"),
    ("notes of last week", "2026-08-24", "2026-08-30"), ("this week", "2026-08-31", "2026-09-04"), ("last month", "2026-08-01", "2026-08-31"), ("this month", "2026-09-01", "2026-09-04"),
    ("past 3 days", "2026-09-02", "2026-09-04"), ("last 2 weeks", "2026-08-22", "2026-09-04"), ("recent 2 months", "2026-07-07", "2026-09-04"), ("seen recently", "2026-08-29", "2026-09-04"),
    ("2026-08-03 to 2026-08-01", "2026-08-01", "2026-08-03"), ("9月2日", "2026-09-02", "2026-09-02"), ("最近十五天", "2026-08-21", "2026-09-04"), ("上周", "2026-08-24", "2026-08-30"),
])
def test_ranges(q, first, last):
    r = parse_range(q, TODAY)
    assert (r.first.isoformat(), r.last.isoformat()) == (first, last)
    assert all(w not in r.rest(q) for w in r.words)


def test_no_range():
    assert parse_range("where is the receipt", TODAY) is None
    assert parse_range("13月40日", TODAY) is None
    assert range_word("", TODAY) is None
    assert range_word("w7", TODAY) == (date(2026, 8, 29), TODAY)
    assert [chinese_number(x) for x in ("三", "十", "十五", "二十", "九十九", "百", "7")] == [3, 10, 15, 20, 99, None, 7]


def value(spark, column, **data):
    frame = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data)) if data else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_text(spark):
    c = F.col("t")
    cases = [
        (text.squeeze(c), " a  \n b ", "a b"), (text.squeeze(c), None, ""), (text.tidy_title(c), "(3) ⠙ build  — 80x24", "build"), (text.has_words(c), "会议记录", True),
        (text.has_words(c), "one", False), (text.note_title(c), "short\nrest", "short"), (text.card_ok(c), "4111 1111 1111 1111", True), (text.card_ok(c), "4111 1111 1111 1112", False),
        (text.iban_ok(c), "GB82 WEST 1234 5698 7654 32", True), (text.iban_ok(c), "GB82 WEST 1234 5698 7654 33", False), (text.id18_ok(c), "11010519491231002X", True),
        (text.id18_ok(c), "110105194912310021", False), (text.menuish(c), "Home", True), (text.menuish(c), "This is a sentence.", False), (text.iban_ok(c), None, False),
    ]
    for column, given, want in cases:
        assert value(spark, column, t=given) == want, (given, want)
    assert value(spark, text.trim_window_title(F.col("t"), F.col("a")), t="Notes - Editor", a="Editor") == "Notes"
    assert value(spark, text.trim_window_title(F.col("t"), F.col("a")), t="Editor", a="Editor") == ""
    assert [x["seq"] for x in value(spark, text.chunks(c), t="ab " * 200)] == [0, 1, 2, 3]
    assert value(spark, text.chunks(c), t=None) == []


def test_urls(spark):
    c = F.col("t")
    cases = [
        (urls.host(c), "https://www.Example.co.uk:80/a", "example.co.uk"), (urls.base_host(c), "https://a.b.example.co.uk/x", "example.co.uk"), (urls.base_host(c), "https://a.example.com", "example.com"),
        (urls.site(c), "https://gist.github.com/x", "GitHub"), (urls.site(c), None, ""), (urls.norm_url(c), "http://a.b/c/#x", "http://a.b/c"), (urls.norm_url(c), "ftp://a", ""),
        (urls.canonical_url(c), "https://a.b/c/?utm_source=1&id=2#x", "https://a.b/c?id=2"), (urls.canonical_url(c), "https://a.b/c?fbclid=1", "https://a.b/c"),
        (urls.media_kind(c), "https://a/b.M3U8?x", "stream"), (urls.media_kind(c), "https://a/b", None), (urls.is_url(c), "a.example/x", True), (urls.is_url(c), "no url", False),
        (urls.clean_title(c), "A long enough title | Site", "A long enough title"), (urls.html_to_text(c), "<p>a &amp; b</p><script>x</script><p>c", "a & b\nc"), (urls.safe_name(c), "a/b:c", "a_b_c"),
    ]
    for column, given, want in cases:
        assert value(spark, column, t=given) == want, (given, want)
    link = value(spark, urls.parse_deep_link(urls.deep_link("entry", F.col("t"))), t="a b/c")
    assert (link["kind"], link["id"]) == ("entry", "a b/c")


def test_entities_and_recognised_text(spark):
    assert value(spark, urls.decode_entities(F.col("c")), c="a&nbsp;b &lt;&#65;&#x1F600;&#xD800; &amp;lt; &#20013;") == "a b <A😀&#xD800; &lt; 中"
    page = """<head><title>A &amp; B</title><meta content="It&#39;s short" name="description"></head>"""
    assert (value(spark, urls.html_title(F.col("c")), c=page), value(spark, urls.html_description(F.col("c")), c=page)) == ("A & B", "It's short")
    assert value(spark, urls.html_description(F.col("c")), c='<meta property="og:description" content="x">') == "x"
    assert value(spark, text.clean_text(F.col("c")), c="会 议 室 a b") == "会议室 a b"
    one, two = F.lit(7).cast("long"), F.lit(4).cast("long")
    assert value(spark, text.hamming(one, two)) == 2 and value(spark, text.hamming(one, two, F.lit("a"), F.lit("b"))) is None


def test_composed_and_decomposed_are_one(spark):
    import unicodedata

    texts = ["Caf\u00e9 quay", "Cafe\u0301 quay", "\uac00", "\u1100\u1161", "\u212b", "plain", "", None, "\u0300", "q\u0307\u0323", "\U0001d15e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", "t", text.nfc(F.col("t")).alias("n"), text.copy_identity(F.lit("text"), F.col("t")).alias("i")).collect()
    for r in rows:
        assert r["n"] == (None if r["t"] is None else unicodedata.normalize("NFC", r["t"]))
    same = {r["k"]: r["i"] for r in rows}
    assert same[0] == same[1] and same[2] == same[3] and same[0] != same[5]


def test_windows_and_reading_texts(spark):
    long = "word " * 40 + "harbour bell rings at low water " + "tail " * 40
    got = value(spark, text.window_around(F.col("c"), ("bell", "rings"), 60), c=long)
    assert got.startswith("…") and "bell" in got and got[1:5] == "word" and len(got) == 61
    assert value(spark, text.window_around(F.col("c"), ("bell",), 60), c="short bell") == "short bell"
    assert value(spark, text.window_around(F.col("c"), ("none",), 10), c="no such word here") == "no such wo"
    assert value(spark, text.window_around(F.col("c"), (), 10), c="no such word here") == "no such wo"
    assert value(spark, text.window_around(F.col("c"), ("x",), 30), c="a" * 100 + "x" + "b" * 50) == "…" + "a" * 10 + "x" + "b" * 19
    assert value(spark, text.reading_text(F.lit(" T "), F.col("c"), F.lit("sum")), c=" a  b ") == "T。a b"
    assert value(spark, text.reading_text(F.lit(""), F.col("c"), F.lit("sum mary")), c=" ") == "sum mary"
    assert value(spark, text.reading_text(F.lit("T"), F.col("c")), c=None) == "T"


def test_lists_of_chats(spark):
    from tidelog.operators import media

    rows = [(1, 5, 9), (2, 7, 7), (3, 6, 9), (4, 6, None), (None, 9, 9), (5, 5, 9)]
    chats = spark.createDataFrame(rows, "id long, created_at long, updated_at long")
    assert [r["id"] for r in media.chats_listed(chats, 4).collect()] == [3, 5, 1, 2]


@pytest.mark.parametrize(("page", "found", "want"), [
    ("https://x.com/quay/status/12/photo/1?s=20&t=ab#top", None, "https://x.com/quay/status/12"),
    ("https://x.com/home", "https://x.com/quay/status/7/analytics", "https://x.com/quay/status/7"),
    ("https://x.com/quay/status/12", "https://x.com/other/status/9", "https://x.com/quay/status/12"),
    ("https://www.xiaohongshu.com/explore/6a?xsec_token=k1&utm_source=z", None, "https://www.xiaohongshu.com/explore/6a?xsec_token=k1"),
    ("https://tide.example/a/likes?si=1", None, "https://tide.example/a/likes"), ("https://tide.example/", "mailto:x", "https://tide.example"), ("", None, ""),
])
def test_addresses_of_posts(spark, page, found, want):
    made = urls.post_url(F.col("c")) if found is None else urls.post_url(F.col("c"), F.lit(found))
    assert value(spark, made, c=page) == want
