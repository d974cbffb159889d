"""Titles, pages, the workspace, what comes in, and queries without SQL, against fixtures and plain Python."""

import random
import math
import re
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.functions import titles
from tidelog.functions import text as T
from tidelog.operators import days, graph, media, pages, sessions, vectors
from tidelog.plans import registry, retrieval, workspace
from tidelog.sources import files

SF = "/root/testdata/sf0.001"


def column(spark, f, values, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r["x"] for r in frame.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_titles(spark):
    assert column(spark, titles.is_placeholder, ["Screenshot 10:32", "截图 9:05", "", None, "Screenshot of it", "Note 1"]) == [True, True, True, True, False, False]
    assert column(spark, titles.meaty, ["I am", "；木##；: 41", "07:15 3个", "07:15 low tide", "Go History Harbour", "潮水表已更新", "Tide table for May", "ok", "** // quay !!", "Edit the log"]) == [False, False, False, True, False, True, True, False, False, True]
    assert column(spark, titles.strip_lead, ["◆ 月 ↑ » Quay notes", "(12) Tide mail", "3月4日 sailing", "~~~", "» (2) x “Low water”", None]) == ["Quay notes", "Tide mail", "3月4日 sailing", "~~~", "Low water”", ""]
    long = ["Boats that lie dry at low water must be moored fore and aft in the harbour", "Boats lie dry at low water near the old quay stairs, on an hour"]
    assert column(spark, titles.clip_title, [*long, "short one", "x" * 70, "潮" * 12 + "，" + "水" * 9 + " " + "汐" * 9]) == [
        "Boats that lie dry at low water must be moored fore and aft…", "Boats lie dry at low water near the old quay stairs, on an…", "short one", "x" * 60 + "…", "潮" * 12 + "，" + "水" * 9 + "…"]
    rows = [("Screenshot 10:32", "first line of text\nmore", "Inbox of the day", "Mail", ["walk", "river"]), ("Screenshot 10:32", "88\nfirst line of text", "Mail", "Mail", None), ("mine", "x", "Window", "App", None), ("", "88", None, None, ["walk", "river", "ultra", "more"])]
    e = spark.createDataFrame(rows, "title string, text string, window string, app string, tags array<string>")
    got = [r["t"] for r in e.select(titles.auto_title(F.col("title"), F.col("text"), F.col("window"), F.col("app"), tags=F.col("tags")).alias("t")).collect()]
    assert got == ["Inbox of the day", "first line of text", "mine", ""]
    picture = spark.createDataFrame([([(0.0, 0.0, 9.0, 40.0, 50.0, "Huge but unsure"), (0.0, 9.0, 9.0, 20.0, 99.0, "Big heading here"), (0.0, 30.0, 9.0, 10.0, 99.0, "small text")],)], "lines array<struct<x:double,y:double,w:double,h:double,conf:double,text:string>>")
    assert picture.select(titles.from_picture(F.col("lines")).alias("t")).first()["t"] == "Big heading here"
    assert column(spark, titles.from_tags, [["ab'", "i'm", "walk"], ["challenge", "thames"], ["one"], None], "array<string>") == [None, "challenge · thames", None, None]
    assert column(spark, titles.self_contained, ["地址是多少", "我最近在看二手显示器都看了些什么", "what is it", "one two three four five six seven eight nine eleven words here"]) == [False, True, False, True]
    names = F.create_map(F.lit("1"), F.lit("dog"), F.lit("2"), F.lit("cat"))
    assert column(spark, lambda c: titles.label_names(c, names), ["1, 2", "3,1", "", None]) == ["dog, cat", "3, dog", "", ""]
    some = spark.createDataFrame([("words", "sum", "lab"), ("12", "sum", "lab"), (None, " ", "lab")], "t string, s string, l string")
    assert [r[0] for r in some.select(titles.describing(F.col("t"), F.col("s"), F.col("l"))).collect()] == ["words", "sum", "lab"]
    assert some.select(titles.head_of(F.col("t"), F.col("s"), F.col("l"))).first()[0] == "words\nsum\nlab"


def test_pages(spark):
    assert column(spark, pages.title_key, ["Find in page The  Thames path", "abc", "Google Maps", "(3) Ultra walk", None]) == ["The Thames path", "", "", "Ultra walk", ""]
    clips = [(1, "http://a.org/x#top", "Thames path"), (2, "", "Thames path"), (3, "http://a.org/x/", ""), (4, "", "Other page"), (5, "", ""), (6, "ftp://z", "abc")]
    c = spark.createDataFrame(clips, "id long, url string, title string").select("id", pages.page_keys(F.col("url"), F.col("title")).alias("keys"))
    own = spark.createDataFrame([(9, "http://a.org/x", "Whatever title")], "id long, url string, title string").select("id", pages.page_keys(F.col("url"), F.col("title")).alias("keys"))
    nodes = pages.page_nodes(c, own)
    of = {(r["id"], r["owns"]): r["page"] for r in nodes.collect()}
    assert of[1, False] == of[2, False] == of[3, False] == of[9, True] != of[4, False] and len(of) == 5
    e = spark.createDataFrame([(k, 100 - k) for k in range(10)], "id long, s long").withColumn("created_at", F.timestamp_seconds("s"))
    assert [(r["id"], r["place"]) for r in pages.page_clips(nodes, e).where(F.col("page") == of[1, False]).orderBy("place").collect()] == [(3, 1), (2, 2), (1, 3)]
    assert {r["id"] for r in pages.page_owner(nodes).collect()} == {9}
    assert {r["id"]: r["page"] for r in pages.page_of(nodes).collect()}[9] == of[9, True]
    assert {(r["other"], r["owns"]) for r in pages.same_page(nodes, spark.createDataFrame([(2,)], "id long")).collect()} == {(1, False), (3, False), (9, True)}
    assert pages.same_page(nodes, spark.createDataFrame([(2,)], "id long"), most=3).count() == 0
    seen = spark.createDataFrame([("2024-01-05", "http://a/1", "Thames walk", "x"), ("2024-01-06", "http://a/2", "Other", "the thames"), ("2023-01-01", "http://a/3", "Thames", "walk")], "at string, url string, title string, text string").withColumn("at", F.to_timestamp("at"))
    assert [(r["url"], r["score"]) for r in pages.find_pages(seen, ["Thames", "walk"], days=180, as_of="2024-01-07").collect()] == [("http://a/1", 4), ("http://a/2", 1)]
    assert [(r["site"], r["pages"], r["share"]) for r in pages.reading(spark.createDataFrame([("http://github.com/a",), ("http://github.com/b",), ("http://x.org/",)], "url string")).collect()] == [("GitHub", 2, 1.0), ("x.org", 1, 0.7071)]
    spans = spark.createDataFrame([("a", 0, 9_000_000), ("b", 0, 5_000_000), ("c", 0, 1_000_000)], "app string, start_us long, end_us long")
    assert [tuple(r) for r in pages.day_head(spans, 2).collect()] == [("1970-01-01", 15.0, "a,b")]


def test_page_nodes_of_all_pages(spark):
    rows = [(r["id"], r["url"], r["title"]) for r in registry._plain_pages(spark, SF).select("id", "url", "title").collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    keys = {}
    for i, url, title in rows:
        t = " ".join(title.split())
        own = [k for k in (re.sub("/+$", "", url.split("#")[0]), t if len(t) >= 4 else "") if k]
        keys[i] = own
        for k in own[1:]:
            root[max(find(own[0]), find(k))] = min(find(own[0]), find(k))
    got = {(r["id"], r["page"]) for r in registry.QUERIES["page_nodes"](spark, SF).where("NOT owns").collect()}
    assert got == {(i, find(own[0])) for i, own in keys.items() if own}


@pytest.fixture(scope="module")
def space(spark):
    return workspace.Workspace(spark, SF)


def test_workspace(spark, space):
    n = space.entries().count()
    assert space.list().count() == n and space.list(limit=7).count() == 7
    assert space.list(bucket="saved").count() == {r["value"]: r["n"] for r in space.stats().where("dimension = 'bucket'").collect()}["saved"]
    one = space.get_entry(3).first()
    assert one["id"] == 3 and one["link"] == "entry/3" and space.get_entry(10**9).count() == 0
    days_ = [r["date_key"] for r in space.days(5).collect()]
    assert days_ == sorted(days_, reverse=True) and len(days_) == 5
    assert space.day(days_[0]).count() == space.days(1).first()["n"]
    assert all(r["pinned"] for r in space.pinned().collect())
    assert space.search("license", limit=5).count() <= 5
    assert space.redact("all").columns[-2:] == ["masked", "hits"]
    assert set(space.stripped().columns) == {"id", "view", "text"}
    assert space.day_stats().count() == space.entries().select("date_key").distinct().count()
    with pytest.raises(ValueError, match="folder or records"):
        workspace.Workspace(spark)
    got = space.ask(["where is the apache license"], date(2024, 3, 1), trail=registry._plain_pages(spark, SF)).collect()
    assert sorted(r["place"] for r in got)[-1] <= 23 and len({(r["kind"], r["ref"]) for r in got}) == len(got)
    echo = space.entries().first()["text"]
    assert space.echo_free([echo]).where(F.col("text") == echo).count() == 0


def test_lists(spark):
    e = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00", "note", "T", "x" * 900, None, None, None), (2, "a", "2024-01-01 11:00:00", "url", "", "y", "Mail", "http://z", None), (3, "a", "2024-01-01 12:00:00", "note", None, "w" * 300, None, None, "f.pdf")], "id long, date_key string, created_at string, type string, title string, text string, app string, url string, path string").withColumn("created_at", F.to_timestamp("created_at"))
    got = [(r["place"], r["id"], r["line"]) for r in workspace.digest(e, 400).orderBy("place").collect()]
    assert [g[:2] for g in got] == [(1, 1), (2, 2), (3, None)]
    assert got[0][2] == "- [2024-01-01 10:00] (note) T | " + "x" * 150
    assert got[1][2] == "- [2024-01-01 11:00] (url)  | from Mail <http://z> | y"
    both = workspace.exact_and_near(e.where("id < 3"), e.where("id > 1"), e)
    assert [tuple(r) for r in both.collect()] == [(3, True), (2, False), (1, False)]
    assert [r["text"] for r in workspace.has_text(e, spark.createDataFrame([(" y ",), ("z",)], "text string")).collect()] == [" y "]
    have = spark.createDataFrame([(1, "h"), (2, "old")], "id long, hash string")
    assert [r["id"] for r in workspace.with_vectors(e, have, F.lit("h")).collect()] == [1]
    apps = spark.createDataFrame([("Zoom", ""), ("Safari", "meet.example.org"), ("Safari", "notexample.org"), ("Notes", "")], "app string, host string")
    assert [tuple(r) for r in workspace.followed(apps, ["zoom", "notes"], ["Notes"], ["example.org"]).collect()] == [("Zoom", ""), ("Safari", "meet.example.org")]
    items = spark.createDataFrame([("a", "image", 100, 10, 10), ("b", "image", 9000, 50, 50), ("c", "video", None, None, None), ("d", "stream", None, None, None)], "url string, kind string, size long, width int, height int")
    assert [r["url"] for r in workspace.media_list(items, least_size=4096).collect()] == ["d", "c", "b"]
    names = spark.createDataFrame([(1, "river", "name", 3), (1, "ab1 2cd", "postcode", 9), (1, "bridge", "name", 2), (2, "river", "name", 3), (2, "tower", "name", 2)], "id long, key string, kind string, df long")
    order = spark.createDataFrame([(2, 0), (1, 1)], "id long, rank int")
    assert [r["key"] for r in workspace.names_in_turn(names, order, 2).orderBy("place").collect()] == ["tower", "ab1 2cd", "river", "bridge"]
    wins = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 95.0, 5.0, 20.0, 20.0), (3, 300.0, 0.0, 5.0, 5.0)], "k long, x double, y double, w double, h double")
    assert [tuple(r) for r in media.on_display(wins, 5, 0, 100, 100).orderBy("k").collect()] == [(1, 0.0, 0.0, 5.0, 10.0), (2, 90.0, 5.0, 10.0, 20.0)]
    boxes = spark.createDataFrame([("p", "outer", 0.0, 0.0, 100.0, 100.0), ("p", "inner", 10.0, 10.0, 10.0, 10.0)], "pic string, box string, x double, y double, w double, h double")
    points = spark.createDataFrame([("p", 12.0, 12.0), ("p", 50.0, 50.0), ("p", 500.0, 0.0)], "pic string, px double, py double")
    assert {(r["px"], r["box"]) for r in media.box_at(boxes, points, "pic").collect()} == {(12.0, "inner"), (50.0, "outer")}
    models = spark.createDataFrame([("a", "f", 2.0, 1.0), ("b", "f", 2.0, 2.0), ("c", "g", 8.0, 3.0), ("d", "h", 99.0, 9.0)], "name string, family string, need_gb double, score double")
    assert {(r["tier"], r["name"]) for r in media.tiers(models, 16).collect()} == {(0, "b"), (1, "c")}
    assert [r["name"] for r in media.among(models, models.where("name = 'c'")).collect()] == ["c"]


def test_planning():
    assert retrieval.planned(["river  walk", "river walk", "where", "x" * 50, "the plan"], ["where", "the"]) == ["river walk", "the plan"]
    assert retrieval.carried_over([[1, 2], [3, 4, 5, 6], [7, 3]]) == [7, 3, 4, 5]


def test_near_related(spark):
    docs = [(1, "river walk tower"), (2, "river walk bridge"), (3, "tower bridge climb"), (4, "tower bridge"), *[(k, f"filler {k}") for k in range(10, 110)]]
    e = spark.createDataFrame(docs, "id long, text string").withColumns({"title": F.lit(""), "created_at": F.timestamp_seconds("id"), "date_key": F.lit("2024-01-01")})
    index = retrieval.Index(e)
    nodes = spark.createDataFrame([(3, "p", False), (10, "p", False)], "id long, page string, owns boolean")
    got = [(r["id"], r["how"]) for r in retrieval.near_related(index, "river walk", date(2024, 1, 2), nodes).collect()]
    assert {g[1] for g in got} <= {"feedback", "page"} and not {1, 2} & {g[0] for g in got}
    chunks = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    got = [(r["id"], r["how"]) for r in retrieval.near_related(index, "x", date(2024, 1, 2), nodes, chunks, [1.0, 0.1]).collect()]
    assert got == [(3, "near"), (10, "page")]


def test_what_comes_in(spark, tmp_path):
    at = F.to_timestamp(F.lit("2024-02-03 10:00:00"))
    texts = spark.createDataFrame([(1, "A line.\nmore"), (2, "https://x.org/a?utm_source=q")], "id long, text string").withColumn("created_at", at)
    path = str(tmp_path / "log")
    files.append_entries(files.notes(texts.where("id = 1")), path)
    files.append_entries(files.copied(texts), path)
    files.append_entries(files.bookmarks(spark.createDataFrame([(3, "x.org/b?utm_source=q", None)], "id long, url string, title string").withColumn("created_at", at)), path)
    files.append_entries(files.recordings(spark.createDataFrame([(4, "a/talk.wav", None)], "id long, path string, text string").withColumn("created_at", at)), path)
    e = spark.read.parquet(path)
    got = Counter((r["id"], r["type"], r["origin"], r["url"], r["pinned"]) for r in e.collect())
    assert got == Counter([(1, "note", None, None, False), (1, "note", "clipboard", None, False), (2, "url", "clipboard", "https://x.org/a?utm_source=q", False), (3, "url", "bookmark", "https://x.org/b", True), (4, "audio", None, None, False)])
    assert {str(r["date_key"]) for r in e.collect()} == {"2024-02-03"}
    better = {r["id"]: r for r in files.enriched(e.where("id > 1").withColumn("title", F.lit(""))).collect()}
    assert better[4]["status"] == "error" and better[2]["title"] == "x.org" and better[2]["url"] == "https://x.org/a"
    lines = e.where("id = 4").select("id", "date_key", F.array(F.lit("one")).alias("lines"))
    files.write_sidecar(lines, str(tmp_path / "side"))
    assert {r["id"]: r["lines"] for r in files.with_sidecar(e, spark.read.parquet(str(tmp_path / "side"))).collect()}[4] == ["one"]
    (tmp_path / "recaps").mkdir()
    (tmp_path / "recaps" / "2024-02-03.md").write_text("a day")
    (tmp_path / "recaps" / "other.md").write_text("no day")
    assert [tuple(r) for r in files.read_recaps(spark, str(tmp_path / "recaps")).collect()] == [("2024-02-03", "a day")]
    names = spark.createDataFrame([("a.zip", ["x.md", "y.txt", "z.html"]), ("b.zip", ["x.md"]), ("c.mbox", None), ("d.md", None), ("e.bin", None)], "name string, members array<string>")
    assert [r[0] for r in names.select(files.sniff(F.col("name"), F.col("members"))).collect()] == ["export", "file", "mail", "text", "file"]


# --- queries that have no SQL -------------------------------------------------------------


def test_hour_groups(spark):
    def folded(hours):
        out = []
        for h, n in sorted(hours):
            if out and out[-1][2] < 50:
                out[-1] = (out[-1][0], h, out[-1][2] + n)
            else:
                out.append((h, h, n))
        return out

    hours = defaultdict(Counter)
    for r in registry._events(spark, SF).select(F.date_format("at", "yyyy-MM-dd").alias("d"), F.hour("at").alias("h")).collect():
        hours[r["d"]][r["h"]] += 1
    got = defaultdict(list)
    for r in registry.QUERIES["hour_groups"](spark, SF).collect():
        got[r["day"]].append((r["first"], r["last"], r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: folded(v.items()) for k, v in hours.items()}


def test_speech_segments(spark):
    rows = defaultdict(list)
    for r in registry._events(spark, SF).orderBy("key", "at", "tie").select("key", "value").collect():
        rows[r["key"]].append(r["value"] > 40)
    want = set()
    for k, flags in rows.items():
        block = 0
        while block < len(flags):
            if block + 1 < len(flags) and flags[block] and flags[block + 1]:  # two in a row start it
                end, quiet = block + 1, 0
                while end + 1 < len(flags) and quiet < 4:
                    end += 1
                    quiet = 0 if flags[end] else quiet + 1
                voiced = sum(flags[block : end + 1])
                if voiced >= 3:
                    want.add((k, max(0, block - 2), end, voiced))
                block = end + 1
            else:
                block += 1
    assert {(r["key"], r["first"], r["last"], r["voiced"]) for r in registry.QUERIES["speech_segments"](spark, SF).collect()} == want


def test_entities(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    index = registry.QUERIES["entity_index"](spark, SF).collect()
    df, per = Counter(r["key"] for r in index), Counter(r["id"] for r in index)
    assert index and max(per.values()) <= 20 and min(df.values()) >= 2
    for r in index:
        assert 2 <= r["df"] <= 30
    together = Counter()
    keys = defaultdict(set)
    for r in index:
        keys[r["id"]].add(r["key"])
    for ks in keys.values():
        together.update((a, b) for a in ks for b in ks if a < b)
    want = {(a, b, n) for (a, b), n in together.items() if n >= 2 and n >= 0.8 * min(df[a], df[b])}
    assert {(r["a"], r["b"], r["n"]) for r in registry.QUERIES["entity_pairs"](spark, SF).collect()} == want


@pytest.mark.parametrize("floor", [0.62, 0.2])
def test_leader_clusters(spark, floor):
    """Every member's leader, by plain loops over each label in the order of ids."""
    rows = sorted((r["label"], r["id"], r["v"]) for r in registry._vectors(spark, SF).collect() if r["v"] is not None)
    leaders, want = defaultdict(list), {}
    for label, i, v in rows:
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        unit = [x / size for x in v]
        best = None
        for name, u in leaders[label]:
            s = sum(a * b for a, b in zip(u, unit, strict=True))
            if s >= floor and (best is None or s >= best[0] - 1e-12):
                best = (s, name)
        if best is None:
            leaders[label].append((i, unit))
        want[i] = best[1] if best else i
    rows = registry.QUERIES["leader_clusters"](spark, SF) if floor == 0.62 else vectors.leader_clusters(registry._vectors(spark, SF), "label", "id", floor=floor)
    assert {r["id"]: r["leader"] for r in rows.collect()} == want
    assert floor == 0.62 or len(set(want.values())) < len(want)


def digits_of(text):
    """Runs of digits, single spaces or dashes between groups allowed, with what stands around them."""
    k = 0
    while k < len(text):
        if text[k].isascii() and text[k].isdigit():
            end = k
            while end < len(text) and text[end].isascii() and text[end].isdigit():
                end += 1
            yield k, end
            k = end
        k += 1


def luhn(s):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(s))) % 10 == 0


def test_redact_counts(spark):
    """All that is found in whole documents, by walking over characters instead of rules: quoted tokens, digit
    runs that are cards or telephone numbers, words with an @."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = Counter()
    for i, t in docs.items():
        for part in t.split('token = "')[1:]:
            want[i, "secret"] += 1 if len(part.split('"')[0]) >= 6 else 0
        for a, b in digits_of(t):
            run, before, after = t[a:b], t[max(0, a - 1) : a], t[b : b + 1]
            word = t[:a].split()[-1] if a and not t[a - 1].isspace() and t[:a].split() else ""
            if 13 <= len(run) <= 19 and before != "." and after != "." and not before.isalpha() and "/" not in word and run[0] in "23456" and len(set(run)) > 1 and luhn(run):
                want[i, "card"] += 1
        for word in t.split():
            if "@" in word and "." in word.split("@")[1]:
                want[i, "email"] += 1
    got = {(r["doc_id"], r["kind"]): r["n"] for r in registry.QUERIES["redact_counts"](spark, SF).collect()}
    assert {k: n for k, n in got.items() if k[1] != "phone"} == {k: n for k, n in want.items() if n}
    shape = lambda w: "".join("9" if c.isdigit() else c for c in w)
    phones = {i: sum(shape(t[k : k + 14]) == "(999) 999-9999" for k in range(len(t) - 13)) for i, t in docs.items()}
    assert {k[0]: n for k, n in got.items() if k[1] == "phone"} == {i: n for i, n in phones.items() if n}


def test_link_components_of_a_table(spark):
    import numpy as np

    rows = [(r["id"], r["v"]) for r in registry._vectors(spark, SF).where("v IS NOT NULL").collect() if r["v"] and any(r["v"])]
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.70
    np.fill_diagonal(links, False)
    got = {r["id"]: r["n_links"] for r in registry.QUERIES["lsh_pairs"](spark, SF).collect()}
    want = {i: int(n) for (i, _), n in zip(rows, links.sum(axis=1), strict=True)}
    assert sum(got.get(i, 0) for i in want) >= 0.98 * sum(want.values())
    assert all(got.get(i, 0) <= n for i, n in want.items())
