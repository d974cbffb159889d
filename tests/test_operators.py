import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators import entries, filters, graph, hygiene, search, sessions, vectors
from tidelog.operators.filters import Filter
from tidelog.plans import registry
from tidelog.plans.retrieval import Index, search_entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    e = entries.classified(entries.entries(spark, SF)).persist()
    yield e
    e.unpersist()


@pytest.mark.parametrize(("bucket", "hidden", "q"), list(itertools.product((None, "saved", "file"), ((), ("voice",)), (None, "the"))))
def test_facets_equal_lists(log, bucket, hidden, q):
    f = Filter(bucket=bucket, hidden=hidden, q=q, sources=("other", "browser", "clipboard"))
    counts = {(r["dimension"], r["value"]): r["n"] for r in filters.facets(log, f).collect()}
    assert counts.get(("total", ""), 0) == filters.matching(log, f).count()
    shown = {v: n for (d, v), n in counts.items() if d == "bucket"}
    for v, n in shown.items():
        assert n == filters.matching(log, Filter(bucket=v, q=q, sources=f.sources)).count()
    assert sum(shown.values()) == counts.get(("all", ""), 0)
    assert filters.matching(log, Filter(bucket="nowhere")).count() == 0


def test_point_lookups_keep_order(log):
    assert [r["id"] for r in filters.by_ids(log, [7, 3, 5, 10**9]).collect()] == [7, 3, 5]


def test_sessions_fold(spark):
    minute = 60_000_000
    one = [(0, "a", "x"), (120, "a", "x"), (240, "b", "y"), (270, "a", "x"), (360, "a", "x")]
    df = spark.createDataFrame([("k", i, s, a, t) for i, (s, a, t) in enumerate(one)], "u string, i long, s long, app string, t string").withColumn("at", F.timestamp_seconds("s"))
    got = [tuple(r) for r in sessions.focus_sessions(df, "u", "at", "app", "t", "i").collect()]
    assert got == [("k", "a", "x", 0, 11 * minute, 5)]  # the glance at b and the return fold in
    data = [(1, i, 60 * at, app) for i, (at, app) in enumerate([(0, "a"), (1, "a"), (60, "a"), (61, "b"), (70, "b")])] + [(2, 9, 0, "a")]
    df = spark.createDataFrame(data, "u long, i long, s long, app string").withColumn("at", F.timestamp_seconds("s")).withColumn("t", F.lit("w"))
    got = {(r["key"], r["app"], r["start_us"] // minute, r["end_us"] // minute) for r in sessions.focus_sessions(df, "u", "at", "app", "t", "i").collect()}
    assert got == {(1, "a", 0, 6), (1, "a", 60, 61), (1, "b", 61, 75), (2, "a", 0, 5)}
    spans = {(r["u"], r["app"]): r["secs"] for r in sessions.app_spans(df, "u", "at", "app", "i").collect()}
    assert spans[(1, "a")] == 60 + 300 + 60
    assert spans[(2, "a")] == 0


def walked(rows, heartbeat, glance):
    """Sessions of one key's (second, app, title), in order, row by row."""
    blocks = []
    for at, app, title in rows:
        if blocks and blocks[-1]["is"] == (app, title) and at - blocks[-1]["seen"] <= heartbeat:
            blocks[-1]["seen"], blocks[-1]["n"] = at, blocks[-1]["n"] + 1
        else:
            blocks.append({"is": (app, title), "from": at, "seen": at, "n": 1})
    out = []
    for b, after in zip(blocks, [*blocks[1:], None], strict=True):
        until = max(b["seen"], min(b["seen"] + heartbeat, after["from"] if after else b["seen"] + heartbeat))
        open_ = bool(out) and b["from"] - out[-1][3] <= heartbeat
        joins = open_ and (b["is"] == out[-1][:2] if b["is"][0] == out[-1][0] else until - b["from"] < glance)
        if joins:
            out[-1] = (*out[-1][:3], until, out[-1][4] + b["n"])
        else:
            out.append((*b["is"], b["from"], until, b["n"]))
    return out


def test_sessions_against_a_walk(spark):
    rng = random.Random(8)
    keys = {}
    for k in range(40):
        at, rows = 0, []
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice((0, 5, 20, 40, 70, 200, 290, 310, 900))
            rows.append((at, rng.choice("aab"), rng.choice("xy")))
        keys[k] = rows
    data = [(k, i, *row) for k, rows in keys.items() for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "u long, i long, s long, app string, t string").withColumn("at", F.timestamp_seconds("s"))
    got = {}
    for r in sessions.focus_sessions(df, "u", "at", "app", "t", "i").orderBy("start_us", "end_us").collect():
        got.setdefault(r["key"], []).append((r["app"], r["title"], r["start_us"] // 1_000_000, r["end_us"] // 1_000_000, r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(walked(rows, 300, 60)) for k, rows in keys.items()}


def test_segmenter():
    def run(flags):
        s = sessions.Segmenter("k", 2, 3, 2, 100, 1)
        out = [x for k, f in enumerate(flags) if (x := s.feed(k, f == "1"))]
        return out + [x for x in [s.end()] if x]

    assert run("0010000") == []
    assert run("00110000000") == [("k", 1, 6, 2)]
    assert run("0011") == [("k", 1, 3, 2)]


def test_overlap(spark):
    c = spark.createDataFrame([("k", 1, 0.0, 10.0), ("k", 2, 100.0, 100.1), ("k", 3, 55.0, 130.0)], "key string, chunk int, start double, end double")
    s = spark.createDataFrame([("k", "a", 0.0, 4.0), ("k", "b", 4.0, 9.0), ("k", "b", 58.0, 61.0), ("k", "a", 61.0, 65.0), ("k", "a", 100.0, 101.0)], "key string, speaker string, start double, end double")
    got = {r["chunk"]: (r["speaker"], r["secs"]) for r in sessions.overlap_speakers(c, s, "key", "chunk").collect()}
    assert got == {1: ("b", 5.0), 3: ("a", 5.0)}


def test_search_tiers(spark):
    docs = [(1, "apple pie recipe", 1), (2, "apple tart", 2), (3, "pie crust", 3), (4, "unrelated words", 4), (5, "会议记录", 5)] + [(k, "filler text", k) for k in range(10, 50)]
    e = spark.createDataFrame(docs, "id long, text string, n long").withColumn("title", F.lit("")).withColumn("created_at", F.timestamp_seconds("n"))
    index = Index(e)
    ids = lambda q: [r["id"] for r in index.search(q).orderBy("tier", "rank").collect()]
    assert ids("apple pie") == [1]
    assert ids("apple crust") == [3, 2, 1]  # no record has both: rare co-hits, the rarest term first, then newest
    assert ids("appl") == [2, 1]
    assert ids("nothing") == []
    assert ids("会议") == [5]
    assert [r["id"] for r in search.phrase(index.post, ["apple", "tart"]).collect()] == [2]
    assert ids("pie-recipe") == [1]  # written as one word: side by side
    assert ids("recipe-pie") == [1]  # not side by side, but both
    assert search.query_phrases("the well-known pie") == [("well", "known"), ("pie",)]
    more = e.unionByName(spark.createDataFrame([(60, "pie in the sky", 60)], "id long, text string, n long").withColumn("title", F.lit("")).withColumn("created_at", F.timestamp_seconds("n"))).where("id <> 3")
    fresh = index.refreshed(more, spark.createDataFrame([(3,), (60,)], "id long"))
    assert sorted(map(tuple, fresh.post.select("term", "id", F.to_json("positions")).collect())) == sorted(map(tuple, Index(more).post.select("term", "id", F.to_json("positions")).collect()))
    assert fresh.total == more.count()


def test_all_fields_are_searched(spark):
    e = spark.createDataFrame([(1, "t", "x", ["blue", "red"], "Safari", "http://ex.org/q", "error"), (2, "t", "x", ["green"], "Notes", None, None)], "id long, title string, text string, tags array<string>, app string, url string, status string")
    got = {(r["term"], r["id"]) for r in search.postings(e).collect()}
    assert got == {("t", 2), ("x", 2), ("green", 2), ("notes", 2)}  # failed records aren't searched


def test_terms(spark):
    assert search.query_terms("the of") == ["the", "of"]
    assert search.query_terms("Where is the Pie 会议室") == ["pie", "会议", "议室"]


def test_whole_texts_count(spark):
    long = "".join(chr(97 + k % 26) + str(k) + " " for k in range(6000)) + "zebra🦓 end"
    e = spark.createDataFrame([(1, long), (2, "zebra"), (3, "other")], "id long, text string")
    cut = [r["chunk"] for r in e.where("id = 1").select(F.inline(text.chunks(F.col("text")))).orderBy("seq").collect()]
    last = -(-(len(long) - 220) // 180)
    assert cut == [long[180 * k : 180 * k + 220] for k in range(last + 1)]
    assert [len(r["c"]) for r in e.orderBy("id").select(text.chunks(F.col("text"), most=10).alias("c")).collect()] == [10, 0, 0]
    for c in ("title", "path", "url", "type"):
        e = e.withColumn(c, F.lit(""))
    e = e.withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    assert {r["id"] for r in search.recall_scores(e, ["zebra"], "2024-03-01").collect()} == {1, 2}
    assert {r["id"] for r in search.recall_scores(e, ["zebra"], "2024-03-01", chars=20_000).collect()} == {2}


def test_blend_and_fusion(spark):
    def blended(found, shaped, scanned, keep):
        legs = [(leg, k, i) for leg, ids in (("found", found), ("shape", shaped), ("scan", scanned)) for k, i in enumerate(ids)]
        return [r["id"] for r in search.blend(spark.createDataFrame(legs, "leg string, rank int, id long"), keep).orderBy("place").collect()]

    assert blended([1, 2, 3], [9, 1], [5], 4) == [9, 1, 2, 3]
    rng = random.Random(3)
    for _ in range(8):
        found, shaped, scanned = lists = [rng.sample(range(40), rng.randint(0, 20)) for _ in range(3)]
        first = shaped[:5]
        second = [i for i in found if i not in first][:6]
        whole = list(dict.fromkeys([*first, *second, *scanned, *found, *shaped]))
        assert blended(*lists, 10) == whole[:10]
    only = spark.createDataFrame([("vector", 0, 1)], "leg string, rank int, id long")
    assert search.rrf(only, required="lexical").count() == 0


@pytest.mark.parametrize(("question", "shape"), [
    ("where is the venue", "postcode"), ("his address please", "postcode"), ("when does it start", "time"), ("how much was the fee", "money"), ("the model number of the screen", "code"),
    ("which model runs here", ""), ("停车多少钱", "money"), ("显示器是什么型号", "code"), ("哪个模型好", ""), ("几点出发", "time"), ("tell me about it", ""), ("somewhere over the rainbow", ""),
])
def test_shapes_of_questions(question, shape):
    assert search.shape_of(question) == shape


def test_search_entries_skips_errors(log):
    got = search_entries(log, "the", limit=500)
    assert got.count() == 100
    assert got.join(log.where("status = 'error'"), "id").count() == 0
    assert search_entries(log, "", limit=3).count() == 3


def test_vectors(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(k, v) for k, v in enumerate(base)] + [(100 + k, [x + rng.gauss(0, 0.02) for x in v]) for k, v in enumerate(base)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    b = vectors.buckets(v, 8, *vectors.lsh_shape(120, 0.95))
    pairs = {(r["a"], r["b"]) for r in vectors.pairs_above(v, b, 0.95, hot=5).collect()}
    assert len({(k, 100 + k) for k in range(60)} - pairs) <= 3
    assert vectors.top_k(v, base[0], 2).first()["id"] in (0, 100)
    one = v.withColumn("k", F.lit(1))
    lead = {r["id"]: r["leader"] for r in vectors.leader_clusters(one, "k", "id").collect()}
    assert all(lead[100 + k] is not None for k in range(60))
    hops = {r["id"]: r["hop"] for r in vectors.neighbourhood(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), [1]).collect()}
    assert hops == {1: 0, 2: 1, 3: 2}


def test_lsh_shape_keeps_its_bound():
    for n in (0, 100, 10**4, 10**5, 10**6, 10**7, 10**9):
        for floor in (0.5, 0.7, 0.95):
            bits, tables = vectors.lsh_shape(n, floor)
            p = 1 - math.acos(floor) / math.pi
            assert (1 - p**bits) ** tables <= 0.1, (n, floor)


@pytest.mark.parametrize(("n", "hot"), [(300, 4000), (300, 20), (1500, 200)])
def test_link_components(spark, n, hot):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n // 5, 16))
    data = [[float(y) for y in base[k % len(base)] + rng.standard_normal(16) * 0.45] for k in range(n)]
    data += [data[0]] * 7 + [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [0.0] * 16, None, [float("nan")] * 16]  # copies, another dimension, no direction
    want = brute_links(data, 0.7)
    v = spark.createDataFrame(list(enumerate(data)), "id long, v array<double>").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.link_components(v, 0.7, per_bucket=n // 8, hot=hot).collect()}
    assert set(got) == set(range(len(data)))
    assert all(got[k][0] <= want[k][0] for k in got)
    assert sum(x[0] for x in got.values()) >= 0.985 * sum(x[0] for x in want)
    assert sum(got[k][1] == want[k][1] for k in got) >= 0.97 * len(data)
    assert got[n + 7][0] == got[n + 8][0] == 1 and got[n + 8][1] == n + 7
    assert [got[k] for k in range(n + 9, n + 12)] == [(0, k) for k in range(n + 9, n + 12)]


def brute_links(data, floor):
    good = [k for k, x in enumerate(data) if x is not None and any(x) and x == x and not np.isnan(x).any()]
    counts, root = [0] * len(data), list(range(len(data)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {k: np.array(data[k]) / np.linalg.norm(data[k]) for k in good}
    for a, b in itertools.combinations(good, 2):
        if len(data[a]) == len(data[b]) and round(float(unit[a] @ unit[b]), 6) >= floor:
            counts[a] += 1
            counts[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [(counts[k], find(k)) for k in range(len(data))]


def with_check(body, digits, good):
    return next(body + d for d in digits if good(body + d))


def luhn(s):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(s))) % 10 == 0


def id18(s):
    return "10X98765432"[sum(int(d) * 2 ** (17 - k) for k, d in enumerate(s[:17])) % 11] == s[17]


MC = with_check("222100000000000", "0123456789", luhn)  # the newer range of this issuer
VISA = with_check("411111111111111", "0123456789", luhn)
ID = with_check("11010519900307051", "0123456789X", id18)
BAD_ID = with_check("11010519901307051", "0123456789X", id18)  # month 13
AMEX = with_check("37828224631000", "0123456789", luhn)


def fake(prefix, n, alphabet="aB3dE5gH7"):
    """A string of the right shape that is no one's key."""
    return prefix + (alphabet * n)[:n]


def iban(country, rest):
    """With the check digits that make it valid, by remainder 97."""
    number = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{country}{98 - number % 97:02d}{rest}"


def fours(s):
    return " ".join(s[k : k + 4] for k in range(0, len(s), 4))


DE, NL = iban("DE", "500105175407324931"), iban("NL", "QQQQ0417164300")
BAD_DE = DE[:2] + f"{(int(DE[2:4]) + 1) % 97:02d}" + DE[4:]
REDACTED = [
    (f"paid with {fours(VISA)}, not {VISA[:-1]}{(int(VISA[-1]) + 1) % 10}", f"paid with [card number], not {VISA[:-1]}{(int(VISA[-1]) + 1) % 10}", {"card": 1}),
    (f"{MC}; {MC}", "[card number]; [card number]", {"card": 2}),
    (f"{AMEX[:4]}-{AMEX[4:10]}-{AMEX[10:]} or {AMEX[:4]} {AMEX[4:10]}-{AMEX[10:]}", f"[card number] or {AMEX[:4]} {AMEX[4:10]}-{AMEX[10:]}", {"card": 1}),
    (f"0000000000000000 and 12.{VISA} and 20240305060708", None, {}),
    (f"at https://tide.example/boats/{VISA}?page=2", None, {}),
    (f"at https://tide.example/boats/{VISA} or {VISA}", f"at https://tide.example/boats/{VISA} or [card number]", {"card": 1}),
    (f"number {ID}, wrong: {BAD_ID}", f"number [id number], wrong: {BAD_ID}", {"id": 1}),
    (f"MODEL_KEY={fake('sk-', 24)}", "MODEL_KEY=[api key]", {"key": 1}),
    (fake("AKIA", 16, "QRST2345"), "[api key]", {"key": 1}),
    (f"{fake('ghp_', 36)} {fake('ghp_', 20)}", f"[api key] {fake('ghp_', 20)}", {"key": 1}),
    (fake("rk_" + "test_", 24), "[api key]", {"key": 1}),
    (f"{fake('glpat-', 20)}, {fake('hf_', 34)}, {fake('npm_', 36)}, {fake('AIza', 35)}, {fake('xoxb-', 12)}", "[api key], [api key], [api key], [api key], [api key]", {"key": 5}),
    (".".join([fake("eyJ", 9), fake("", 10), fake("", 11)]), "[api key]", {"key": 1}),
    ("sk-boats are quick, Bearer of news", None, {}),
    (f"X-Auth: Bearer {fake('', 20)}", "X-Auth: Bearer [api key]", {"key": 1}),
    ("amqp://tide:lowwater9@queue.example:5672/log", "amqp://tide:[secret]@queue.example:5672/log", {"secret": 1}),
    ("passphrase: seven-seals, passphrase: no", "passphrase: [secret] passphrase: no", {"secret": 1}),
    ("口令：Chao2024xi", "口令：[secret]", {"secret": 1}),
    ("api key = 'harbour-wall-7'", "api key = '[secret]'", {"secret": 1}),
    ("SIGNING_KEY=harbourwall77", "SIGNING_KEY=[secret]", {"secret": 1}),
    ("tide_token_of_day=harbour/wall/77", "tide_token_of_day=[secret]", {"secret": 1}),
    ("key: under the mat", None, {}),
    ("https://tide.example/a?share_token=Qx7harbour&from=log", "https://tide.example/a?share_token=[secret]&from=log", {"secret": 1}),
    ("动态码为 204816，请勿转发", "动态码为 [code]，请勿转发", {"code": 1}),
    ("your security code: 77120", "your security code: [code]", {"code": 1}),
    ("-----BEGIN EC PRIVATE KEY-----\nQUJD\n-----END EC PRIVATE KEY-----", "[private key]", {"pem": 1}),
    (f"{fours(DE)} or {NL} or {BAD_DE}", f"[iban] or [iban] or {BAD_DE}", {"iban": 2}),
    ("mail harbour.master@tide.example.net", "mail [email]", {"email": 1}),
    ("15900001111, 07911 000111, +49 30 0000 1111, (202) 555-0111", "[phone], [phone], [phone], [phone]", {"phone": 4}),
    ("Quay Road, ZE1 0AA; €12 2023-11-02T07:08:09.010Z 2718281828-459-045.mov", None, {}),
]


def test_redaction(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(REDACTED)] + [(1000, None), (1001, "")]
    e = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in hygiene.redact(e, "all").collect()}
    for k, (t, want, hits) in enumerate(REDACTED):
        assert (got[k]["masked"], got[k]["hits"]) == (want or t, hits)
    assert got[1000]["masked"] == got[1001]["masked"] == "" and got[1000]["hits"] == {}
    by_default = {r["id"]: r["x"] for r in e.select("id", hygiene.masked(F.col("text")).alias("x")).collect()}
    for k, (t, want, hits) in enumerate(REDACTED):
        assert by_default[k] == (t if {"email", "phone"} & hits.keys() else want or t)
    assert e.where("id = 0").select(hygiene.masked(F.col("text"), "off").alias("x")).first()["x"] == REDACTED[0][0]
    with pytest.raises(ValueError, match="level"):
        hygiene.redact(e, "some")


def test_stripped(spark):
    menu = "\n".join(["Home", "About", "Help", "Shop", "News"])
    body = "\n".join(f"A whole sentence that is long enough to stay in the text, number {k}." for k in range(20))
    share = "Share\n" * 5
    e = spark.createDataFrame([(1, f"{menu}\n{body}"), (2, menu), (3, None), (4, f"{share}{body}\n  Accept Cookies "), (5, "Home\n\nHome\nand away")], "id long, text string")
    fur = spark.createDataFrame([("accept cookies", 9)], "line string, df long")
    got = {r["id"]: (r["view"], r["text"]) for r in hygiene.stripped(e, fur).collect()}
    assert got == {r["id"]: (r["view"], r["text"]) for r in hygiene.stripped(e, fur, in_tasks=0).collect()}  # by a join
    assert {r["id"] for r in hygiene.stripped(e).collect()} == set(got)
    assert got == {1: ("full", body), 2: ("full", menu), 3: ("full", ""), 4: ("full", body), 5: ("full", "Home\nand away")}  # short records have no menus
    learnt = hygiene.furniture(spark.createDataFrame([(k, f"Accept  cookies\n{k}0\n12") for k in range(3)], "id long, text string"))
    assert [tuple(r) for r in learnt.collect()] == [("accept cookies", 3)]


def test_components_and_graph(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 200: 100, 300: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    labels = graph.label_propagation(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (8, 9, 1.0)], "a long, b long, weight double"), 4)
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got[1] == got[2] == got[3]
    path = graph.label_propagation(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a long, b long, weight double"), 5)
    assert {r["node"]: r["label"] for r in path.collect()} == {1: 1, 2: 1, 3: 1}  # two sides don't swap
    a = graph.aliases(spark.createDataFrame([("north river bridge",), ("river",), ("rive",)], "key string"))
    assert [(r["whole"], r["part"]) for r in a.collect()] == [("north river bridge", "river")]


def test_components_of_all_lines(spark):
    rows = [(r["s"], r["o"]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey AS s", "l_orderkey AS o").collect()]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for s, o in rows:
        low, high = sorted((find(2 * s), find(2 * o + 1)))
        root[high] = low
    got = {r["node"]: r["root"] for r in registry.page_components_all(spark, SF).collect()}
    assert got == {k: find(k) for k in list(root)}
    assert len(got) == len({s for s, _ in rows}) + len({o for _, o in rows})


def test_upsert_and_copies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, v string")
    got = {r["k"]: (r["v"], r["op"]) for r in entries.upsert(old, new, "k", ["v"]).collect()}
    assert got == {1: ("a", "keep"), 2: ("c", "update"), 3: (None, "same"), 4: ("d", "insert")}
    rows = spark.createDataFrame([(1, 0, "x"), (2, 60, "x"), (3, 400, "x"), (4, 10, "y")], "id long, s long, t string").withColumn("at", F.timestamp_seconds("s"))
    assert [r["id"] for r in hygiene.recent_copies(rows, F.col("t"), "at", "id").collect()] == [2]
