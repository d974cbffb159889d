"""Edge cases and brute-force versions: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import embedding_dedup, html_render, licenses, line_dedup, minhash_dedup, mixing, quality, sentencepiece_codec, sharding, substring_dedup
from tidelog.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(400)] + ["été", "漢字", "😀"]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = sentence(30_000)
BASE = sentence(120)
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, BASE), (5, BASE), (6, BASE.upper()), (7, BASE + " tail words"), (8, LONG), (9, LONG + " x"),
    (None, BASE), (10, sentence(15)), (11, "Released under the MIT License.\n" + sentence(30)), (12, "a\nb\na\n\n" + sentence(40)), (13, "\x00 nul ▁ ⁇ <s>"), (14, sentence(25) + "\n" + sentence(25)),
]
EDGE += [(100 + k, f"shared line\n{sentence(30)}\n SHARED LINE ") for k in range(12)]


def frame(spark, rows=EDGE):
    full = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_all_on_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert sentencepiece_codec.round_trip(empty, tokenizer_path()).count() == 0
    assert licenses.scan(empty).count() == 0
    assert quality.judge(empty).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.drop_near_duplicates(empty).count() == 0
    assert embedding_dedup.near_duplicates(vectors).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert html_render.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert sharding.shard(sharding.with_sizes(empty)).count() == 0
    assert mixing.plan(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_codec_on_texts(codec, library):
    for _, text in EDGE:
        assert codec.encode(text) == library.encode(text or "")
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text or ""))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst  \n▁<s>é漢😀\x00-—"), st.characters(codec="utf-8")), max_size=60))
def test_codec_property(text):
    c, lib = sentencepiece_codec.codec(tokenizer_path()), _LIBRARY
    ids = lib.encode(text)
    assert c.encode(text) == ids
    assert c.decode(ids) == lib.decode(ids)


_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_codec_decodes_any_ids(codec, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.choice((rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_codec_query(spark, edge, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in sentencepiece_codec.round_trip(edge, tokenizer_path(), with_ids=True).collect())
    want = Counter()
    for i, t in EDGE:
        ids = library.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids))] += 1
    assert got == want
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(edge.limit(5), tokenizer_path()), tokenizer_path())
    assert {"ids", "decoded"} <= set(both.columns)


def brute_license(text, threshold=0.9):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = licenses.WORD.findall(text)
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels = {label for _, label in places}
    for line in text.split("\n"):
        block = set(licenses.WORD.findall(line))
        for label, template in licenses.TEMPLATES.items():
            t = set(licenses.words(template))
            if 1000 * len(block & t) >= round(threshold * 1000) * len(t):
                labels.add(label)
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_licenses(spark):
    notes = [*licenses.TEMPLATES.values(), *licenses.PHRASES]
    rng = random.Random(3)
    rows = EDGE + [(1000 + k, "\n".join(" ".join(w for w in rng.choice(notes).split() if rng.random() < 0.95) + " " + sentence(rng.randrange(4), rng) for _ in range(4))) for k in range(150)]
    rows += [(2000, "cc by nc cc by nc"), (2001, "CC-BY-NC"), (2002, "under the\nMIT license")]
    got = Counter(tuple(r) for r in licenses.scan(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect())
    assert got == Counter((i, *brute_license(t)) for i, t in rows)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality(spark):
    rows = EDGE + [(3000 + k, " ".join([BASE[: 60 + k]] * (1 + k % 4)) + " #*$" * (k % 3)) for k in range(20)] + [(4000, "a " * 50), (4001, "one two three four five six seven eight " * 2)]
    df = frame(spark, rows).withColumn("n_words", F.lit("clash"))
    got = Counter(tuple(r) for r in quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in rows)
    judged = quality.judge(df).collect()
    assert all(not r["kept"] for r in judged if r["base_failed"])
    assert all(r["kept"] == (not r["failed_rules"]) for r in judged)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize(("percent", "options"), [(80, {}), (85, {"run": 6, "lap": 2, "block": 20, "depths": (2, 4)})])
def test_minhash(spark, percent, options):
    rng = random.Random(4)
    rows = list(EDGE)
    for g in range(6):  # groups of near copies around the threshold, one of them large
        base = sentence(80, rng).split()
        for k in range(150 if g == 0 else 8):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((5000 + 1000 * g + k, " ".join(w)))
    page = sentence(70, rng)  # pages of one template: crowded regions without links
    rows += [(20_000 + k, f"{page} {sentence(24, rng)}") for k in range(120)]
    got = minhash_dedup.near_duplicates(frame(spark, rows), percent=percent, **options).collect()
    roots = brute_components([shingles(t) for _, t in rows], percent)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, len(shingles(t)), least[r], i == least[r]) for (i, t), r in zip(rows, roots, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    kept = minhash_dedup.drop_near_duplicates(frame(spark, rows), percent=percent, **options).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {i for i, _, _, k in want if k}


def test_minhash_orders_and_runs():
    order = minhash_dedup.orders(24, 4, 96, 7)
    assert len(set(order[:, :4].ravel())) == 96 and all(len(set(row)) == 12 for row in order)
    for percent, depth in ((85, 4), (85, 12), (80, 8)):
        n = minhash_dedup.trees_for(percent, depth, 1e-6)
        assert (1 - (percent / 100) ** depth) ** n <= 1e-6 < (1 - (percent / 100) ** depth) ** (n - 1)
    # A region of any size is cut into runs that overlap; rows in hand stay few; rows are linear.
    cutter = minhash_dedup.Cutter(64, 16, 3, 0)
    ids = [k.to_bytes(4, "big") for k in range(20_000)]
    cutter.feed(b"a" * 10, ids[:1])
    for k in range(0, len(ids), 1000):
        cutter.feed(b"b" * 10, ids[k : k + 1000])
        assert len(cutter.held) <= 80
    cutter.feed(b"c" * 10, [b"x"])
    cutter.end()
    runs = {}
    for unit, i, *_ in cutter.out:
        runs.setdefault(unit, []).append(i)
    assert len(cutter.out) < 1.5 * len(ids)
    together = {(a, b) for r in runs.values() for k, a in enumerate(r) for b in r[k + 1 : k + 9]}
    assert all((ids[k], ids[k + d]) in together for k in range(0, len(ids) - 9, 7) for d in range(1, 9))


def brute_links(x, threshold=0.95):
    c = embedding_dedup.units(x) @ embedding_dedup.units(x).T >= threshold
    np.fill_diagonal(c, False)
    return c


def test_embedding_lists_outnumber_the_centroids():
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((400, 48))
    x = embedding_dedup.units(centres[rng.integers(0, 400, 4000)] + rng.standard_normal((4000, 48)) * rng.choice([0.1, 0.2, 0.25], (4000, 1)))
    index = embedding_dedup.Index.fit(x[:1500], 200, 16, 8, 64, 0.95, 3.0, 5)
    assert index.lists == 16 * 13
    home, probes, codes, least = index.assign(x)
    assert all(h in p for h, p in zip(home[:200].tolist(), probes[:200], strict=True))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    seen = [set(p.tolist()) for p in probes]
    found = np.array([home[b] in seen[a] or home[a] in seen[b] for a, b in zip(i, j, strict=True)])
    assert len(i) > 1000 and found.mean() >= 0.99
    for a, b in list(zip(i, j, strict=True))[:300]:  # the codes lose no link
        assert len(index.candidates(x[a : a + 1], int(home[b]), codes[b : b + 1], least[b : b + 1])[0])


@pytest.mark.parametrize(("per_list", "block", "centroids"), [(300, 1500, 4096), (20, 16, 4096), (20, 16, 6)])
def test_embeddings(spark, per_list, block, centroids):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 500)] + rng.standard_normal((500, 32)) * rng.choice([0.05, 0.15, 0.2], (500, 1)), rng.standard_normal((300, 32)), np.repeat(centres[:1], 80, axis=0)])
    x[-1] *= 3
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)]
    bad = [(10_000, None), (10_001, []), (10_002, [0.0] * 32), (10_003, [float("nan")] * 32), (10_004, [None] * 32), (10_005, [float("inf")] + [1.0] * 31), (10_006, [1.0, 2.0]), (10_007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, per_list=per_list, block=block, max_centroids=centroids).collect()}
    links = brute_links(x)
    n = links.sum(axis=1)
    assert len(got) == len(rows) + len(bad)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.99 * n.sum()
    assert all(got[k]["n_links"] <= n[k] for k in range(len(x)))
    if found == n.sum():
        root = np.arange(len(x))
        while True:
            new = np.minimum(root, np.where(links, root[None, :], len(x)).min(axis=1))
            if (new == root).all():
                break
            root = new
        assert [got[k]["component_id"] for k in range(len(x))] == root.tolist()
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(10_000, 10_006))
    assert (got[10_007]["component_id"], got[10_007]["n_links"]) == (10_006, 1)


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


@pytest.mark.parametrize(("bits", "broadcast", "first"), [(1 << 28, 300_000, False), (1 << 16, 300_000, True), (1 << 16, 0, False), (1 << 16, 2, True)])
def test_lines(spark, edge, bits, broadcast, first):
    df = edge.withColumn("n_lines", F.lit("clash")).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, min_docs=3, max_bits=bits, broadcast_keys=broadcast, keep_first=first).collect()}
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    n, at = Counter(), {}
    for i, t in sorted(docs.items()):
        lines = [key(x) for x in (t or "").split("\n")]
        n.update(set(lines) - {""})
        for k, x in enumerate(lines):
            at.setdefault(x, (i, k))
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not key(x) or n[key(x)] < 3 or (first and at[key(x)] == (i, k))]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)), i


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_lines_of_null_ids_and_repeated_rows(spark, edge, broadcast):
    rows = [(r["doc_id"], r["text"], r["h"]) for r in edge.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    n, at = Counter(), {}
    for i, t, h in rows:
        lines = [key(x) for x in (t or "").split("\n")]
        n.update(set(lines) - {""})  # a repeated row is a document of its own
        for k, x in enumerate(lines):
            here = (i is None, i or 0, h, k)
            at[x] = min(at.get(x, here), here)
    want = Counter()
    for i, t, h in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not key(x) or n[key(x)] < 3 or at[key(x)] == (i is None, i or 0, h, k)]
        want[i, None if t is None else "\n".join(kept)] += 1
    got = line_dedup.dedup_lines(edge, min_docs=3, broadcast_keys=broadcast, keep_first=True).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want


def brute_spans(rows, n=20):
    """rows in order, each (key, text) once."""
    first, out = {}, {}
    for i, t in rows:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in first:
                gone |= set(range(k, k + n))
            first.setdefault(g, (i, k))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_substrings(spark, hot):
    rng = random.Random(8)
    passages = [sentence(rng.randrange(15, 60), rng) for _ in range(6)]
    rows = list({i: t for i, t in EDGE if i is not None}.items())
    rows += [(7000 + k, " ".join([sentence(rng.randrange(30), rng), rng.choice(passages), sentence(rng.randrange(30), rng), rng.choice(passages)])) for k in range(120)]
    rows += [(8000, "loop de " * 100), (8001, " ".join(["same"] * 300))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(frame(spark, rows), hot=hot).collect()}
    assert got == brute_spans(sorted(rows))


def test_substrings_of_null_ids_and_repeated_rows(spark):
    texts = [sentence(30) for _ in range(4)]
    rows = [(None, texts[0]), (3, texts[0] + " " + texts[1]), (3, texts[0] + " " + texts[1]), (3, texts[2] + " " + texts[1]), (None, texts[2]), (None, None), (None, texts[3]), (9, None)]
    df = frame(spark, rows)
    hashed = {(r["doc_id"], r["text"], r["h"]) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(hashed, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = brute_spans([((i, t), t) for i, t, _ in order])
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)  # repeated rows are treated alike


def test_sharding(spark, edge):
    got = sharding.shard(sharding.with_sizes(edge), shards=7).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(EDGE) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sorted(r["row_number"] for r in got) == list(range(len(EDGE)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in EDGE)
    again = {(r["row_number"], r["shard"], r["slot"]) for r in sharding.shard(sharding.with_sizes(edge.repartition(9)), shards=7).collect()}
    assert again == {(r["row_number"], r["shard"], r["slot"]) for r in got}


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, seed):
    places = sharding.permute(np.arange(n), n, seed)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.unpermute(places, n, seed) == np.arange(n)).all()


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng.randrange(1, 40), rng), "en", rng.choices(["a", "b", "c", "d", None], [80, 5, 10, 4, 3])[0], 0) for k in range(600)] + [(9999, None, "en", "a", 0), (9998, "", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.plan(df).collect()}
    size = Counter()
    for i, t, _, s, _ in rows:
        assert got[i]["size"] == len((t or "").split())
        size[s] += len((t or "").split())
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped, target = sum(size.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        target[s] = 3 * size[s] if s in capped else level * weight[s]
        taken = sum(r["taken"] for r in got.values() if r["source"] == s)
        assert abs(taken - target[s]) <= 40
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in got.values() if r["source"] == s)
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    copies = Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert copies == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})


PAGES = {
    "<p>a<p>b<br>c": "a\n\nb\nc",
    "<ul><li>one<li>two<ol start=4><li>x<li>y</ol></ul>": "- one\n- two\n  4. x\n  5. y",
    "<table><tr><th>Name<th>N<tr><td>ann<td>10<tr><td colspan=2>both columns</table>": "Name | N\nann  | 10\nboth columns",
    "<table><tr><td rowspan=2>r<td>1<tr><td>22</table>": "r | 1\n  | 22",
    "<style>.h{display:none} #v{visibility:hidden}</style><b>a</b> <i class=h>no</i><span id=v>no<u style='visibility:visible'>yes</u></span>": "a yes",
    "<head><title>t</title></head><body><script>if (a<b) '</p>'</script>x &amp; y<!-- no -->": "x & y",
    "<pre>\n a  b\n  c</pre><div hidden>no</div><details><summary>s</summary>no</details>": "a  b\n  c\n\ns",
    "<div>a</div></p></td>b<input type=hidden value=no><input value=yes>": "a\n\nb yes",
    "": "", "plain": "plain", "<": "<", "<p": "<p", "a&nbsp;b": "a\xa0b",
}


def test_rendering_takes_linear_time():
    for piece in ("<a ", '<a href="x ', '<a "', "<", "<a ' <b> ", "<!-", "</", "<p title='>"):
        began = time.perf_counter()
        html_render.render(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 20, piece
    assert html_render.render('<p title="a>b">x</p> 1 < 2 <b>y</b> <i unclosed') == "x\n\n1 < 2 y <i unclosed"


def test_rendering(spark):
    for source, want in PAGES.items():
        got = html_render.render(source)
        assert got.lstrip(" ") == want, source
    assert html_render.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    df = spark.createDataFrame([(1, "<p>a", "clash"), (1, "<p>a", "clash"), (2, None, "clash"), (3, "", None)], "page_id long, html string, text string")
    assert Counter((r["page_id"], r["text"]) for r in html_render.extract(df).collect()) == Counter([(1, "a"), (1, "a"), (2, ""), (3, "")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<br>", "w1 ", "w2", " w3", "<span>", "</x>"]), max_size=40))
def test_rendering_keeps_all_words(parts):
    source = "".join(parts)
    want = re.sub("<[^>]*>", "", source)
    assert re.sub(r"\s|- |\||-", "", html_render.render(source)) == re.sub(r"\s", "", want)


@pytest.mark.parametrize(("css", "body", "want"), [
    ("@media print { .nav {display:none} }", "<p class=nav>a", "a"),
    ("@media (max-width: 600px) { .nav {display:none} }", "<p class=nav>a", "a"),
    ("@media screen { .nav {display:none} }", "<p class=nav>a<p>b", "b"),
    ("@media print { .nav {display:none} } .x {display:none}", "<p class=nav>a<p class=x>b", "a"),
    (".tab{display:none} .tab.active{display:block}", "<div class='tab active'>a</div><div class=tab>b</div>", "a"),
    (".tab{display:none} .on .tab{display:block}", "<div class=on><div class=tab>a</div></div><div class=tab>b</div>", "a"),
    (".tab{display:none} .on > .tab{display:block}", "<div class=on><div class=tab>a</div></div>", "a"),
    (".tab{display:none} .tab:nth-child(1){display:block}", "<div class=tab>a</div>", "a"),
    (".tab{display:none} .tab:hover{display:block}", "<div class=tab>a</div><p>b", "b"),
    ("#a{display:block} .tab{display:none}", "<div id=a class=tab>a</div>", "a"),
    (".tab{display:block} div{display:none}", "<div class=tab>a</div><div>b</div>", "a"),
    (".b{display:none} .a{display:block}", "<p class='a b'>a", "a"),
    (".a{display:block} .b{display:none}", "<p class='a b'>a<p>b", "b"),
    ("p{display:none !important} .a{display:block}", "<p class=a style='display:block'>a</p>b", "b"),
    (".x{content:'}'; display:none} .y:not(.z){display:none}", "<p class=x>a<p class=y>b", "b"),
    ("@supports (display: grid) { .x {display:none} } @font-face {src:url(a)} @import 'x'; .y{display:none}", "<p class=x>a<p class=y>b", "a"),
    (".p { display:none; .q & {display:block} }", "<p class=p>a", "a"),
    (".x{display:flex}", "<p hidden class=x>a<p hidden>b", "a"),
    (".x{display:none", "<p class=x>a<p>b", "b"),
])
def test_rendering_styles(css, body, want):
    assert html_render.render(f"<style>{css}</style>{body}") == want


def test_rendering_print_sheets():
    assert html_render.render("<style media=print>p{display:none}</style><style media='(width > 9em)'>p{display:none}</style><p>a") == "a"


@pytest.mark.parametrize(("source", "want"), [
    ("<p>Area <math><mi>a</mi><mo>=</mo><mi>r</mi><annotation>tex</annotation></math> here", "Area a=r here"),
    ("<p>x<svg><title>t</title><defs><text>no</text></defs>stray<rect/><text x=1>Jan</text><g><text>Feb<tspan> 1</tspan></text></g></svg>y", "x Jan Feb 1 y"),
    ("<svg><defs/><path d='M0'/><title/><text>kept</text></svg><p>after", "kept\n\nafter"),
    ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ("<object data=x><p>no plug-in</p></object>", "no plug-in"),
    ("<table><tr><td>|<td>b<tr><td>a |<td></table>", "|   | b\na |"),
    ("<table><tr><td>x<td>a |<tr><td>y<td>|</table>", "x | a |\ny | |"),
])
def test_rendering_formulas_charts_and_bars(source, want):
    assert html_render.render(source) == want


@given(st.lists(st.lists(st.text("ab| ", max_size=4), min_size=1, max_size=3), min_size=1, max_size=4))
def test_rendering_keeps_bars_of_cells(rows):
    rows = [[c.strip() for c in r] for r in rows]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) for r in rows) + "</table>"
    text = html_render.render(page)
    cells = [c for r in rows for c in r]
    assert sum(c.count("|") for c in cells) <= text.count("|") <= sum(c.count("|") for c in cells) + 2 * len(rows)
    assert all(" ".join(c.split()) in text for c in cells)


def test_licenses_in_long_texts(spark):
    """Very many places and notices in one text take time in proportion."""
    text = "cc by nc under the mit license\n" * 60_000
    began = time.perf_counter()
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licenses.NOTICES, wrapped=True).first()
    assert (got["n_base"], got["first_word"], got["last_word"], got["n_words"]) == (120_000, 0, 7 * 60_000 - 4, 7 * 60_000)
    assert time.perf_counter() - began < 60


def test_licenses_that_wrap(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for label, notice in licenses.listed(licenses.NOTICES):
        for width in (30, 72):
            k = len(rows)
            rows.append((k, sentence(rng.randrange(1, 30), rng) + "\n" + textwrap.fill(notice, width, initial_indent="# ", subsequent_indent="# ") + "\n" + sentence(5, rng)))
            want[k] = label
    rows += [(900, "rights were reserved,\nall of them"), (901, "\n".join(["word " * 9 + w for w in licenses.TEMPLATES["gpl-3"].split()]))]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows), licenses.NOTICES, wrapped=True).collect()}
    assert all(label in got[k]["labels"].split(",") and got[k]["score"] == 1.0 for k, label in want.items())
    assert got[900]["labels"] == got[901]["labels"] == ""


def test_license_windows_against_brute_force():
    rng = random.Random(9)
    index = licenses.TemplateIndex({"t": "a b c d e f g h i j a"}, {}, 0.9)
    for _ in range(2000):
        text = [rng.choice("abcdefghij" * 3 + "xy") if rng.random() < 0.3 else "abcdefghij"[k % 10] for k in range(rng.randrange(40))]
        places = {w: [k for k, x in enumerate(text) if x == w] for w in set(text)}
        most = max((len(index.sets[0].intersection(text[k : k + 11])) for k in range(len(text))), default=0)
        found = index.passages(0, places)
        assert max((c for *_, c in found), default=0.0) == (most / 10 if most >= 9 else 0.0)
