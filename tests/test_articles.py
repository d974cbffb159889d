"""Articles by the element tree, against a walk over the trees that the pages were written from."""

import random
import re

import pytest

from tidelog.operators import articles
from tidelog.plans import registry

BLOCK = articles.BLOCKS
WORDS = "tide quay harbour boat low water north pier light bell".split()


class Node:
    def __init__(self, tag, name="", kids=(), **attrs):
        self.tag, self.name, self.kids, self.attrs = tag, name, list(kids), attrs

    def html(self):
        inner = "".join(k if isinstance(k, str) else k.html() for k in self.kids)
        attrs = "".join(f' {k}="{v}"' for k, v in ({"class": self.name} if self.name else {} | {}).items()) + "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def walk(self):
        yield self
        for k in self.kids:
            if not isinstance(k, str):
                yield from k.walk()

    def texts(self):
        for k in self.kids:
            if isinstance(k, str):
                yield k
            else:
                yield from k.texts()

    def chars(self):
        return sum(len(" ".join(t.split())) for t in self.texts() if t.strip())

    def linked(self):
        return self.chars() if self.tag == "a" else sum(k.linked() for k in self.kids if not isinstance(k, str))

    def junk(self):
        return self.tag in articles.JUNK_TAGS or self.attrs.get("role") in ("navigation", "banner") or bool(re.search(articles.JUNK, self.name))


def say(node, top=True):
    if node.junk() and not top:
        return "\n" if node.tag in BLOCK else ""
    body = "".join(k if isinstance(k, str) else say(k, False) for k in node.kids)
    return f"\n{body}\n" if node.tag in BLOCK else body


def lines(text):
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def plain(page):
    nodes = list(page.walk())
    declared = [n for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: set(n.name.split()) & set(articles.CONTENT_NAMES)) for n in nodes if test(n) and n.chars() >= 200]
    scored = []
    for k, n in enumerate(nodes):
        size = n.chars()
        density = n.linked() / max(size, 1)
        if n.tag in ("div", "section", "td") and not re.search(articles.SKIPPED, n.name) and size >= 120 and density <= 0.5:
            p = sum(m.tag in ("p", "li") for m in n.walk())
            scored.append((-size * (1 + min(p, 40) / 40) * (1 - density), k, n))
    source, main = ("declared", declared[0]) if declared else ("scored", min(scored, key=lambda x: x[:2])[2]) if scored else ("body", next(n for n in nodes if n.tag == "body"))
    inside, around = set(map(id, main.walk())), [n for n in nodes if any(m is main for m in n.walk())]
    talk = []
    for n in nodes:
        if id(n) in inside or n in around or n.chars() < 40 or not re.search(articles.TALK, n.name) or re.search(articles.NO_TALK, n.name):
            continue
        if not any(any(m is n for m in t.walk()) for t in talk):
            talk.append(n)
    said = [x for x in (lines(say(n)) for n in talk) if x]
    return source, lines(say(main)), len(said), "\n".join(said)


def random_page(draw):
    def text(n):
        return " ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, n)))

    def some(depth):
        kind = draw.random()
        if depth > 4 or kind < 0.35:
            return Node("p", "", [text(25), Node("a", "", [text(6)], href="/x"), text(9)])
        if kind < 0.45:
            return Node("nav", "", [Node("a", "", [text(4)], href=f"/{k}") for k in range(3)])
        if kind < 0.55:
            return Node("ul", "", [Node("li", "", [text(8)]) for _ in range(3)])
        if kind < 0.65:
            return Node("div", draw.choice(["comments", "comment-menu", "user-replies", "comment-item"]), [some(depth + 1) for _ in range(2)])
        names = ["", "side menu", "related-box", "post-content", "share", "wide"]
        return Node(draw.choice(["div", "section", "article"] if draw.random() < 0.3 else ["div", "section"]), draw.choice(names), [some(depth + 1) for _ in range(draw.randrange(1, 4))])

    return Node("html", "", [Node("head", "", [Node("title", "", ["A page of " + text(4)])]), Node("body", "", [some(0) for _ in range(draw.randrange(1, 5))])])


def test_random_trees(spark):
    draw = random.Random(8)
    pages = [random_page(draw) for _ in range(150)]
    frame = spark.createDataFrame([(k, p.html()) for k, p in enumerate(pages)], "page_id long, html string")
    got = {r["id"]: (r["source"], r["text"], r["n_comments"], r["comments"]) for r in articles.article(frame).collect()}
    want = {k: plain(p) for k, p in enumerate(pages)}
    for k, w in want.items():
        assert got[k] == w, pages[k].html()
    assert {w[0] for w in want.values()} == {"declared", "scored", "body"} and sum(w[2] for w in want.values()) > 10


def test_sloppy_pages(spark):
    """Tags that are never closed, entities, furniture, nothing at all."""
    long = "The boats lie dry at low water near the old quay stairs. " * 6
    rows = [
        (1, f"<title>Tide &amp; time</title><body><div id=content><p>{long}<p>Second<br>line<ul><li>one<li>two</ul><aside>buy</aside></div><div class=comments><p>I was there when the bell rang, and it was loud.</div>"),
        (2, None), (3, ""), (4, "plain words"), (5, "<body><table><tr><td>a<td>b<tr><td>c</table><script>x = '<p>no</p>'</script>"),
        (6, f"<meta property='og:title' content='Shared title'><title>other</title><body><div class=share><article><h1>Head</h1>{long}</article></div></body>"),
    ]
    got = {r["id"]: r for r in articles.article(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    first = got[1]
    assert first["text"] == f"{long.strip()}\nSecond\nline\none\ntwo" and first["source"] == "declared" and first["title"] == "Tide & time"
    assert first["comments"] == "I was there when the bell rang, and it was loud." and first["n_comments"] == 1
    assert set(got) == {1, 5, 6} and got[5]["text"] == "a\nb\nc"  # without a body there is no article
    assert got[6]["title"] == "Shared title" and got[6]["text"] == f"Head\n{long.strip()}"


def test_the_anchor_says_which(spark):
    posts = "".join(f"<article><p>{'Words of post number ' + str(k) + ' go here. ' * 20}</p><a href='/post/{k}'>open</a></article>" for k in range(4))
    pages = spark.createDataFrame([(1, f"<body>{posts}</body>"), (2, f"<body>{posts}</body>")], "page_id long, html string")
    anchors = spark.createDataFrame([(1, "/post/2"), (2, "/elsewhere")], "id long, href string")
    got = {r["id"]: (r["source"], r["text"][:22]) for r in articles.article(pages, anchors).collect()}
    assert got == {1: ("anchor", "Words of post number 2"), 2: ("declared", "Words of post number 0")}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_all_pages(spark, sf):
    n = spark.read.parquet(f"{sf}/pages.parquet").where("html LIKE '%<body%'").count()
    rows = registry.QUERIES["articles"](spark, sf).collect()
    assert len({r["id"] for r in rows}) == len(rows) >= n and sum(bool(r["text"]) for r in rows) > 0.9 * n
