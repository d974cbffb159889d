"""Articles of pages: the elements of a page as rows, the container that reads as its article, its comments.

Pages are parsed once into rows of elements and pieces of text, numbered in document order; an element's row
carries the sums over its subtree (characters, linked characters, paragraphs), which parents take from
their children as these close.  What is chosen, and what it says, are joins and aggregates over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze, text_of

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset(("script", "style", "noscript", "template", "svg"))
#: What an opening tag ends when it is still open, and where the search for it stops.
ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "dd": ("dd", ("dl",)), "dt": ("dd", ("dl",)), "option": ("option", ("select",))}
SAME = {"th": "td", "dt": "dd"}
BLOCKS = frozenset("p div li tr section article h1 h2 h3 h4 h5 h6 blockquote pre br ul ol table figure dd dt main header footer nav aside form td th body".split())
# Where pages say that their content is, and names of what is none, or is a comment.
CONTENT_NAMES = ("mw-content-text", "post-content", "entry-content", "article-content", "content")
JUNK_TAGS = frozenset("nav aside footer header form".split())
JUNK = r"(toc|table-of-contents|navbox|sidebar|breadcrumb|advert|share|related|recommend|newsletter|subscribe|cookie)"
SKIPPED = r"(?:^|[\s_-])(nav|header|footer|aside|menu|sidebar|related|recommend|advert|promo|share|toolbar|toc)(?:[\s_-]|$)"
TALK, NO_TALK = r"comment|discussion|replies|评论|回复", r"dropdown|popover|tooltip|modal|dialog|menu|toolbar|placeholder|editor|composer"

ROW = "node int, `end` int, up int, tag string, name string, role string, href string, junk boolean, depth int, text string, chars int, linked int, paragraphs int"
_TYPES = pa.struct([
    ("node", pa.int32()), ("end", pa.int32()), ("up", pa.int32()), ("tag", pa.string()), ("name", pa.string()), ("role", pa.string()), ("href", pa.string()), ("junk", pa.bool_()),
    ("depth", pa.int32()), ("text", pa.string()), ("chars", pa.int32()), ("linked", pa.int32()), ("paragraphs", pa.int32()),
])


class _Elements(HTMLParser):
    """A page's rows; an open element is a row whose sums still grow."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def _row(self, tag: str, **fields) -> dict:
        row = dict.fromkeys(("name", "role", "href", "text")) | {"node": len(self.rows), "end": len(self.rows), "up": self.open[-1]["node"] if self.open else -1, "tag": tag, "junk": False, "depth": len(self.open), "chars": 0, "linked": 0, "paragraphs": int(tag in ("p", "li"))} | fields
        self.rows.append(row)
        return row

    def _close(self) -> None:
        row = self.open.pop()
        row["end"] = len(self.rows) - 1
        self._add(row)

    def _add(self, row: dict) -> None:
        """The parent takes what its child has."""
        if self.open:
            for k in ("chars", "linked", "paragraphs"):
                self.open[-1][k] += row["chars" if k == "linked" and self.open[-1]["tag"] == "a" else k]

    def handle_starttag(self, tag: str, attrs) -> None:
        kind, until = ENDS.get(tag, (None, ()))
        if tag in BLOCKS and tag != "br":
            kind, until = (kind, until) if kind else ("p", ("table", "td", "body"))
        if kind:
            for k in range(len(self.open) - 1, -1, -1):
                if SAME.get(self.open[k]["tag"], self.open[k]["tag"]) == kind:
                    while len(self.open) > k:
                        self._close()
                    break
                if self.open[k]["tag"] in until:
                    break
        a = {k: v or "" for k, v in attrs}
        name = " ".join(f"{a.get('class', '')} {a.get('id', '')}".lower().split())
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        row = self._row(tag, name=name, role=a.get("role", "").lower(), href=a.get("href"), junk=hidden or tag in JUNK_TAGS or tag in UNREAD, text=a.get("content") if tag == "meta" else None)
        if tag == "meta":
            row["name"] = (a.get("property") or a.get("name") or "").lower()
        if tag in VOID:
            self._add(row)
        else:
            self.open.append(row)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                while len(self.open) > k:
                    self._close()
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1]["tag"] in UNREAD):
            row = self._row("#text", text=data, chars=len(" ".join(data.split())))
            self._add(row)


def parsed(html: str | None) -> list[dict]:
    p = _Elements()
    p.feed(html or "")
    p.close()
    while p.open:
        p._close()
    return p.rows


def elements(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id and a row for each element and piece of text (tag ``#text``) of each page: number, last number below
    it, parent, tag, class and id, role, address, whether it is furniture, depth, text, and the
    sums over its subtree.  A null or empty page has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 50) for k in range(0, whole.num_rows, 50)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parsed(x.as_py()) for x in batch.column(1)], pa.list_(_TYPES))], names=["id", "rows"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html).alias("html")).mapInArrow(run, f"id {kind}, rows array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>")
    out = rows.select("id", F.inline("rows"))
    return out.withColumn("junk", F.col("junk") | F.col("role").isin("navigation", "complementary", "banner", "search") | (F.coalesce("name", F.lit("")).rlike(JUNK) & (F.col("tag") != "meta")))


def _names(pattern: str) -> Column:
    return F.coalesce("name", F.lit("")).rlike(pattern)


def roots(rows: DataFrame, anchors: DataFrame | None = None, least: int = 200, some: int = 120) -> DataFrame:
    """id, source, node, end: each page's article.  The container that an anchor (id, href: what was clicked)
    stands in, if it says enough; else one that the page itself calls its content; else the block of
    the best score (length, paragraphs, few links); else the body."""
    size = F.col("chars")
    density = F.col("linked") / F.greatest(size, F.lit(1))
    score = size * (1 + F.least("paragraphs", F.lit(40)) / 40) * (1 - density)
    own = F.exists(F.split(F.coalesce("name", F.lit("")), " "), lambda w: w.isin(*CONTENT_NAMES))
    declared = F.when(F.col("tag") == "article", 0.0).when((F.col("tag") == "main") | (F.col("role") == "main"), 1.0).when(own, 2.0)  # the nearer to the text, the better
    block = F.col("tag").isin("div", "section", "td") & ~_names(SKIPPED) & (size >= some) & (density <= 0.5)
    # Smaller is better: the kind first; the first declared container, or the best block, the first among equals.
    order = F.when(declared.isNotNull() & (size >= least), F.struct(F.lit(1).alias("kind"), declared.alias("by"), "node")).when(block, F.struct(F.lit(2).alias("kind"), (-score).alias("by"), "node")).when(F.col("tag") == "body", F.struct(F.lit(3).alias("kind"), F.lit(0.0).alias("by"), "node"))
    found = rows.where(F.col("tag") != "#text").select("id", order.alias("_o"), "end").where("_o IS NOT NULL")
    if anchors is not None:
        # The innermost container around the anchor that says enough.
        at = rows.where("href IS NOT NULL").join(anchors.select("id", "href").distinct(), ["id", "href"]).groupBy("id").agg(F.min("node").alias("_a"))
        around = rows.where(F.col("tag").isin("article", "section", "li", "div", "td", "tr") & (size >= 40)).join(at, "id").where((F.col("node") <= F.col("_a")) & (F.col("_a") <= F.col("end")))
        found = found.unionByName(around.select("id", F.struct(F.lit(0).alias("kind"), (-F.col("depth")).cast("double").alias("by"), "node").alias("_o"), "end"))
    best = found.groupBy("id").agg(F.min(F.struct("_o", "end")).alias("b"))
    kind = F.element_at(F.array(*map(F.lit, ("anchor", "declared", "scored", "body"))), F.col("b._o.kind") + 1)
    return best.select("id", kind.alias("source"), F.col("b._o.node").alias("node"), F.col("b.end").alias("end"))


def talk_roots(rows: DataFrame, articles: DataFrame, least: int = 40) -> DataFrame:
    """id, node, end: the outermost elements named as comments that lie outside of the article and say
    something.  Elements nest, so one is outermost if it begins behind all that began before."""
    named = rows.where(_names(TALK) & ~_names(NO_TALK) & (F.col("tag") != "#text") & (F.col("tag") != "meta") & (F.col("chars") >= least))
    outside = named.join(articles.select("id", F.col("node").alias("_n"), F.col("end").alias("_e")), "id", "left").where("_n IS NULL OR NOT (node BETWEEN _n AND _e)")
    apart = outside.where("_n IS NULL OR NOT (_n BETWEEN node AND `end`)")  # and it isn't around the article
    before = F.max("end").over(Window.partitionBy("id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    return apart.withColumn("_b", before).where("_b IS NULL OR node > _b").select("id", "node", "end")


def read(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """id, node, text of the parts (id, node, end): what they say without the furniture inside of them, each block
    on a line of its own."""
    inside = rows.select("id", F.col("node").alias("n"), F.col("end").alias("e"), "tag", "junk", "text").join(parts.select("id", "node", "end"), "id").where("n BETWEEN node AND `end`")
    w = Window.partitionBy("id", "node").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # A piece of furniture hides all up to its end; the part itself is none.
    hidden = F.max(F.when(F.col("junk") & (F.col("n") > F.col("node")), F.col("e"))).over(w)
    told = inside.withColumn("_h", hidden)
    shown = F.coalesce(F.col("n") > F.col("_h"), F.lit(True)) & (F.col("tag") == "#text")
    # A block breaks the line where it begins and behind its end; breaks stand before what has the same number.
    bit = lambda n, s, t: F.struct(n.alias("n"), F.lit(s).alias("s"), t.alias("t"))
    block = F.col("tag").isin(*BLOCKS)
    bits = F.array_compact(F.array(F.when(block, bit(F.col("n"), 0, F.lit("\n"))), F.when(block, bit(F.col("e") + 1, 0, F.lit("\n"))), F.when(shown, bit(F.col("n"), 1, text_of(F.col("text"))))))
    said = told.select("id", "node", F.explode(bits).alias("b")).groupBy("id", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["t"]), "").alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n"), squeeze), lambda x: x != "")
    return said.select("id", "node", F.array_join(lines, "\n").alias("text"))


def article(pages: DataFrame, anchors: DataFrame | None = None, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, source, title, text, n_comments, comments: one row a page that has any element."""
    rows = elements(pages, id_col, html)
    main = roots(rows, anchors)
    talk = talk_roots(rows, main)
    said = read(rows, main).select("id", "text")
    comments = read(rows, talk).where("text <> ''").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_comments"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "\n").alias("comments"))
    named = rows.where(F.col("tag").isin("meta", "title", "h1"))
    inner = rows.where("tag = '#text'").select("id", F.col("up").alias("node"), F.col("text").alias("_t")).groupBy("id", "node").agg(F.min("_t").alias("_t"))
    tier = F.when((F.col("tag") == "meta") & (F.col("name") == "og:title"), 0).when((F.col("tag") == "meta") & (F.col("name") == "twitter:title"), 1).when(F.col("tag") == "h1", 2).when(F.col("tag") == "title", 3)
    heads = named.join(inner, ["id", "node"], "left").select("id", tier.alias("tier"), "node", squeeze(F.coalesce("text", "_t")).alias("title")).where("tier IS NOT NULL AND title <> ''")
    title = heads.groupBy("id").agg(F.min(F.struct("tier", "node", "title"))["title"].alias("title"))
    out = main.select("id", "source").join(said, "id", "left").join(title, "id", "left").join(comments, "id", "left")
    return out.select("id", "source", F.coalesce("title", F.lit("")).alias("title"), text_of(F.col("text")).alias("text"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"), text_of(F.col("comments")).alias("comments"))
