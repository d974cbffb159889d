"""Pages: what a record was taken from or is, its clips, pages seen in passing, a day's reading.

A page is known by its address and by its title; a record that has both says that they name one
page.  Where neither can be trusted there is no key: no link rather than a wrong one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PAGE_KEY_CHARS, SHARED_MOST, SHELLS
from ..functions import urls
from ..functions.text import squeeze, text_of, tidy_title
from .graph import components


def title_key(title: Column, app: Column | None = None, shells: Sequence[str] = SHELLS, least: int = PAGE_KEY_CHARS, window: bool = True) -> Column:
    """A window title as a page's name; empty if it is too short or just names a program.  Without ``window``
    the title is the page's own: no counters or marks of a program are in it, so what looks like them stays."""
    t = F.regexp_replace(squeeze(tidy_title(title)), r"(?i)^(find in page|在页面中查找)\s+", "") if window else squeeze(title)
    low = F.lower(t)
    own = low == F.lower(squeeze(app)) if app is not None else F.lit(False)
    return F.when((F.length(t) < least) | low.isin(*shells) | own, "").otherwise(t)


def page_keys(url: Column, title: Column, app: Column | None = None, window: bool = True) -> Column:
    """The names of the page at an address under a title: none, one, or both."""
    return F.filter(F.array(urls.norm_url(url), title_key(title, app, window=window)), lambda k: k != "")


def page_nodes(clips: DataFrame, owners: DataFrame) -> DataFrame:
    """id, page, owns: records of ``clips`` (id, keys: where they were taken) and of ``owners`` (id,
    keys: what they are), by the least key of all that some record equates."""
    rows = clips.select("id", "keys", F.lit(False).alias("owns")).unionByName(owners.select("id", "keys", F.lit(True).alias("owns"))).where(F.size("keys") > 0)
    same = components(rows.where(F.size("keys") > 1).select(F.col("keys")[0].alias("a"), F.col("keys")[1].alias("b")))
    named = rows.select("id", "owns", F.col("keys")[0].alias("key")).join(same, F.col("key") == F.col("node"), "left")
    return named.select("id", F.coalesce("root", "key").alias("page"), "owns").distinct()


def page_clips(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """page, id, place: the records taken from each page, in order of time."""
    rows = nodes.where(~F.col("owns")).select("page", "id").distinct().join(e.select("id", "created_at"), "id")
    return rows.select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy("created_at", "id")).alias("place"))


def page_owner(nodes: DataFrame) -> DataFrame:
    """page, id: the record that is the page; the least id of several."""
    return nodes.where("owns").groupBy("page").agg(F.min("id").alias("id"))


def page_of(nodes: DataFrame) -> DataFrame:
    """id, page that a record was taken from, else the page it is."""
    return nodes.groupBy("id").agg(F.coalesce(F.min(F.when(~F.col("owns"), F.col("page"))), F.min("page")).alias("page"))


def same_page(nodes: DataFrame, ids: DataFrame, most: int = SHARED_MOST) -> DataFrame:
    """id, other, owns: other records of the pages of ``ids``.  A page with more than ``most``
    records is no page but a program's shell, and says nothing."""
    sizes = nodes.groupBy("page").agg(F.countDistinct("id").alias("n")).where(F.col("n").between(2, most)).select("page")
    small = nodes.join(sizes, "page", "left_semi")
    mine = small.join(ids.select("id"), "id", "left_semi").select("id", "page")
    return mine.join(small.select("page", F.col("id").alias("other"), "owns"), "page").where(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.max("owns").alias("owns"))


def find_pages(trail: DataFrame, needles: Sequence[str], limit: int = 60, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Pages seen in passing (at, url, title, text) that hold a needle: 2 for each one in the title, 1
    for one in the address or text only; the best and newest ``limit``, of the last ``days``."""
    words = [w for n in needles if (w := n.lower().strip())]
    title = F.lower(text_of(F.col("title")))
    body = F.concat_ws("\n", title, F.lower(text_of(F.col("url"))), F.lower(text_of(F.col("text"))))
    rows = trail if days is None else trail.where(F.col("at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    each = [F.when(F.contains(F.col("_title"), F.lit(w)), 2).when(F.contains(F.col("_body"), F.lit(w)), 1).otherwise(0) for w in words]
    # A generator of one row, so that the lower-cased texts are attributes.
    flat = rows.select(F.inline(F.array(F.struct("at", "url", "title", title.alias("_title"), body.alias("_body")))))
    score = reduce(lambda a, b: a + b, each, F.lit(0))
    return flat.select("at", "url", "title", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), F.col("at").desc(), "url").limit(limit)


def reading(trail: DataFrame) -> DataFrame:
    """site, pages, share: the sites of a day's pages, most pages first; ``share`` is the bar's
    length, by the square root, so that small ones show."""
    n = trail.groupBy(urls.site(F.col("url")).alias("site")).agg(F.countDistinct("url").alias("pages"))
    top = n.agg(F.max("pages").alias("_top"))
    return n.crossJoin(F.broadcast(top)).select("site", "pages", F.round(F.sqrt(F.col("pages") / F.col("_top")), 4).alias("share")).orderBy(F.col("pages").desc(), "site")  # one row


def day_head(sessions: DataFrame, most: int = 4) -> DataFrame:
    """day, secs, apps: a day's seconds in all and the ``most`` apps with the most of them.  ``sessions``
    has app, start_us and end_us."""
    secs = (F.col("end_us") - F.col("start_us")) / 1_000_000
    by_app = sessions.groupBy(F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd").alias("day"), "app").agg(F.sum(secs).alias("secs"))
    ranked = by_app.withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(F.col("secs").desc(), "app")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "app")))), lambda x: x["app"])
    return ranked.groupBy("day").agg(F.round(F.sum("secs"), 3).alias("secs"), F.array_join(top, ",").alias("apps"))
