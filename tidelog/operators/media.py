"""Media and article text of pages, media lists, chats, small leagues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..functions.text import text_of


def page_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, url, kind of every link and source in a page; kind null where it is no media."""
    found = F.regexp_extract_all(text_of(F.col(html)), F.lit(r"""(?i)<(?:a|img|source|video|audio)\b[^>]*?(?:href|src)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "url")).withColumn("kind", urls.media_kind(F.col("url")))


def merge_media(*lists: DataFrame) -> DataFrame:
    """One row a URL from lists of (url, kind, title, width, height): the first list's fields
    win, sizes are the greatest; segments and blobs go."""
    rows = None
    for k, part in enumerate(lists):
        part = part.select("url", "kind", "title", "width", "height", F.lit(k).alias("_k"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(~F.startswith("url", F.lit("blob:")) & ~F.col("kind").eqNullSafe("segment"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("_k", c)))[c].alias(c)
    return rows.groupBy("url").agg(first("kind"), first("title"), F.max("width").alias("width"), F.max("height").alias("height"))


def segment_directories(items: DataFrame, least: int = 3) -> DataFrame:
    """Directories with ``least`` segments or more that no stream of the list covers."""
    folder = F.regexp_extract("url", r"^(.*/)[^/]*$", 1)
    hot = items.where("kind = 'segment'").groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    streams = items.where("kind = 'stream'").select(folder.alias("_s"))
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda k: F.concat(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), k), "/"), F.lit("/")))
    covered = hot.select("folder", F.explode(up).alias("_s")).join(streams, "_s", "left_semi").select("folder").distinct()
    return hot.join(covered, "folder", "left_anti")


def article_blocks(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, block, chars, score: text blocks scored by length, paragraphs and link density, the
    best first in ``rank``; what reads as an article stands above menus."""
    cut = F.split(F.regexp_replace(text_of(F.col(html)), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", ""), r"(?i)<(?:article|section|div|main|nav|footer|header|aside)\b[^>]*>")
    b = pages.select(F.col(id_col).alias("id"), F.posexplode(cut).alias("block", "_h"))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    links = bare(F.array_join(F.regexp_extract_all("_h", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " "))
    p = F.least(F.regexp_count("_h", F.lit(r"(?i)<p\b")), F.lit(40))
    b = b.select("id", "block", bare(F.col("_h")).alias("text"), p.alias("_p"), F.length(links).alias("_l")).withColumn("chars", F.length("text")).where("chars > 0")
    score = F.round(F.col("chars") * (1 + F.col("_p") / 40) * (1 - F.least(F.lit(1.0), F.col("_l") / F.col("chars"))), 3)
    return b.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "block"))).drop("_p", "_l")


def chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", keep: int = 200, title_chars: int = 60) -> DataFrame:
    """One row a conversation: its last ``keep`` turns, and the first question as the title."""
    r = turns.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())))
    asked = F.min(F.when((F.col(role) == "user") & (F.trim(text_of(F.col(text))) != ""), F.struct(order, text)))[text]
    kept = F.sort_array(F.collect_list(F.when(F.col("_back") <= keep, F.struct(order, role, text))))
    return r.groupBy(key).agg(F.substring(asked, 1, title_chars).alias("title"), F.count(F.lit(1)).alias("n_turns"), kept.alias("turns"))


def hour_groups(hours: DataFrame, key: str, least: int) -> DataFrame:
    """Neighbouring hours (key, hour, n) put together until a group has ``least`` records: a
    fold over the at most 24 hours of a day, in the JVM."""
    rows = hours.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hour", "n"))).alias("_h"))
    kind = "array<struct<first:int,last:int,n:bigint>>"
    group = lambda a, b, n: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), n.cast("long").alias("n"))

    def step(done, x):
        open_ = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["n"] < least)
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(group(last["first"], x["hour"], last["n"] + x["n"])))
        return F.when(open_, grown).otherwise(F.concat(done, F.array(group(x["hour"], x["hour"], x["n"])))).cast(kind)

    return rows.select(key, F.inline(F.aggregate("_h", F.array().cast(kind), step)))


def league(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted means of (name, family, bench, score) over the benchmarks a name has, with each
    family's best name."""
    mean = scores.join(weights, "bench").groupBy("name", "family").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))
    return mean.withColumn("best_of_family", F.row_number().over(Window.partitionBy("family").orderBy(F.col("mean").desc(), "name")) == 1)


def among(scores: DataFrame, models: DataFrame, key: str = "name") -> DataFrame:
    """Scores of the models that are in a list."""
    return scores.join(models.select(key).distinct(), key, "left_semi")


def tiers(models: DataFrame, budget_gb: float, per_tier: int = 3) -> DataFrame:
    """tier (0 small to 2 large), rank, name, family: the best ``per_tier`` of each third by the memory
    that models (name, family, need_gb, score) need, one of a family, of those that fit."""
    fits = models.where(F.col("need_gb") <= budget_gb)
    sizes = fits.select("need_gb").distinct().withColumn("tier", F.ntile(3).over(Window.orderBy("need_gb")) - 1)  # a row for each size there is
    best = fits.join(sizes, "need_gb").withColumn("_f", F.row_number().over(Window.partitionBy("tier", "family").orderBy(F.col("score").desc(), "name"))).where("_f = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("score").desc(), "name")))
    return ranked.where(F.col("rank") <= per_tier).select("tier", "rank", "name", "family")


def on_display(windows: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Windows (x, y, w, h) that a display shows, cut to it and in its own coordinates."""
    left, top = F.greatest(F.col("x"), F.lit(x)), F.greatest(F.col("y"), F.lit(y))
    right, low = F.least(F.col("x") + F.col("w"), F.lit(x + w)), F.least(F.col("y") + F.col("h"), F.lit(y + h))
    return windows.where((right > left) & (low > top)).withColumns({"x": left - x, "y": top - y, "w": right - left, "h": low - top})


def box_at(boxes: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Each point (key, px, py) with the smallest box (key, box, x, y, w, h) of its picture that holds it."""
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h"))
    met = points.join(boxes, key).where(inside)
    return met.groupBy(key, "px", "py").agg(F.min_by("box", F.struct(F.col("w") * F.col("h"), F.col("box"))).alias("box"))


def newest_alike(models: DataFrame) -> DataFrame:
    """Per alias (vendor, context, price) the newest concrete model by its version's numbers."""
    version = F.transform(F.regexp_extract_all("name", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    best = models.where(~F.endswith("name", F.lit("latest"))).groupBy("vendor", "context", "price").agg(F.max_by("name", F.struct(version, F.col("name"))).alias("resolved"))
    return models.where(F.endswith("name", F.lit("latest"))).join(best, ["vendor", "context", "price"], "left")


def recent_median(runs: DataFrame, key: str, at: str, ms: str, last: int = 5, least: int = 3, limit_ms: int = 6000) -> DataFrame:
    """Keys whose last ``last`` runs (``least`` at least) have an upper median over the limit."""
    r = runs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).where(F.col("_r") <= last)
    lists = r.groupBy(key).agg(F.sort_array(F.collect_list(ms)).alias("_m")).where(F.size("_m") >= least)
    return lists.select(key, F.get("_m", F.floor(F.size("_m") / 2).cast("int")).alias("median")).withColumn("slow", F.col("median") > limit_ms)


def chats_listed(chats: DataFrame, most: int = 200) -> DataFrame:
    """The newest conversations: by the last change (or the beginning, where nothing changed), then the beginning,
    then the id, so that no tie is left open."""
    at = F.coalesce("updated_at", "created_at")
    return chats.where("id IS NOT NULL").orderBy(at.desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(most)
