"""Columns over nested parts of records: recognised lines, labels, colours, citations, loose JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

LINE = "array<struct<x:double,y:double,w:double,h:double,conf:double,text:string>>"


def body_lines(lines: Column, width: Column, top_points: float = 37) -> Column:
    """The texts of a screenshot's lines without the bar at its top, in order; a wide picture
    has two pixels a point."""
    band = F.when(width >= 2560, 2 * top_points).otherwise(top_points)
    return F.transform(F.filter(lines, lambda r: r["y"] + r["h"] / 2 > band), lambda r: r["text"])


def line_of_words(words: Column) -> Column:
    """The box around a line's words, their least confidence and their text."""
    right, low = F.array_max(F.transform(words, lambda r: r["x"] + r["w"])), F.array_max(F.transform(words, lambda r: r["y"] + r["h"]))
    x, y = F.array_min(F.transform(words, lambda r: r["x"])), F.array_min(F.transform(words, lambda r: r["y"]))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"), F.array_min(F.transform(words, lambda r: r["conf"])).alias("conf"), F.array_join(F.transform(words, lambda r: r["text"]), " ").alias("text"))


def headline(lines: Column, least_conf: float = 0.5) -> Column:
    """The text of the tallest line that is read with confidence; ties go to the upper one."""
    sure = F.filter(lines, lambda r: (r["conf"] >= least_conf) & r["text"].rlike(r"\p{L}{2}"))
    best = F.array_max(F.transform(sure, lambda r: F.struct(r["h"].alias("h"), (-r["y"]).alias("y"), r["text"].alias("t"))))
    return best["t"]


def picked_labels(labels: Column, broad: list[str], least: float = 0.15, most: int = 8) -> Column:
    """Names of (name, conf) that are sure enough, specific ones before broad ones, each in the
    order of their confidence."""
    sure = F.filter(labels, lambda r: r["conf"] >= least)
    keyed = F.array_sort(F.transform(sure, lambda r: F.struct(r["name"].isin(*broad).alias("b"), (-r["conf"]).alias("c"), r["name"].alias("n"))))
    return F.slice(F.transform(keyed, lambda r: r["n"]), 1, most)


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """A plain name of a colour by lightness, saturation and hue."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0).when(top == r, 60 * (((g - b) / span) % 6)).when(top == g, 60 * ((b - r) / span + 2)).otherwise(60 * ((r - g) / span + 4))
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    grey = (span < 26) | (span < 0.12 * top)
    plain = F.when(top < 40, "black").when(grey & (top > 225), "white").when(grey, "grey")
    return F.coalesce(plain, F.when(hue < 15, "red").when(hue < 45, "orange").when(hue < 70, "yellow").when(hue < 165, "green").when(hue < 200, "cyan").when(hue < 260, "blue").when(hue < 330, "purple").otherwise("red"))


def loose_json(c: Column) -> Column:
    """A variant of a text that is JSON, or holds it in a fence or between braces; else null."""
    t = text_of(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(t), F.when(fenced != "", F.try_parse_json(fenced)), F.when(braces != "", F.try_parse_json(braces)))


def cited(used: Column, ids: Column) -> Column:
    """Ids at the places (from 1) that an answer cites; all of them if it cites none."""
    found = F.filter(F.transform(used, lambda i: F.get(ids, i - 1)), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.array_distinct(found)).otherwise(ids)


def duration(seconds: Column) -> Column:
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def relative_day(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when(n.between(2, 6), F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def parameters(model: Column) -> Column:
    """Billions of parameters that a model's name states, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.lower(text_of(model)), r"(?<![a-z0-9.])(\d+(?:\.\d+)?)b(?![a-z0-9])", 1), F.lit("")), F.lit("999999.999999")).cast("double")
