"""One predicate for lists and counts, and facets that leave their own dimension out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of

SEARCHED = ("title", "text", "url", "path", "app", "origin")


@dataclass(frozen=True)
class Filter:
    """None: no condition.  ``hidden`` buckets count only while no bucket is chosen."""

    day_from: str | None = None
    day_to: str | None = None
    sources: tuple[str, ...] | None = None
    not_sources: tuple[str, ...] | None = None
    pinned: bool | None = None
    ids: tuple[int, ...] | None = None
    bucket: str | None = None
    hidden: tuple[str, ...] = ()
    sub: str | None = None
    fmt: str | None = None
    from_where: str | None = None
    q: str | None = None

    def parts(self) -> dict[str, Column]:
        """The conditions by what releases them."""
        out: dict[str, list[Column]] = {}
        put = lambda name, c: out.setdefault(name, []).append(c)
        if self.day_from:
            put("day", F.col("date_key") >= self.day_from)
        if self.day_to:
            put("day", F.col("date_key") <= self.day_to)
        if self.sources is not None:
            put("source", F.col("src").isin(*self.sources))
        if self.not_sources:
            put("source", ~F.col("src").isin(*self.not_sources))
        if self.pinned is not None:
            put("pinned", F.coalesce("pinned", F.lit(False)) == self.pinned)
        if self.ids is not None:
            put("ids", F.col("id").isin(*self.ids))
        if self.bucket:
            put("bucket", F.col("bucket") == self.bucket)
        elif self.hidden:
            put("bucket", ~F.col("bucket").isin(*self.hidden))
        for name in ("sub", "fmt", "from_where"):
            if value := getattr(self, name):
                put(name, F.col(name) == value)
        if self.q:
            put("q", F.contains(F.lower(F.concat_ws("\n", *[text_of(F.col(c)) for c in SEARCHED])), F.lit(self.q.lower())))
        return {name: reduce(lambda a, b: a & b, columns) for name, columns in out.items()}

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self.parts().values(), F.lit(True))


def matching(e: DataFrame, f: Filter) -> DataFrame:
    return e.where(f.column())


def newest(e: DataFrame, n: int) -> DataFrame:
    return e.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def facets(e: DataFrame, f: Filter) -> DataFrame:
    """dimension, value, n: each dimension counted under all conditions but its own; choosing
    a bucket also releases its second level and the hidden ones.  One scan: every condition is
    tested once, behind a generator of one row, then each row is expanded to the dimensions
    whose conditions it meets and summed before the shuffle."""
    parts = f.parts()
    dims: list[tuple[str, tuple[str, ...], Column]] = [
        ("total", (), F.lit("")), ("source", ("source",), F.col("src")), ("type", (), F.col("type")), ("origin", ("from_where",), F.col("from_where")),
        ("day", ("day",), F.col("date_key")), ("bucket", ("bucket", "sub"), F.col("bucket")), ("all", ("bucket", "sub"), F.lit("")), ("pinned", ("pinned",), F.lit("")),
    ]
    if f.bucket:
        dims.append(("sub", ("sub",), F.col("sub")))
    tested = e.select(F.inline(F.array(F.struct(*[c.cast("string").alias(name) for name, _, c in dims], F.coalesce("pinned", F.lit(False)).alias("_pinned"), *[c.alias(f"_{name}_ok") for name, c in parts.items()]))))
    cells = []
    for name, free, _ in dims:
        ok = reduce(lambda a, b: a & b, [F.col(f"_{p}_ok") for p in parts if p not in free], F.col("_pinned") if name == "pinned" else F.lit(True))
        cells.append(F.when(ok, F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value"))))
    return tested.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_values(counts: DataFrame, dimension: str, most: int = 8) -> DataFrame:
    """The values to show: most frequent first, unknown last."""
    return counts.where(F.col("dimension") == dimension).orderBy((F.col("value") == "?"), F.col("n").desc(), "value").limit(most)


def clamp(n: int, most: int = 100) -> int:
    return max(1, min(int(n), most))


def ordered_days(e: DataFrame, most: int | None = None) -> DataFrame:
    days = e.groupBy("date_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("date_key").desc())
    return days.limit(clamp(most, 400)) if most else days


def by_ids(e: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Point look-ups that keep the order asked for."""
    wanted = e.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, rank int")
    return e.join(F.broadcast(wanted), "id").orderBy("rank")  # as many rows as the caller listed
