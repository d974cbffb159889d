"""One object for a workspace: its records, lists, counts, searches, days, sessions and pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze, text_of
from ..operators import days, entries, filters, hygiene, pages, search, sessions
from ..operators.filters import Filter
from . import retrieval

EXCERPT = 220


def brief(e: DataFrame, chars: int = EXCERPT) -> DataFrame:
    """What a list shows of each record, with a link to it."""
    return e.select("id", "created_at", "type", "title", "app", "pinned", F.substring(squeeze(F.col("text")), 1, chars).alias("excerpt"), F.concat(F.lit("entry/"), F.col("id")).alias("link"))


def full(e: DataFrame) -> DataFrame:
    """All of each record, with a link to it."""
    return e.withColumn("link", F.concat(F.lit("entry/"), F.col("id")))


def digest(e: DataFrame, budget: int, least: int = 150, most: int = 600) -> DataFrame:
    """date_key, place, id, line: a day's records as lines in order of time, each with as much text as
    the day's budget of characters allows (``least`` to ``most``); lines stop where the budget does,
    with one that says so (id null).  All lines of a day are numbered together."""
    n = e.groupBy("date_key").agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(budget / F.col("_n")))).cast("int")
    where = F.when(text_of(F.col("app")) != "", F.concat(F.lit(" | from "), F.col("app"), F.when(text_of(F.col("url")) != "", F.concat(F.lit(" <"), F.col("url"), F.lit(">"))).otherwise("")))
    excerpt = F.substring(squeeze(F.col("text")), F.lit(1), share)
    line = F.concat(
        F.lit("- ["), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("] ("), F.col("type"), F.lit(") "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("path"), F.lit("")),
        text_of(where), F.when(excerpt != "", F.concat(F.lit(" | "), excerpt)).otherwise(""),
    )
    lines = e.join(n, "date_key").select("date_key", "created_at", "id", line.alias("line"))
    w = Window.partitionBy("date_key").orderBy("created_at", "id")
    used = lines.withColumns({"_used": F.sum(F.length("line")).over(w), "place": F.row_number().over(w)})
    kept = used.where(F.col("_used") <= budget).select("date_key", "place", "id", "line")
    cut = used.where(F.col("_used") > budget).groupBy("date_key").agg(F.min("place").alias("place"))
    return kept.unionByName(cut.select("date_key", "place", F.lit(None).cast(dict(e.dtypes)["id"]).alias("id"), F.lit("- [... more items omitted]").alias("line")))


def exact_and_near(exact: DataFrame, near: DataFrame, e: DataFrame) -> DataFrame:
    """id, near: both lists' records in order of time; ``near`` where only the second has it."""
    both = exact.select("id", F.lit(False).alias("near")).unionByName(near.select("id", F.lit(True).alias("near"))).groupBy("id").agg(F.min("near").alias("near"))
    return both.join(e.select("id", "created_at"), "id").orderBy(F.col("created_at").desc(), F.col("id").desc()).select("id", "near")


def has_text(e: DataFrame, texts: DataFrame, latest: int = 300) -> DataFrame:
    """Those of ``texts`` (text) that one of the ``latest`` records has, white space at the ends aside."""
    seen = filters.newest(e, latest).select(F.trim(text_of(F.col("text"))).alias("_t")).distinct()
    return texts.join(F.broadcast(seen), F.trim(text_of(F.col("text"))) == F.col("_t"), "left_semi")  # at most ``latest`` rows


def table_stats(e: DataFrame, sizes: Sequence[str] = ("text",)) -> DataFrame:
    """Rows, different ids and days, and the bytes of the columns ``sizes``."""
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("date_key").alias("days"), *[F.coalesce(F.sum(F.octet_length(text_of(F.col(c)))), F.lit(0)).alias(f"{c}_bytes") for c in sizes])


def with_vectors(e: DataFrame, vectors: DataFrame, wanted: Column) -> DataFrame:
    """Records that have a vector of what they hold now: ``vectors`` has id and hash."""
    return e.withColumn("_h", wanted).join(vectors.select("id", F.col("hash").alias("_h")), ["id", "_h"], "left_semi").drop("_h")


def followed(apps: DataFrame, allow: Sequence[str], ignore: Sequence[str] = (), sites: Sequence[str] = (), host: str = "host") -> DataFrame:
    """Rows (app, host) that a follow list takes: apps by name, and what a browser shows by a site or
    its subdomains; the ignored ones never."""
    name, h = F.lower(text_of(F.col("app"))), F.lower(text_of(F.col(host)))
    among = lambda names: name.isin(*[n.lower() for n in names]) if names else F.lit(False)
    on_site = F.lit(False)
    for s in sites:
        on_site = on_site | (h == s.lower()) | F.endswith(h, F.lit("." + s.lower()))
    return apps.where((among(allow) | on_site) & ~among(ignore))


def media_list(items: DataFrame, kinds: Sequence[str] | None = None, least_size: int = 0) -> DataFrame:
    """A page's media (url, kind, size, width, height) worth a place: of the kinds asked for and not
    known to be small; streams and videos first, then by area and size."""
    rows = items.where(F.col("kind").isin(*kinds)) if kinds else items
    rank = F.when(F.col("kind") == "stream", 3).when(F.col("kind") == "video", 2).when(F.col("kind") == "audio", 1).otherwise(0)
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0))
    return rows.where(F.coalesce(F.col("size"), F.lit(least_size)) >= least_size).orderBy(rank.desc(), area.desc(), F.coalesce("size", F.lit(0)).desc(), "url")


class Workspace:
    """Records of a folder of tables, or any DataFrame of the entry schema, and what is asked of them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, records: DataFrame | None = None, index: retrieval.Index | None = None):
        if (folder is None) == (records is None):
            raise ValueError("give a folder or records")
        self.spark = spark
        self._entries = entries.classified(entries.entries(spark, folder) if records is None else records)
        self._index = index

    def entries(self) -> DataFrame:
        return self._entries

    @property
    def index(self) -> retrieval.Index:
        if self._index is None:
            self._index = retrieval.Index(self._entries)
        return self._index

    def list(self, limit: int | None = None, **conditions) -> DataFrame:
        rows = filters.matching(self._entries, Filter(**conditions))
        return rows if limit is None else filters.newest(rows, filters.clamp(limit))

    def stats(self, **conditions) -> DataFrame:
        return filters.facets(self._entries, Filter(**conditions))

    def search(self, q: str, limit: int = 20, **conditions) -> DataFrame:
        return retrieval.search_entries(self._entries, q, Filter(**conditions) if conditions else None, limit)

    def near(self, chunks: DataFrame, query: Sequence[float], exclude: Sequence[int] = (), k: int = 12, **days_: str) -> DataFrame:
        return retrieval.near(self._entries, chunks, query, exclude, k, **days_)

    def ask(self, questions: Sequence[str], today: date, **options) -> DataFrame:
        return retrieval.answer(self.index, questions, today, **options)

    def get_entry(self, entry_id) -> DataFrame:
        return full(self._entries.where(F.col("id") == F.lit(entry_id)))

    def pinned(self, limit: int = 20) -> DataFrame:
        return brief(filters.newest(self._entries.where("pinned"), filters.clamp(limit)))

    def days(self, most: int = 60) -> DataFrame:
        return filters.ordered_days(self._entries, most)

    def day(self, day: str) -> DataFrame:
        return brief(self._entries.where(F.col("date_key") == day)).orderBy("created_at", "id")

    def day_stats(self) -> DataFrame:
        return days.day_stats(self._entries)

    def digest(self, budget: int = 12_000) -> DataFrame:
        return digest(self._entries, budget)

    def sessions(self, trail: DataFrame, key: str, at: str, app: str, title: str, tie: str, **options) -> DataFrame:
        return sessions.focus_sessions(trail, key, at, app, title, tie, **options)

    def pages(self, trail: DataFrame, needles: Sequence[str], **options) -> DataFrame:
        return pages.find_pages(trail, needles, **options)

    def redact(self, level: str = "secrets") -> DataFrame:
        """The records with their texts masked; the originals stay."""
        return hygiene.redact(self._entries, level)

    def stripped(self) -> DataFrame:
        return hygiene.stripped(self._entries, hygiene.furniture(self._entries))

    def echo_free(self, questions: Sequence[str]) -> DataFrame:
        return self._entries.where(hygiene.not_echo(self._entries, questions))


def names_in_turn(names: DataFrame, order: DataFrame, per_record: int = 3) -> DataFrame:
    """place, key: names of the records in ``order`` (id, rank), in turns: each record's first, then
    the seconds and thirds; the others follow by how often these records have them over how
    common they are.  ``names`` has id, key, kind and df; in a record sure kinds come before
    names, two Han letters last, rarer ones first.  Both are a question's few records."""
    rows = names.join(order.select("id", F.col("rank").alias("_lane")), "id")
    tier = F.when(F.col("kind") != "name", 0).when(F.col("key").rlike(r"^\p{IsHan}{2}$"), 2).otherwise(1)
    turn = F.row_number().over(Window.partitionBy("id").orderBy(tier, "df", "key")) - 1
    one = rows.withColumn("_turn", turn).groupBy("key").agg(
        F.min(F.when(F.col("_turn") < per_record, F.struct("_turn", "_lane"))).alias("first"), F.count(F.lit(1)).alias("n"), F.min("df").alias("df"),
    )
    weight = F.round(F.col("n") / F.log2(2 + F.col("df")), 9)
    w = Window.orderBy(F.col("first").isNull(), F.col("first._turn"), F.col("first._lane"), weight.desc(), "key")
    return one.select((F.row_number().over(w) - 1).alias("place"), "key")
