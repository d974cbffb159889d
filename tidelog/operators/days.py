"""Daily statistics and uptime slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import text_of


def day_stats(e: DataFrame) -> DataFrame:
    """One row a day: totals, failures, characters, first and last minute, busiest hour."""
    hours = e.groupBy("date_key", F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed"), F.count_if("pinned").alias("pinned"),
        F.sum(F.length(F.trim(text_of(F.col("text"))))).alias("chars"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )
    return hours.groupBy("date_key").agg(
        F.sum("n").alias("total"), F.sum("failed").alias("failed"), F.sum("pinned").alias("pinned"), F.sum("chars").alias("chars"),
        F.date_format(F.min("first"), "HH:mm").alias("first_clock"), F.date_format(F.max("last"), "HH:mm").alias("last_clock"),
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("busiest_hour"),
    )


def day_counts(e: DataFrame, dimension: str) -> DataFrame:
    return e.groupBy("date_key", F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def breakdown(e: DataFrame, dimensions: tuple[str, ...] = ("type", "src", "app", "status"), slots: DataFrame | None = None) -> DataFrame:
    """date_key, dimension, value, n: a day's records by each dimension and by hour, in one pass; with
    ``slots`` (day, minutes) also the minutes that the recorder ran."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions], F.struct(F.lit("hour").alias("dimension"), F.hour("created_at").cast("string").alias("value")))
    out = e.select("date_key", F.inline(cells)).groupBy("date_key", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return out if slots is None else out.unionByName(slots.select(F.col("day").alias("date_key"), F.lit("minutes").alias("dimension"), F.lit("").alias("value"), F.col("minutes").cast("long").alias("n")))


def listed(e: DataFrame, slots: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """date_key, n, kinds (type -> n), pinned, minutes that the recorder ran (null: unknown), status: ok where records
    were kept, idle where the recorder ran and kept none; the newest ``most`` days."""
    by_kind = e.groupBy("date_key", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("pinned", F.lit(False))).alias("pinned"), F.count_if(~F.col("status").eqNullSafe("error")).alias("kept"))
    day = by_kind.groupBy("date_key").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("kinds"), F.sum("pinned").alias("pinned"), F.sum("kept").alias("kept"))
    ran = slots.select(F.col("day").alias("date_key"), F.col("minutes").cast("long").alias("minutes")) if slots is not None else e.select("date_key", F.lit(None).cast("long").alias("minutes")).limit(0)
    both = day.join(ran, "date_key", "full").fillna(0, ["n", "pinned", "kept"])
    status = F.when(F.col("kept") > 0, "ok").when(F.col("minutes") > 0, "idle").otherwise("off")
    out = both.select("date_key", "n", F.coalesce("kinds", F.create_map().cast("map<string,bigint>")).alias("kinds"), "pinned", "minutes", status.alias("status")).orderBy(F.col("date_key").desc())
    return out.limit(most) if most else out


def top_titles(e: DataFrame, most: int = 3) -> DataFrame:
    """Per day and app the first few distinct titles, in order of time."""
    seen = e.where(text_of(F.col("title")) != "").groupBy("date_key", "app", "title").agg(F.min(F.struct("created_at", "id")).alias("at"))
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("date_key", "app").orderBy("at")))
    return ranked.where(F.col("r") <= most).select("date_key", "app", "r", "title")


def stats_lines(stats: DataFrame) -> DataFrame:
    return stats.select("date_key", F.concat_ws("\n", F.concat(F.lit("records: "), "total"), F.concat(F.lit("failed: "), "failed"), F.concat(F.lit("from "), "first_clock", F.lit(" to "), "last_clock")).alias("lines"))


def recap(e: DataFrame, most: int = 10_000) -> DataFrame:
    """Per day and type the count and, in order of time, the titles, in parts of at most ``most``
    of them, so that no row holds a whole busy day."""
    w = Window.partitionBy("date_key", "type").orderBy("created_at", "id")
    rows = e.select("date_key", "type", "created_at", "id", "title", ((F.row_number().over(w) - 1) / most).cast("int").alias("part"))
    parts = rows.groupBy("date_key", "type", "part").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("created_at", "id", "title"))).alias("items"))
    return parts.select("date_key", "type", "part", "n", F.transform("items", lambda x: x["title"]).alias("titles"))


def uptime_slots(rows: DataFrame, at: str = "ts", minutes: int = 5) -> DataFrame:
    """Per day the slots in which anything happened: count, minutes, first and last slot."""
    slot = ((F.hour(at) * 60 + F.minute(at)) / minutes).cast("int")
    used = rows.select(F.date_format(at, "yyyy-MM-dd").alias("day"), slot.alias("slot")).distinct()
    return used.groupBy("day").agg(F.count(F.lit(1)).alias("slots"), (F.count(F.lit(1)) * minutes).alias("minutes"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def slot_clock(slot, minutes: int = 5):
    m = slot * minutes
    return F.format_string("%02d:%02d", (m / 60).cast("int"), (m % 60).cast("int"))
