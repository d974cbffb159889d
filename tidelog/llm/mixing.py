"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

The total to share is given by weight; a source is clamped at ``max_epochs`` times its own
size, and what it leaves is shared among the others by weight, until none is above.  Each
round is one small aggregate over the table of sources, so sources may be many.  A
target of e times its source's size takes each document floor(e) times, and once more the
documents that come first in a seeded order until the rest of the target is reached.

Defined results: a null text has size 0; null sources form one source, after all others;
an empty table gives an empty table; repeated rows are separate documents; extra columns
are carried along, and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_numbers, saved, shuffle_partitions

SPACE = r"[\x20\x09-\x0D]+"


def n_words(text_col: str = "text"):
    return F.coalesce(F.size(F.array_remove(F.split(F.col(f"`{text_col}`"), SPACE), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], max_epochs: int, share: int | None = None) -> DataFrame:
    """``sources`` (source, source_size) with its weight and target.  Weights are dealt in
    code-point order of the source, null last, repeating.  ``share``: words to share, by
    default all."""
    ranked = saved(row_numbers(sources, [F.col("source").asc_nulls_last()], "_rank"))
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = ranked.withColumns({"weight": w, "_cap": F.col("source_size") * max_epochs})
    if share is None:
        share = table.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words a unit of weight gets
    while True:
        # A source once clamped stays so, as the level only rises.
        capped = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("weight")
        done = table.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0)).alias("cap"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not done["weight"]:
            break
        following = (share - done["cap"]) / done["weight"]
        if following == level:
            break
        level = following
    goal = F.col("_cap").cast("double") if level is None else F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return table.withColumn("target", goal).select("source", "source_size", "weight", "target")


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, key_cols: Sequence[str] = ("doc_id",), source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each document: key columns, source, size, _text_hash, source_size, target,
    copies and taken = copies * size.

    The extra copies go to a prefix of a seeded order of each source's documents.  Prefix
    sums are made without one task for a source: rows are dealt by ranges of (source, order),
    summed within each range, and each range adds the sums of the ranges before it.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keys = [F.col(f"`{k}`") for k in key_cols]
    narrow = docs.select(*keys, F.col(f"`{source_col}`").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text_hash"))
    narrow = narrow.withColumn("_order", F.md5(F.concat_ws("/", F.lit(seed), *[F.col(f"`{k}`").cast("string") for k in key_cols])))
    order = [F.col("source").asc_nulls_last(), F.col("_order"), *keys, F.col("size"), F.col("_text_hash")]
    dealt = saved(narrow.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    # Rows: at most ranges + sources.
    parts = saved(dealt.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    sources = parts.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    goals = targets(sources, weights, max_epochs)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long"))).drop("_sum")
    facts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    within = Window.partitionBy("_range", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    rows = summed.join(facts, (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(epochs))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = F.when(F.col("_start") + F.col("_before") + F.col("size") / 2 < rest, 1).otherwise(0)
    rows = rows.withColumn("copies", (F.col("_whole") + extra).cast("long"))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select(*keys, "source", "size", "_text_hash", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each row as many times as the plan takes it, with the
    columns of ``docs``.  Repeated rows get the same number of copies each."""
    counts = plan(docs, weights, max_epochs, seed)
    # Repeated rows (same id, source and text) may differ by one copy: share them evenly.
    counts = counts.groupBy("doc_id", "source", "_text_hash").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    counts = counts.select(F.col("doc_id").alias("_m_id"), F.col("source").alias("_m_source"), F.col("_text_hash").alias("_m_hash"), F.ceil(F.col("_copies") / F.col("_rows")).cast("int").alias("_m_copies"))
    marked = docs.withColumn("_m_text", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_m_id")) & F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("_m_text") == F.col("_m_hash"))
    rows = marked.join(counts.where("_m_copies > 0"), on)
    return rows.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), F.col("_m_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
