"""The entry table: its schema, views of other tables in that shape, and keyed mutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify
from ..functions.text import first_line, letters, text_of
from ..functions.titles import is_placeholder
from ..session import table

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampType()), T.StructField("date_key", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("origin", T.StringType()), T.StructField("app", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("pinned", T.BooleanType()),
    T.StructField("status", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
])
TYPES = ("note", "screenshot", "audio", "url", "pdf")
FROM = ("clipboard", "bookmark", "browser", "notion", "gmail", "", "")


def _pick(values: Sequence[str], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as entries: the first line is the title, the source the app; time, type,
    origin, pin and status follow from the id."""
    d, i = table(spark, folder, "documents"), F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + (i * 7919) % 5184000)
    kind = _pick(TYPES, i % 5)
    return d.select(
        i.alias("id"), at.alias("created_at"), F.date_format(at, "yyyy-MM-dd").alias("date_key"), kind.alias("type"),
        F.substring(first_line(F.col("text")), 1, 80).alias("title"), "text", _pick(FROM, i % 7).alias("origin"), F.col("source").alias("app"),
        F.when(kind == "url", F.concat(F.lit("https://www."), F.coalesce("source", F.lit("none")), F.lit(".co.uk/p/"), i)).alias("url"),
        F.when(kind == "pdf", F.concat(F.lit("files/"), i, F.lit(".pdf"))).alias("path"), F.when(kind == "audio", "audio/wav").alias("mime"),
        (i % 11 == 0).alias("pinned"), F.when(i % 97 == 0, "error").alias("status"), F.array(F.col("lang")).alias("tags"),
    )


def classified(e: DataFrame) -> DataFrame:
    """``e`` with src, fmt, from_where, bucket and sub: all that filters and facets look at."""
    fmt = classify.entry_format(F.col("mime"), F.coalesce("path", "title"), F.col("type"))
    e = e.withColumns({
        "src": classify.entry_source(F.col("origin"), F.col("type")), "fmt": fmt,
        "from_where": classify.entry_origin(F.col("url"), F.col("app"), F.col("title")),
        "bucket": classify.entry_bucket(F.col("origin"), F.col("type"), F.col("pinned")),
    })
    return e.withColumn("sub", classify.entry_sub(F.col("bucket"), F.col("fmt"), F.col("from_where"), classify.file_kind(F.col("path"), F.col("fmt"))))


def junk(e: DataFrame) -> F.Column:
    """No material: no id, a picture of the program itself (column ``self`` where there is one), or under eight
    letters in the text as well as in a title that is more than a kind with a time."""
    says = lambda c: letters(c) >= 8
    own = F.coalesce(F.col("self"), F.lit(False)) if "self" in e.columns else F.lit(False)
    head = F.when(is_placeholder(F.col("title")), "").otherwise(text_of(F.col("title")))
    return F.col("id").isNull() | own | ~(says(F.col("text")) | says(head))


def first_of_identical(e: DataFrame) -> DataFrame:
    """Of records with the same title and text (case and white space aside), the first one.
    An aggregate of ids, so a text that very many records share is summed before the shuffle."""
    key = F.sha2(F.lower(F.regexp_replace(F.concat_ws("\n", text_of(F.col("title")), text_of(F.col("text"))), r"\s+", "")), 256)
    first = e.groupBy(key.alias("_k")).agg(F.min(F.struct("created_at", "id")).alias("first"))
    return e.join(first.select(F.col("first.id").alias("_first")), F.col("id") == F.col("_first"), "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A merge by key: every row of either side with ``op`` insert, update, same or keep."""
    old = existing.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    new = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = old.join(new, F.col("_k") == F.col(key), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    op = F.when(F.col("_k").isNull(), "insert").when(F.col(key).isNull(), "keep").when(same, "same").otherwise("update")
    picked = [F.when(F.col(key).isNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in columns]
    return both.select(F.coalesce("_k", key).alias(key), *picked, op.alias("op"))


def replace_keyed(table_: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of ``changed`` in place of all rows with their keys."""
    return table_.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def missing(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no current counterpart: an anti join on all keys."""
    return wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")
