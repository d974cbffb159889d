"""Importance resampling towards a target distribution, on hashed word features.

Each text's features are its runs of 1 to ``max_n`` consecutive words; a feature falls into the
bucket of its checksum.  A bucket's gain says how much likelier it is among the target's features
than among the documents'; a document's weight is the mean gain of its features, and its score the
weight plus noise of its own (Gumbel, seeded by the id), so that the best scores are a draw
without replacement in proportion to the weights.

Identical texts are collapsed first: rows are grouped by full text, the features of each text are
computed once and written, and its counts are multiplied by the number of its copies.  Weights
are joined back to the documents by the text's digest before the noise is added.  A text that makes
up a thousandth of all rows or more comes from a broadcast table (at most 1,000 such texts can
exist), so no key of the joins is hot.  Gains are one row of ``buckets`` numbers.

Ranks are gapless numbers over ranges of the sorted scores; no task sees all rows.

Defined results: a null or word-free text has no features and weight 0; a null id draws its noise as
an empty string and loses ties; repeated rows are drawn each (equal ones in any order).  With an
empty target or an empty table of documents all counts on that side are 0.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_numbers, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after lower-casing A-Z: ASCII letters and digits, and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HOT_SHARE = 1000


def lowered(text: Column) -> Column:
    """Only A-Z in lower case; lower() is the faster way where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def feature_buckets(words: Column, max_n: int, buckets: int) -> Column:
    """array<int>: the bucket of each run of 1 to ``max_n`` words, repeats included."""

    def runs(n: int) -> Column:
        bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
        if n == 1:
            return F.transform(words, bucket)
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(*[runs(n) for n in range(1, max_n + 1)])


def distinct_texts(rows: DataFrame, max_n: int, buckets: int, text_col: str = "text") -> DataFrame:
    """_key (digest), copies, n_words, n_features, features: one row for each different text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = rows.groupBy(text.alias("_text")).agg(F.count(F.lit(1)).alias("copies"))
    words = texts.select(_digest("_text").alias("_key"), "copies", F.regexp_extract_all(lowered(F.col("_text")), F.lit(WORDS), F.lit(0)).alias("_words"))
    # The generator of one row keeps the words from being cut again for each column.
    held = words.select("_key", "copies", F.explode(F.array("_words")).alias("_words"))
    made = held.select("_key", "copies", F.size("_words").cast("long").alias("n_words"), feature_buckets(F.col("_words"), max_n, buckets).alias("features"))
    return made.select("_key", "copies", "n_words", F.size("features").cast("long").alias("n_features"), "features")


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def bucket_counts(texts: DataFrame, name: str) -> DataFrame:
    """_bucket and how many features fall into it, copies counted."""
    return texts.select("copies", F.explode("features").alias("_bucket")).groupBy("_bucket").agg(F.sum("copies").alias(name))


def gain_row(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row, ``gains``: array<bigint> with each bucket's gain in thousandths."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    both = every.join(bucket_counts(source, "s"), "_bucket", "left").join(bucket_counts(target, "t"), "_bucket", "left").fillna(0, ["s", "t"])
    one = both.agg(F.sort_array(F.collect_list(F.struct("_bucket", "s", "t"))).alias("b"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: c.cast("double")
    ratio = lambda x: ((d(x["t"]) + 1) * (d(F.col("all_s")) + buckets)) / ((d(x["s"]) + 1) * (d(F.col("all_t")) + buckets))
    return one.select(F.transform("b", lambda x: F.floor(1000 * F.log(ratio(x)))).alias("gains"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """For each document the id, n_features, weight, score and rank (1, 2, 3... among the
    floor(percent * N / 100) drawn of the N documents with ``min_words`` words; null: not drawn)."""
    texts = saved(distinct_texts(docs, max_n, buckets, text_col))
    gains = F.broadcast(saved(gain_row(texts, distinct_texts(target, max_n, buckets, target_col), buckets)))
    total = F.aggregate("features", F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at("gains", b + 1))
    # Division of integers, rounding down; exact in doubles at these sizes.
    mean = F.when(F.col("n_features") > 0, F.floor(total / F.col("n_features"))).otherwise(F.lit(0).cast("bigint"))
    weights = saved(texts.crossJoin(gains).select("_key", "copies", "n_words", "n_features", mean.alias("weight")))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).select("_id", _digest("_text").alias("_key"))
    scored = saved(with_weights(rows, weights).select("_id", "_key", "n_features", "weight", (F.col("weight") + noise(F.col("_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("_in")))
    draws = percent * scored.where("_in").count() // 100
    order = [F.col("_in").desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_key")]
    ranked = row_numbers(scored, order, "_n")
    rank = F.when(F.col("_in") & (F.col("_n") < draws), F.col("_n") + 1).cast("long")
    return ranked.select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (_id, _key) with what ``weights`` says of each _key."""
    facts = ["n_words", "n_features", "weight"]
    total = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).head()["n"]
    hot = F.col("copies") * HOT_SHARE >= total
    common = weights.where(hot).select(F.col("_key").alias("_hot"), F.struct(*facts).alias("_facts"))
    rare = weights.where(~hot).select(F.col("_key").alias("_rare"), F.struct(*facts).alias("_own"))
    known = rows.join(F.broadcast(common), F.col("_key") == F.col("_hot"), "left")
    # Rows that have their facts get a key of their own, which no weight has.
    spread = F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(F.xxhash64("_id").cast("string").cast("binary"))
    full = known.withColumn("_at", spread).join(rare, F.col("_at") == F.col("_rare"), "left")
    found = F.coalesce("_facts", "_own")
    return full.select("_id", "_key", *[found[f].alias(f) for f in facts])


def drawn(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn; ids are meant to be unique."""
    ids = judged.where("rank IS NOT NULL").select(F.col(f"`{id_col}`").alias("_drawn")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn")), "left_semi")
