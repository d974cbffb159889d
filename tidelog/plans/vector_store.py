"""Vectors of texts: a table that is filled by a model and follows its texts.

``vectors``   one row for each different content, keyed by a hash of text, model and cutting; partitioned by
              the first day it was seen on
``pieces``    id, seq, hash of each record's pieces; partitioned by day, replaced day by day

A content is embedded once, however many records and runs have it; a second run over the same texts embeds
nothing, and a changed text only what is new in it.  The model is given as a function, so that tests and
clusters choose their own; it runs in Arrow batches, loaded once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text
from ..session import exists, saved

VECTORS = "hash string, v array<float>, day string"
PIECES = "id long, seq int, hash string, day string"


def pieces(e: DataFrame, model: str) -> DataFrame:
    """id, seq, chunk, hash, day: the overlapping pieces of each record's text."""
    cut = e.select("id", F.col("date_key").alias("day"), F.inline(text.chunks(F.col("text"))))
    return cut.select("id", "seq", "chunk", text.chunk_hash(F.col("chunk"), model).alias("hash"), "day")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def fill(e: DataFrame, path: str, model: str, make_predict: Callable[[], Callable], batch: int = 256) -> int:
    """Brings the store up to the records ``e`` (whole days of them); how many texts were embedded.

    ``make_predict`` loads the model and gives a function from an array of texts to an array of vectors.  Killed and
    run again, it goes on: vectors are appended before pieces point to them, and those that are there
    already aren't asked for again."""
    spark = e.sparkSession
    now = saved(pieces(e, model))
    known = _read(spark, f"{path}/vectors", VECTORS).select("hash")
    new = now.groupBy("hash").agg(F.min("chunk").alias("chunk"), F.min("day").alias("day")).join(known, "hash", "left_anti")
    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch)
    made = saved(new.select("hash", predict("chunk").alias("v"), "day"))
    n = made.count()
    if n:
        made.repartition("day").write.mode("append").partitionBy("day").parquet(f"{path}/vectors")
    now.select("id", "seq", "hash", "day").repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/pieces")
    return n


def load(spark: SparkSession, path: str, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
    """id, seq, day, v of the pieces, of some days where they are given.  A content that two runs embedded
    at the same time counts once."""
    own = _read(spark, f"{path}/pieces", PIECES)
    if day_from:
        own = own.where(F.col("day") >= day_from)
    if day_to:
        own = own.where(F.col("day") <= day_to)
    vectors = _read(spark, f"{path}/vectors", VECTORS).groupBy("hash").agg(F.first("v").alias("v"))
    return own.join(vectors, "hash").select("id", "seq", "day", "v")


def missing(e: DataFrame, path: str, model: str) -> DataFrame:
    """hash of each content of ``e`` that has no vector yet."""
    known = _read(e.sparkSession, f"{path}/vectors", VECTORS).select("hash")
    return pieces(e, model).select("hash").distinct().join(known, "hash", "left_anti")


def hashed_words(dim: int = 64) -> Callable[[], Callable]:
    """A model without weights: signed sums of hashed words, for tests and as a floor."""

    def make():
        import re
        import zlib

        import numpy as np

        def predict(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for k, t in enumerate(texts):
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[k, h % dim] += 1 if h & 1 << 31 else -1
            return out

        return predict

    return make
