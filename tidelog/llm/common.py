"""Small helpers shared by the operators: hashing words, saved tables, row numbers."""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_saved, saved, saved_dir, shared_dir  # noqa: F401

#: White space as the contracts define it; a word is a run of anything else.
WORD = regex.compile("[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything at ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, order sensitive."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        out = out * base + h[k : k + m]
    return mix64(out)


def row_numbers(df: DataFrame, order: list[Column], name: str, add: dict[str, tuple[list[Column], Column]] | None = None) -> DataFrame:
    """Gapless row numbers from 0 in the global order of ``order``, without one task that
    sees all rows: rows are dealt by range, numbered within each range, and each range adds
    the rows of the ranges before it (one count per range comes to the driver).

    ``df`` should be narrow and already cut from its lineage where it is costly.  Rows that
    tie on ``order`` get numbers in an arbitrary order; give enough columns to settle ties.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    dealt = saved(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range") + 1) if offsets else F.lit(0).cast("long")
    w = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn(name, start + F.row_number().over(w) - 1).drop("_range")
