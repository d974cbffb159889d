"""Sharding by a Feistel permutation of global row numbers with cycle walking.

Row number r of n goes to place p = permute(r) in a pseudo-random order that a seed fixes;
shard = p mod shards, slot = p div shards.  So shard counts differ by one at most, slots
have no gaps, and both follow from (seed, n, r) without any table; ``unpermute`` leads
back from a place to its row.

Defined results: rows are numbered by id (nulls last), then by text hash and size, so rows
that tie on all of them are interchangeable; a null text has 16 bytes and the checksum
of the empty text; an empty table gives an empty table; extra columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, row_numbers

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    return mix64(np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bits(n: int) -> tuple[int, int]:
    """Bits of the left and right half: a domain of at least n and under 2n (or 4)."""
    total = max(2, (n - 1).bit_length())
    return total // 2, total - total // 2


def _pass(x: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    """One application of the network to numbers of the whole domain.  The halves swap
    widths each round; after an even number of rounds they are as before."""
    a, b = _bits(n)
    keys = _round_keys(seed)
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    widths = [(a, b) if k % 2 == 0 else (b, a) for k in range(ROUNDS)]
    if not backwards:
        for k in range(ROUNDS):
            mask = np.uint64((1 << widths[k][0]) - 1)
            left, right = right, left ^ (mix64(right + keys[k]) & mask)
    else:
        for k in reversed(range(ROUNDS)):
            mask = np.uint64((1 << widths[k][0]) - 1)
            left, right = right ^ (mix64(left + keys[k]) & mask), left
    return (left << np.uint64(b)) | right


def _walk(x: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    """Cycle walking: numbers that leave [0, n) go on until they return."""
    out = _pass(np.asarray(x).astype(np.uint64), n, seed, backwards)
    while (away := out >= np.uint64(n)).any():
        out[away] = _pass(out[away], n, seed, backwards)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _walk(rows, n, seed, False)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _walk(places, n, seed, True)


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text).cast("long"), "_text_hash": F.xxhash64(text)})


def shard(rows: DataFrame, shards: int = 40, seed: int = 29, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (with size, text_crc32 and _text_hash of ``with_sizes``) with row_number,
    place, shard and slot.  Give only the columns that are needed: they all move once."""
    order = [F.col(f"`{id_col}`").asc_nulls_last(), F.col("_text_hash"), F.col("size")]
    numbered = row_numbers(rows, order, "row_number")
    n = numbered.count()

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    out = numbered.withColumn("place", place("row_number"))
    return out.withColumns({"law": F.lit("rows"), "shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("long"), "grown_shard": F.lit(None).cast("int")})
