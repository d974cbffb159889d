"""Line dedup with two Bloom filters, of hashes seen once and of hashes seen twice.

Pass 1 fills both filters for each task and merges them segment by segment: a bit is in
the merged twice-filter if it is in some task's twice-filter or in two once-filters, so no
repeated key is missed.  Pass 2 sends only keys in the twice-filter through a shuffle,
already summed for each batch, where 128-bit digests are counted exactly and the first
occurrence is chosen.  Pass 3 drops the lines.  The keys found most often are broadcast: those
in n documents or more, with n such that there can't be more than ``broadcast_keys`` of them.
The others, if any, meet the documents' suspected lines in a join on the digest, in which
by that choice no key has more than a ``broadcast_keys``-th of the rows.

A filter has at most ``max_bits`` bits whatever the input; beyond that more keys are
suspected and shuffled, but the counts stay exact.

Defined results: a null text is one empty line and stays null; the empty key is never
dropped; repeated rows are separate documents; of a line that repeats within a document
each copy goes; extra columns are carried along, n_lines and n_dropped are replaced, and names
that start with __line_dedup_ are reserved.  Ids are read as long integers.
With ``keep_first`` the first of the repeated lines stays: the least (id, nulls last),
then text hash, then line number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SEGMENT = 1 << 16  # bits


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The digest of each line's key, None for keys of fewer than ``least`` code points.
    Bytes lower and strip ASCII only, which is what keys ask for."""
    keys = [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    if least <= 1:
        return [_digest(k) if k or least < 1 else None for k in keys]
    return [_digest(k) if len(k.decode("utf-8", "surrogatepass")) >= least else None for k in keys]


_digest = xxhash.xxh3_128_digest


def _pairs(keys: set[bytes] | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)


class _Filter:
    """Bits kept as one array for each segment in use."""

    def __init__(self, bits: int, hashes: int):
        self.bits, self.hashes = bits, hashes
        self.array = np.zeros(bits // 8, dtype=np.uint8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        k = np.arange(self.hashes, dtype=np.uint64)[None, :]
        return (keys[:, :1] + k * (keys[:, 1:] | np.uint64(1))) & np.uint64(self.bits - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p = self.places(keys)
        return ((self.array[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        p = self.places(keys).ravel()
        np.bitwise_or.at(self.array, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def _doc_keys(text: str | None, least: int) -> set[bytes]:
    keys = set(line_keys(text, least))
    keys.discard(None)
    return keys


def twice_filter(docs: DataFrame, text_col: str, least: int, max_bits: int, bytes_per_line: int = 64) -> tuple[bytes, int, int]:
    """(bits of the merged twice-filter, compressed; number of bits; hashes for each key)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A guess at the lines from the bytes: only the filter's size depends on it.
    lines = (docs.agg((F.sum(F.octet_length(text)) / bytes_per_line).cast("long")).first()[0] or 0) + 1
    bits = min(max_bits, max(SEGMENT, 1 << (10 * int(lines) - 1).bit_length()))
    hashes = max(1, min(4, round(0.7 * bits / lines)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = _Filter(bits, hashes), _Filter(bits, hashes)
        for batch in batches:
            seen: set[bytes] = set()
            again: set[bytes] = set()
            for value in batch.column(0):
                keys = _doc_keys(value.as_py(), least)
                again |= seen & keys
                seen |= keys
            if seen:
                pairs = _pairs(seen)
                known = pairs[once.holds(pairs)]
                twice.add(known)
                once.add(pairs)
            if again:
                twice.add(_pairs(again))
        o, t = once.array.reshape(-1, SEGMENT // 8), twice.array.reshape(-1, SEGMENT // 8)
        for k in np.flatnonzero(o.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(o[k].tobytes(), 1)], pa.binary()), pa.array([zlib.compress(t[k].tobytes(), 1)], pa.binary())], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, o, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (o, t))
                if k in once:
                    twice[k] |= b | (once[k] & a)
                    once[k] |= a
                else:
                    once[k], twice[k] = a.copy(), b.copy()
        for k, b in twice.items():
            if b.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], names=["segment", "twice"])

    parts = docs.select(text.alias("_text")).mapInArrow(fill, "segment long, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(merge, "segment long, twice binary")
    array = np.zeros(bits // 8, dtype=np.uint8).reshape(-1, SEGMENT // 8)
    for row in merged.collect():  # at most max_bits bits
        array[row["segment"]] = np.frombuffer(zlib.decompress(row["twice"]), dtype=np.uint8)
    return zlib.compress(array.tobytes(), 1), bits, hashes


def repeated_keys(docs: DataFrame, min_docs: int = 10, least: int = 1, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28, twice: tuple | None = None) -> DataFrame:
    """Keys found in ``min_docs`` documents or more: digest, n_docs, and the first
    occurrence as first = (id is null, id, text hash, line)."""
    packed, bits, hashes = twice or twice_filter(docs, text_col, least, max_bits)
    shipped = docs.sparkSession.sparkContext.broadcast(packed)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = _unpacked(shipped.value, bits, hashes)
        for batch in batches:
            n: dict[bytes, int] = {}
            first: dict[bytes, tuple] = {}
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own: dict[bytes, int] = {}
                for line, key in enumerate(line_keys(text.as_py(), least)):
                    if key is not None:
                        own.setdefault(key, line)
                if not own:
                    continue
                keys = list(own)
                for key in (keys[k] for k in np.flatnonzero(twice.holds(_pairs(keys)))):
                    n[key] = n.get(key, 0) + 1
                    at = (doc_id is None, doc_id or 0, text_hash, own[key])
                    if key not in first or at < first[key]:
                        first[key] = at
            keys = list(n)
            at = list(zip(*(first[k] for k in keys), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n[k] for k in keys], pa.int64()), *[pa.array(list(c), t) for c, t in zip(at, (pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names=["digest", "n", "_null", "_id", "_hash", "_line"])

    parts = _keyed(docs, id_col, text_col).mapInArrow(suspects, "digest binary, n long, _null boolean, _id long, _hash long, _line long")
    counted = parts.groupBy("digest").agg(F.sum("n").alias("n_docs"), F.min(F.struct("_null", "_id", "_hash", "_line")).alias("first"))
    return counted.where(F.col("n_docs") >= min_docs)


def _unpacked(packed: bytes, bits: int, hashes: int) -> _Filter:
    out = _Filter(bits, hashes)
    out.array = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def _light_lists(docs: DataFrame, light: DataFrame, heavy, twice: tuple, least: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash, found: the keys of ``light`` that a document holds.  Only lines that the
    twice-filter suspects and the broadcast doesn't settle are shuffled."""
    packed, bits, hashes = twice
    shipped = docs.sparkSession.sparkContext.broadcast(packed)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice_ = _unpacked(shipped.value, bits, hashes)
        for batch in batches:
            rows: list[int] = []
            found: list[bytes] = []
            for k, text in enumerate(batch.column(2)):
                keys = [x for x in _doc_keys(text.as_py(), least) if x not in heavy.value]
                if keys:
                    some = [keys[i] for i in np.flatnonzero(twice_.holds(_pairs(keys)))]
                    rows += [k] * len(some)
                    found += some
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.binary())], names=["_id", "_hash", "digest"])

    lines = _keyed(docs, id_col, text_col).mapInArrow(own, "_id long, _hash long, digest binary")
    met = lines.join(light.select("digest", "first.*").withColumnsRenamed({"_id": "_first", "_hash": "_text"}), "digest")
    return met.groupBy("_id", "_hash").agg(F.collect_set(F.struct("digest", "_null", "_first", "_text", "_line")).alias("found"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28, broadcast_keys: int = 300_000) -> DataFrame:
    """``docs`` without the lines whose key is repeated, with n_lines and n_dropped."""
    spark = docs.sparkSession
    twice = twice_filter(docs, text_col, least, max_bits)
    hot = saved(repeated_keys(docs, min_docs, least, id_col, text_col, max_bits, twice))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = docs.select([F.col(f"`{c}`") for c in names])
    size = hot.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("rows")).first()
    # Fewer than ``broadcast_keys`` keys can stand in ``from_docs`` documents or more each.
    from_docs = 0 if size["keys"] <= broadcast_keys else size["rows"] // max(1, broadcast_keys) + 1
    shipped = spark.sparkContext.broadcast({bytes(r["digest"]): tuple(r["first"]) for r in hot.where(F.col("n_docs") >= from_docs).collect()})
    own_hash = F.xxhash64(F.col(f"`{text_col}`"))
    if from_docs:
        lists = _light_lists(docs, hot.where(F.col("n_docs") < from_docs), shipped, twice, least, id_col, text_col).select(F.col("_id").alias("__line_dedup_id"), F.col("_hash").alias("__line_dedup_own"), F.col("found").alias("__line_dedup_found"))
        on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__line_dedup_id")) & (F.col("__line_dedup_hash") == F.col("__line_dedup_own"))
        sure = kept.withColumn("__line_dedup_hash", own_hash).join(lists, on, "left").drop("__line_dedup_id", "__line_dedup_own")
    else:
        sure = kept.withColumn("__line_dedup_hash", own_hash)
    at_id, at_text, width = names.index(id_col), names.index(text_col), len(names)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shipped.value
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for k, value in enumerate(batch.column(at_text)):
                text = value.as_py()
                listed = batch.column(width + 1)[k].as_py() if from_docs else None
                light = {x["digest"]: (x["_null"], x["_first"], x["_text"], x["_line"]) for x in listed or ()}
                lines = (text or "").split("\n")
                out = []
                doc_id, text_hash = batch.column(at_id)[k].as_py(), batch.column(width)[k].as_py()
                own = (doc_id is None, int(doc_id or 0), text_hash)
                for line_no, (line, key) in enumerate(zip(lines, line_keys(text, least), strict=True)):
                    first = heavy.get(key) or light.get(key)
                    if first is None or keep_first and first == (*own, line_no):
                        out.append(line)
                texts.append(None if text is None else "\n".join(out))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(out))
            columns = [pa.array(texts, pa.string()) if i == at_text else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_lines long, n_dropped long"])
    return sure.mapInArrow(drop, schema)
