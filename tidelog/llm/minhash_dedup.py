"""MinHash near-dedup with an LSH forest over sorted signature orders.

Each distinct shingle set has ``pool`` min-hash values.  An order is a sequence of them; sorted
by it, the sets with the same first values stand together and form a region.

1. Every set has a row in each order; rows are sorted by range, so neither an order nor a
   region is gathered in one task.
2. A region of at most ``run`` rows is one run, all of whose pairs are looked at.  In a larger
   one the longest common prefixes are sought: its rows are cut, in sorted order, into runs
   that overlap by ``lap``, and the neighbours within a run are looked at.
3. To look at a pair is to compare signatures; those that agree far too rarely (more than 5.5
   standard deviations below the threshold) are dropped.  A pair belongs to the first order in
   which its regions agree, so it is confirmed once, on full shingle sets, which travel
   once for each run that confirms one of their pairs.
4. Links join sets to components.  A region that was cut and still holds more than one
   component goes down to the next depth of ``DEPTHS`` with as many more orders as keep the
   miss bound, and only its sets do: the depth adapts to each region, rows stay linear.
5. What is crowded at the last depth as well is compared whole, block by block.

At a similarity s a link shares no region with a probability of (1 - s^depth)^orders; orders
are as many as make that ``miss`` (1e-6) at the threshold.  Copies with equal sets are one
node, so they are never expanded into pairs.

Defined results: null, empty and word-free texts have an empty set, which is linked with
nothing (also not with another empty one): component_id is the row's own id.  Repeated
rows share a component.  A null id takes part, but is no component's name while a member
has an id; ties go to the smallest id.  Ids are read as long integers (a string that isn't one
counts as null, or fails under ANSI mode).  Other columns aren't read; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, mix64, saved, shuffle_partitions, window_hashes
from .components import components
from .licenses import lower_ascii

_HASHES: list[WordHashes] = []
DEPTHS = (4, 8, 12)
TAIL = 8  # values behind a region's prefix that its rows are sorted by


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    found = WORD.findall(lower_ascii(text)) if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(_HASHES[0].of(found), min(words, len(found))) + np.uint64(words - min(words, len(found))))


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def signature(s: np.ndarray, factors: np.ndarray, step: int = 4096) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), step):
        np.minimum(out, (factors[:, None] * s[None, k : k + step]).min(axis=1), out=out)
    return out


def trees_for(percent: int, depth: int, miss: float) -> int:
    """Orders that let a pair at the threshold share no region with probability ``miss``."""
    share = min(max(percent, 1), 99) / 100
    return min(65_535, max(1, math.ceil(math.log(miss) / math.log1p(-(share**depth)))))


def orders(trees: int, depth: int, pool: int, seed: int) -> np.ndarray:
    """For each order the places of its values in the signature.  The first ``depth`` are no
    other order's where the pool has that many values."""
    rng = np.random.default_rng(seed + depth)
    if trees * depth <= pool:
        own = np.arange(trees * depth).reshape(trees, depth)
        rest = [rng.permutation(np.setdiff1d(np.arange(pool), row))[:TAIL] for row in own]
        return np.concatenate([own, np.array(rest)], axis=1)
    return np.array([rng.permutation(pool)[: depth + TAIL] for _ in range(trees)])


def signed(docs: DataFrame, words: int, pool: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash, set_id (null for the empty set), n_shingles, sig (``pool`` 16-bit values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(pool, seed)
        for batch in batches:
            ids, sizes, sigs = [], [], []
            for value in batch.column(2):
                s = shingle_set(value.as_py(), words)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append((mix64(signature(s, factors)) >> np.uint64(48)).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["_id", "_hash", "set_id", "n_shingles", "sig"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "_id long, _hash long, set_id binary, n_shingles long, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"), F.col(f"`{text_col}`").alias("_text"))


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equal length."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def in_orders(sets: DataFrame, order: np.ndarray, depth: int) -> DataFrame:
    """key, set_id: a row for each set and order.  The key is the order's number, the region (a
    hash of the first ``depth`` values), and the values that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(part.num_rows, -1)
                keys = np.zeros((len(order), part.num_rows, 10 + 2 * TAIL), dtype=np.uint8)
                for t, places in enumerate(order):
                    region = np.full(part.num_rows, t + 1, dtype=np.uint64)
                    for p in places[:depth]:
                        region = mix64(region * np.uint64(0x9E3779B97F4A7C15) + sig[:, p])
                    keys[t, :, :2] = np.frombuffer(np.array([t], dtype=">u2").tobytes(), dtype=np.uint8)
                    keys[t, :, 2:10] = region.astype(">u8").view(np.uint8).reshape(-1, 8)
                    keys[t, :, 10:] = np.ascontiguousarray(sig[:, places[depth:]], dtype=">u2").view(np.uint8).reshape(-1, 2 * TAIL)
                again = pa.array(np.tile(np.arange(part.num_rows), len(order)))
                yield pa.RecordBatch.from_arrays([_fixed(keys.reshape(-1, 10 + 2 * TAIL)), part.column(0).take(again)], names=["key", "set_id"])

    return sets.select("set_id", "sig").mapInArrow(run, "key binary, set_id binary")


class Cutter:
    """Cuts one sorted partition into runs, with a few rows in hand whatever a region's size."""

    def __init__(self, run: int, lap: int, part: int, level: int):
        self.run, self.lap, self.part, self.level = run, lap, part, level
        self.border = max(lap, run // 2)  # rows that meet those of the partition beside
        self.region: bytes | None = None
        self.held: list[bytes] = []  # rows of the region, its last ``lap`` already in a run if ``number``
        self.number, self.first = 0, True
        self.out: list[tuple[int, bytes, int, int | None, bool]] = []

    def _emit(self, rows: list[bytes], name: str, known: bool, over: bool) -> None:
        unit = xxhash.xxh3_64_intdigest(f"{self.level}/{name}".encode()) - (1 << 63)
        tree = int.from_bytes(self.region[:2], "big")
        region = int.from_bytes(self.region[2:], "big", signed=True) if known else None
        self.out += [(unit, r, tree, region, over) for r in rows]

    def feed(self, region: bytes, ids: list[bytes]) -> None:
        if region != self.region:
            self.end(False)
            self.region, self.held, self.number = region, [], 0
        self.held += ids
        while len(self.held) > self.run + self.lap:
            self._emit(self.held[: self.run], f"{self.region.hex()}/{self.part}/{self.number}", True, True)
            if self.first and not self.number:
                self._emit(self.held[: self.border], f"border {self.part}", True, True)
            self.held = self.held[self.run - self.lap :]
            self.number += 1

    def end(self, last: bool = True) -> None:
        if self.region is None:
            return
        # A region may go on in the partition beside; the border holds all of it if either side is short.
        over = bool(self.number) or ((self.first or last) and len(self.held) > self.border)
        if len(self.held) > (self.lap if self.number else 1):
            self._emit(self.held, f"{self.region.hex()}/{self.part}/{self.number}", over, over)
        if self.first and not self.number:
            self._emit(self.held[: self.border], f"border {self.part}", True, over)
        if last:
            self._emit(self.held[-self.border :], f"border {self.part + 1}", True, over)
        self.first = False


def runs_of(tall: DataFrame, n: int, run: int, lap: int, level: int) -> DataFrame:
    """unit, set_id, tree, region (of regions that were cut or lie at a border, else null), over
    (whether a region was cut here)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(run, lap, TaskContext.get().partitionId(), level)

        def flush() -> pa.RecordBatch:
            units, ids, trees, regions, over = zip(*cutter.out, strict=True) if cutter.out else ((), (), (), (), ())
            cutter.out = []
            return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(ids, pa.binary()), pa.array(trees, pa.int32()), pa.array(regions, pa.int64()), pa.array(over, pa.bool_())], names=["unit", "set_id", "tree", "region", "over"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0), batch.column(1)
            flat = np.frombuffer(keys.buffers()[2], dtype=np.uint8)[keys.offset * (10 + 2 * TAIL) :][: len(keys) * (10 + 2 * TAIL)].reshape(len(keys), -1)[:, :10]
            starts = np.concatenate([[0], np.flatnonzero((flat[1:] != flat[:-1]).any(axis=1)) + 1, [len(keys)]])
            last = len(starts) - 2
            for k in np.flatnonzero((np.diff(starts) > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                cutter.feed(flat[starts[k]].tobytes(), ids.slice(starts[k], starts[k + 1] - starts[k]).to_pylist())
            yield flush()
        cutter.end()
        yield flush()

    return tall.repartitionByRange(n, "key", "set_id").sortWithinPartitions("key", "set_id").mapInArrow(cut, "unit long, set_id binary, tree int, region long, over boolean")


def tasks(rows: DataFrame, each: int = 20_000) -> int:
    """So many tasks that each gets about ``each`` of the (saved) rows, within what the session sets."""
    return max(1, min(shuffle_partitions(rows.sparkSession), 8 + rows.count() // each))


def _signed_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets.select(F.col("set_id").alias("_s"), "sig"), F.col("set_id") == F.col("_s")).drop("_s")


def alike(runs: DataFrame, sets: DataFrame, order: np.ndarray, depth: int, floor: float) -> DataFrame:
    """unit, set_id of the sets with a pair to be confirmed in the unit: signatures that agree in
    ``floor`` of the values, regions that agree in this order and in none before it."""
    prefix = order[:, :depth]

    def chosen(ids: list[bytes], sigs: list[bytes], trees: list[int]) -> list[bytes]:
        both = dict(zip(ids, zip(sigs, trees, strict=True), strict=True))  # a border may repeat rows
        if len(both) < 2:
            return []
        names = list(both)
        sig = np.frombuffer(b"".join(both[x][0] for x in names), dtype="<u2").reshape(len(names), -1)
        tree = np.array([both[x][1] for x in names])
        near = np.zeros((len(names), len(names)), dtype=bool)
        for i in range(len(names)):
            near[i, i + 1 :] = (sig[i] == sig[i + 1 :]).sum(axis=1) >= floor * sig.shape[1]
        near &= tree[:, None] == tree[None, :]
        if near.sum() <= 5000:  # pair by pair, as most runs are short
            i, j = np.nonzero(near)
            shared = (sig[i] == sig[j])[:, prefix[: int(tree.max()) + 1]].all(axis=2)
            first = shared.argmax(axis=1) == tree[i]
            return [names[x] for x in np.unique(np.concatenate([i[first], j[first]]))]
        for t in range(int(tree.max())):  # pairs that meet in an order before theirs
            _, key = np.unique(sig[:, prefix[t]], axis=0, return_inverse=True)
            near &= ~((key.ravel()[:, None] == key.ravel()[None, :]) & (tree > t)[:, None])
        return [names[x] for x in np.flatnonzero(near.any(axis=0) | near.any(axis=1))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows = None, ([], [], [])
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for u, set_id, tree, sig in batch.itertuples(index=False, name=None):
                if u != unit:
                    out += [(unit, x) for x in chosen(*rows)]
                    unit, rows = u, ([], [], [])
                for held, value in zip(rows, (bytes(set_id), bytes(sig), tree), strict=True):
                    held.append(value)
            yield pd.DataFrame(out, columns=["unit", "set_id"])
        yield pd.DataFrame([(unit, x) for x in chosen(*rows)], columns=["unit", "set_id"])

    rows = _signed_rows(runs.select("unit", "set_id", "tree"), sets).select("unit", "set_id", "tree", "sig")
    return rows.repartition(tasks(runs), "unit").sortWithinPartitions("unit").mapInPandas(run, "unit long, set_id binary")


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int, step: int = 2048) -> list[tuple[int, int]]:
    """Pairs (i, j) of full sets with 100 * intersection >= percent * union; with b None, pairs within
    a that join all that such pairs join.  Exact, by products of 0/1 matrices over shared shingles."""
    both = a if b is None else a + b
    n = np.array([len(s) for s in both], dtype=np.float64)
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), n.astype(np.int64))
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, at = owner[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(both), len(both)), dtype=np.float32)  # exact below 2^24 shingles a text
    for k in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(at, (k, k + step))
        m = np.zeros((len(both), min(step, int(shared.sum()) - k)), dtype=np.float32)
        m[owner[lo:hi], at[lo:hi] - k] = 1
        common += m @ m.T
    ok = np.empty(common.shape, dtype=bool)
    for k in range(0, len(both), 256):  # a few rows at a time, as they are wide
        part = common[k : k + 256].astype(np.float64)
        ok[k : k + 256] = 100 * part >= percent * (n[k : k + 256, None] + n[None, :] - part)
    if b is None:
        return _search(ok)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(ok[: len(a), len(a) :]), strict=True)]


def _search(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric matrix links."""
    new, out = np.ones(len(ok), dtype=bool), []
    for start in range(len(ok)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(ok[x] & new)
            new[found] = False
            out += [(x, int(y)) for y in found]
            todo += found.tolist()
    return out


class Forest:
    """Union-find over a block's positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def confirmed(spread: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """Links a, b of full sets: a spanning forest for each unit of ``spread`` (unit, i, j, block,
    set_id, _text), whose rows of block i meet those of block j, in ``n`` tasks."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(rows: list[tuple]) -> pd.DataFrame:
            rows = list({r[4]: r for r in rows}.values())  # repeated rows
            i, j = rows[0][1], rows[0][2]
            left = [r for r in rows if r[3] == i]
            right = [r for r in rows if r[3] == j] if i != j else None
            if not left or (right is not None and not right) or (right is None and len(left) < 2):
                return pd.DataFrame({"a": [], "b": []})
            a = [shingle_set(r[5], words) for r in left]
            b = [shingle_set(r[5], words) for r in right] if right is not None else None
            names = [r[4] for r in left] + [r[4] for r in right or ()]
            tree = Forest(len(names))
            shift = len(left) if right is not None else 0
            out = [(names[x], names[y + shift]) for x, y in linked(a, b, percent) if tree.join(x, y + shift)]
            return pd.DataFrame(out, columns=["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                row = (*row[:4], bytes(row[4]), row[5])
                if rows and rows[0][:3] != row[:3]:
                    yield pairs(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield pairs(rows)

    dealt = spread.select("unit", "i", "j", "block", "set_id", "_text").repartition(n, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return dealt.mapInPandas(confirm, "a binary, b binary")


def _texts_of(members: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """_s, _text of the sets of ``members``: the text of one document that has the set."""
    first = sets.select(F.col("set_id").alias("_s"), F.col("first._id").alias("_i"), F.col("first._hash").alias("_h"))
    named = members.select("set_id").distinct().join(first, F.col("set_id") == F.col("_s")).drop("set_id")
    found = docs.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_s", "_text")
    return saved(found.dropDuplicates(["_s"]))  # repeated rows


def _with_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    return members.join(texts, F.col("set_id") == F.col("_s")).drop("_s")


def _in_one(units: DataFrame) -> DataFrame:
    """Units (unit, set_id) that aren't cut into blocks."""
    return units.withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})


def _whole(rest: DataFrame, block: int) -> DataFrame:
    """unit, i, j, block, set_id: units that compare all pairs of ``rest`` (region, set_id), cut into
    blocks of about ``block`` sets each of which meets all others of the regions that hang together."""
    hubs = rest.groupBy("region").agg(F.min("set_id").alias("a"))
    clusters = components(rest.join(hubs, "region").select("a", F.col("set_id").alias("b")))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    member = clusters.join(sizes, "root").select(F.xxhash64("root").alias("unit"), F.col("node").alias("set_id"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return member.withColumn("_p", F.explode(places)).select("unit", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "block", "set_id")


def _unsettled(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """region, set_id of regions (region, set_id, over) that were cut and hold more than one component."""
    named = crowded.join(roots.withColumnRenamed("node", "_n"), F.col("set_id") == F.col("_n"), "left").select("region", "set_id", "over", F.coalesce("root", "set_id").alias("root"))
    split = named.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("over").alias("cut")).where("least <> most AND cut").select("region")
    return named.join(split, "region").select("region", "set_id").distinct()


def _linked_sets(docs: DataFrame, sets: DataFrame, percent: int, words: int, miss: float, pool: int, run: int, lap: int, block: int, seed: int, id_col: str, text_col: str, depths: tuple[int, ...]) -> DataFrame:
    """node, root: the components of all sets that are linked, level by level."""
    spark = docs.sparkSession
    texts, roots, left, rest = None, None, sets, None

    def joined(links: DataFrame) -> DataFrame:
        """Components, with ``links`` added to those there are."""
        more = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return saved(components(more))

    share = percent / 100
    floor = share - 5.5 * math.sqrt(share * (1 - share) / pool) - 1 / pool
    for level, depth in enumerate(depths):
        n_trees = trees_for(percent, depth, miss)
        order = orders(n_trees, depth, pool, seed)
        parts = max(1, min(shuffle_partitions(spark), left.count() * n_trees // 20_000))
        cut = saved(runs_of(in_orders(left, order, depth), parts, run, lap, level))
        crowded = cut.where(F.col("region").isNotNull()).select("region", "set_id", "over")
        units = saved(alike(cut, sets, order, depth, floor))
        if texts is None:  # whole texts are shuffled here, once
            texts = _texts_of(units.select("set_id").unionByName(crowded.select("set_id")), sets, _texts(docs, id_col, text_col))
        roots = joined(confirmed(_with_texts(_in_one(units), texts), words, percent, tasks(units, 2000)))
        if crowded.where("over").isEmpty():
            return roots
        rest = saved(_unsettled(crowded, roots))
        if rest.isEmpty():
            return roots
        left = sets.join(rest.select(F.col("set_id").alias("_s")).distinct(), F.col("set_id") == F.col("_s"), "left_semi")
    whole = saved(_whole(rest, block))
    return joined(confirmed(_with_texts(whole, texts), words, percent, tasks(whole, 2000)))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, miss: float = 1e-6, run: int = 2048, lap: int = 64, block: int = 100, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """For each row: the id, _hash (xxhash64 of the text), n_shingles, component_id (smallest
    id reachable by links, itself included) and kept (the row bears its component's name)."""
    spark = docs.sparkSession
    pool = max(96, trees_for(percent, depths[0], miss) * depths[0])
    facts = saved(signed(docs, words, pool, seed, id_col, text_col))
    sets = facts.where(F.col("set_id").isNotNull()).groupBy("set_id", "sig").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_hash")).alias("first"))
    sets = saved(sets)
    roots = _linked_sets(docs, sets, percent, words, miss, pool, run, lap, block, seed, id_col, text_col, depths)
    ids = sets.select(F.col("set_id"), F.col("first._id").alias("least"))
    named = roots.join(ids, F.col("node") == F.col("set_id")).select("root", "node", "least")
    names = named.groupBy("root").agg(F.min("least").alias("name")).select(F.col("root").alias("k"), "name")
    linked_sets = named.join(names, named["root"] == names["k"]).select(F.col("node").alias("_node"), "name")
    of_set = ids.join(linked_sets, F.col("set_id") == F.col("_node"), "left").select(F.col("set_id").alias("_s"), F.coalesce("name", "least").alias("_name"))
    rows = facts.select("_id", "_hash", "set_id", "n_shingles").join(saved(of_set), F.col("set_id") == F.col("_s"), "left")
    component = F.coalesce("_name", "_id")
    return rows.select(F.col("_id").alias(id_col), "_hash", "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.  Rows that
    agree in id and text are one document repeated, and all stay; so do documents without words."""
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = judged.where("kept").select(F.col(f"`{id_col}`").alias("_d_id"), F.col("_hash").alias("_d_hash")).distinct()
    rows = docs.withColumn("_d_own", F.xxhash64(F.col(f"`{text_col}`")))
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_d_id")) & (F.col("_d_own") == F.col("_d_hash"))
    return rows.join(kept, on, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
