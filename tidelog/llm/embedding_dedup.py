"""Embedding near-dedup by product quantisation: coarse inverted lists with residual codes.

1. Equal vectors are one node with a multiplicity, so copies are never compared.
2. A bounded sample (``sample`` nodes, those with the least digests) fits the coarse
   centroids and the codebooks of the residuals' subspaces; every node is then indexed:
   its list, its code in each subspace, and two bounds of its quantisation error.  Lists grow
   with the table, about ``per_list`` nodes each: where they outnumber the ``max_centroids``
   centroids that the sample can fit, each centroid's list is cut by a second codebook of
   residuals, which all centroids share, so a bounded sample gives as many lists as are needed.
3. Each node probes every list that a neighbour at the threshold could call its own, were
   it ``reach`` standard deviations of random noise away towards that list's centroid: that
   is, whose centroid c scores at most reach * |link| / sqrt(dimensions) * |c - best| under
   the best one, with |link| = sqrt(2 - 2 * threshold).  In a list, the asymmetric distance of a query to an entry is the centroid's part plus
   one table look-up for each subspace; an entry passes if its look-up sum reaches what the
   stored bounds prove to be the least for a link, so the codes lose nothing.
4. What passes is reranked by the exact cosine in double precision.

Work is dealt in units of (list, block of entries, block of queries), so a hot list or a
group of copies is split however large it is.  A unit returns one count for each vector
and a spanning forest of its links, never the pairs themselves.  A link that both ends
find is counted at each end once, as a unit knows from the probes whether the other end
finds it too.

A link is missed only if neither end probes the other's list, which takes more than
``reach`` standard deviations even for links at the threshold itself; sqrt(dimensions) would
exclude it.  The tests measure recall against brute force.  With ``per_list`` or fewer nodes there is
one list, and the search is exhaustive.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing (n_links 0, component_id their own id, kept true).  Vectors of different
lengths never link; each length has its own index.  A null id takes part, but names no
component while a member has an id; rows with the same id are vectors of their own; the
smallest id names a component.  Other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .minhash_dedup import Forest


def valid(vector):
    """Has finite components, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest component so that
    neither very large nor very small ones overflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[k : k + step] @ centres.T - half).argmax(axis=1) for k in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool = False) -> np.ndarray:
    """At most ``k`` centres; empty ones stay where they are."""
    order = np.random.default_rng(seed).permutation(len(x))
    centres = x[order[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        some = n > 0
        centres[some] = total[some] / n[some, None]
        if unit:
            centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centroids (unit length), a second codebook of their residuals (one zero row where
    there is none), and one codebook for each subspace.  List c * len(fine) + f is that of
    centroid c and residual f."""

    centroids: np.ndarray
    fine: np.ndarray
    cuts: tuple[tuple[int, int], ...]
    books: tuple[np.ndarray, ...]
    threshold: float
    reach: float

    @staticmethod
    def fit(sample: np.ndarray, lists: int, most: int, subspaces: int, codes: int, threshold: float, reach: float, seed: int) -> Index:
        x = units(sample)
        centroids = k_means(x, min(lists, most), 6, seed, unit=True)
        rest = x - centroids[(x @ centroids.T).argmax(axis=1)]
        fine = k_means(rest, -(-lists // most), 6, seed + 100) if lists > most else np.zeros((1, x.shape[1]))
        rest = rest - fine[_nearest(rest, fine)]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        cuts = tuple((int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True))
        books = tuple(k_means(rest[: 64 * codes, a:b], codes, 6, seed + 1 + k) for k, (a, b) in enumerate(cuts))
        return Index(centroids, fine, cuts, books, threshold, reach)

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.fine)

    def base(self, home: np.ndarray | int) -> np.ndarray:
        """What a list's codes are added to."""
        return self.centroids[home // len(self.fine)] + self.fine[home % len(self.fine)]

    def _places(self, x: np.ndarray, away: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's list, and the lists that a neighbour ``away`` from it could be in."""
        n_fine = len(self.fine)
        scores = x @ self.centroids.T
        best = scores.argmax(axis=1)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (self.centroids[best] @ self.centroids.T)))
        near = scores.max(axis=1, keepdims=True) - scores <= away * apart + 1e-9
        if n_fine == 1:
            return best, [np.flatnonzero(row).astype(np.int32) for row in near]
        home = best * n_fine + _nearest(x - self.centroids[best], self.fine)
        half = (self.fine * self.fine).sum(axis=1) / 2
        gaps = np.sqrt(np.maximum(0.0, 2 * half[:, None] + 2 * half[None, :] - 2 * self.fine @ self.fine.T))
        probes: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        for c in np.flatnonzero(near.any(axis=0)):
            rows = np.flatnonzero(near[:, c])
            fits = (x[rows] - self.centroids[c]) @ self.fine.T - half
            top = fits.argmax(axis=1)
            for k, row in zip(*np.nonzero(fits[np.arange(len(rows)), top][:, None] - fits <= away * gaps[top] + 1e-9), strict=True):
                probes[rows[k]].append(c * n_fine + row)
        return home, [np.array(p, dtype=np.int32) for p in probes]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """List, probes, codes, and the least look-up sum that a link can have."""
        link = np.sqrt(max(0.0, 2 - 2 * self.threshold))
        away = min(self.reach, np.sqrt(x.shape[1])) * link / np.sqrt(x.shape[1])
        home, probes = np.empty(len(x), np.int64), []
        for k in range(0, len(x), 1024):
            home[k : k + 1024], some = self._places(x[k : k + 1024], away)
            probes += some
        base = self.base(home)
        rest = x - base
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1)
        back = base + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        # For a link q: q.back >= threshold - |x - back|, and q.back >= x.back - |q - x| |back|.
        error = np.sqrt(((x - back) ** 2).sum(axis=1))
        least = np.maximum(self.threshold - error, (x * back).sum(axis=1) - link * np.sqrt((back * back).sum(axis=1))) - 1e-4
        return home, probes, codes.astype(np.uint8 if max(map(len, self.books)) <= 256 else np.uint16), least

    def candidates(self, q: np.ndarray, home: int, codes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) whose look-up sum reaches the entry's bound."""
        total = np.broadcast_to((q @ self.base(home))[:, None], (len(q), len(codes))).astype(np.float32)
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += (q[:, a:b] @ book.T).astype(np.float32)[:, codes[:, k]]
        return np.nonzero(total >= least[None, :])


def compare(index: Index, home: int, entries: pd.DataFrame, queries: pd.DataFrame, dim: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between a list's entries and queries: counts of the queries, of the entries, and
    a spanning forest of (query, entry)."""
    y = units(np.stack(entries["vector"]))
    x = units(np.stack(queries["vector"]))
    codes, least = np.stack(entries["codes"]), entries["least"].to_numpy()
    homes = queries["home"].to_numpy()
    lists = index.lists
    knows = np.unique(np.concatenate([k * lists + p.astype(np.int64) for k, p in enumerate(entries["probes"])]))
    of_query, of_entry = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    m_query, m_entry = queries["copies"].to_numpy(), entries["copies"].to_numpy()
    name_query, name_entry = queries["node"].to_numpy(), entries["node"].to_numpy()
    place = {n: k for k, n in enumerate(dict.fromkeys([*name_query, *name_entry]))}
    at_query, at_entry = np.array([place[n] for n in name_query]), np.array([place[n] for n in name_entry])
    tree, out = Forest(len(place)), []
    for k in range(0, len(x), step):
        i, j = index.candidates(x[k : k + step], home, codes, least)
        i = i + k
        far = at_query[i] != at_entry[j]
        i, j = i[far], j[far]
        for s in range(0, len(i), 1 << 18):
            a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            ok = np.einsum("ij,ij->i", x[a], y[b]) >= index.threshold
            a, b = a[ok], b[ok]
            np.add.at(of_query, a, m_entry[b])
            # The entry counts the link itself where it probes the query's list.
            alone = ~np.isin(b * lists + homes[a], knows)
            np.add.at(of_entry, b[alone], m_query[a[alone]])
            out += [(p, r) for p, r in zip(a.tolist(), b.tolist(), strict=True) if tree.join(at_query[p], at_entry[r])]
    return of_query, of_entry, out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _links(nodes: DataFrame, dim: int, n: int, threshold: float, per_list: int, max_centroids: int, subspaces: int, codes: int, reach: float, block: int, seed: int) -> DataFrame:
    """node, n_links, other: counts (other null) and forest edges (n_links null)."""
    lists = max(1, n // per_list)
    sample = max(64 * codes, 16 * min(lists, max_centroids))
    chosen = nodes.orderBy("node").limit(sample).select("vector").toPandas()["vector"]
    index = Index.fit(np.array(chosen.tolist(), dtype=np.float64), lists, max_centroids, subspaces, codes, threshold, reach, seed)
    shipped = nodes.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, probes, codes, least = shipped.value.assign(units(_vectors(batch.column(2), dim)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(home.astype(np.int32)), pa.array(probes, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(least)],
                names=["node", "copies", "vector", "home", "probes", "codes", "least"],
            )

    kind = nodes.schema["vector"].dataType.simpleString()
    placed = saved(nodes.select("node", "copies", "vector").mapInArrow(assign, f"node binary, copies long, vector {kind}, home int, probes array<int>, codes binary, least double"))
    # Two small tables, a row for each list.
    sizes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["p"]: r["n"] for r in placed.select(F.explode("probes").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    entry_blocks = {k: -(-v // block) for k, v in sizes.items()}
    query_blocks = {k: -(-asked.get(k, 0) // block) or 1 for k in sizes}
    width = codes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            home, probes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            hashes = [int.from_bytes(x[:6], "little") for x in names]
            part: list[tuple[int, int, int, bool]] = []
            row: list[int] = []
            for k, h in enumerate(home):
                for qb in range(query_blocks[h]):
                    part.append((h, hashes[k] % entry_blocks[h], qb, True))
                    row.append(k)
                for p in probes[k]:
                    if p in entry_blocks:
                        for eb in range(entry_blocks[p]):
                            part.append((p, eb, (hashes[k] >> 12) % query_blocks[p], False))
                            row.append(k)
            for s in range(0, len(part), 10_000):
                a, b, c, e = zip(*part[s : s + 10_000], strict=True)
                take = pa.array(row[s : s + 10_000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(e, pa.bool_()), *[batch.column(x).take(take) for x in range(7)]],
                    names=["list", "eb", "qb", "entry", "node", "copies", "vector", "home", "probes", "codes", "least"],
                )

    dealt = placed.mapInArrow(deal, f"list int, eb int, qb int, entry boolean, node binary, copies long, vector {kind}, home int, probes array<int>, codes binary, least double")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        entries, queries = rows[rows["entry"]].copy(), rows[~rows["entry"]]
        if not len(entries) or not len(queries):
            return pd.DataFrame({"node": [], "n_links": [], "other": []})
        entries["codes"] = [np.frombuffer(c, dtype=np.uint8 if width <= 256 else np.uint16) for c in entries["codes"]]
        of_query, of_entry, edges = compare(shipped.value, int(rows["list"].iloc[0]), entries, queries, dim)
        q, e = queries["node"].to_numpy(), entries["node"].to_numpy()
        counts = pd.DataFrame({"node": np.concatenate([q[of_query > 0], e[of_entry > 0]]), "n_links": np.concatenate([of_query[of_query > 0], of_entry[of_entry > 0]]), "other": None})
        found = pd.DataFrame({"node": [q[a] for a, _ in edges], "n_links": 0, "other": [e[b] for _, b in edges]})
        return pd.concat([counts, found]) if len(found) else counts

    return dealt.groupBy("list", "eb", "qb").applyInPandas(meet, "node binary, n_links long, other binary")


def near_duplicates(
    rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    per_list: int = 300, max_centroids: int = 4096, subspaces: int = 8, codes: int = 256, reach: float = 3.0, block: int = 1500, seed: int = 5,
) -> DataFrame:
    """For each vector: the id, n_links, component_id and kept.

    ``max_centroids`` and ``codes`` bound the sample that the index is fitted on:
    max(64 * codes, 16 * centroids) vectors, at most 65,536 by default."""
    key, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    base = rows.select(key.alias("_id"), vector.alias("vector"), valid(vector).alias("_ok"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = (column.flatten().to_numpy(zero_copy_only=False) + 0.0)  # -0.0 is 0.0
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            names = [xxhash.xxh3_128_digest(part.tobytes()) for part in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(names, pa.binary())], names=["_id", "vector", "node"])

    kind, vector_kind = rows.schema[id_col].dataType.simpleString(), rows.schema[vector_col].dataType.simpleString()
    good = saved(base.where("_ok").select("_id", "vector").mapInArrow(name, f"_id {kind}, vector {vector_kind}, node binary"))
    nodes = saved(good.groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least")))
    found = None
    for r in nodes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        part = _links(nodes.where(F.size("vector") == r["dim"]), r["dim"], r["n"], threshold, per_list, max_centroids, subspaces, codes, reach, block, seed)
        found = part if found is None else found.unionByName(part)
    alone = base.where(~F.col("_ok")).select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = saved(found)
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("n_links").alias("n"))
    roots = saved(components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))))
    named = roots.join(nodes.select(F.col("node").alias("_n"), "least"), F.col("node") == F.col("_n"))
    names = named.groupBy("root").agg(F.min("least").alias("name"))
    of_node = roots.join(names, "root").select(F.col("node").alias("_r"), "name")
    facts = nodes.select("node", "copies", "least").join(counts.withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left").join(of_node, F.col("node") == F.col("_r"), "left")
    facts = facts.select(F.col("node").alias("_f"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    out = good.select("_id", "node").join(saved(facts), F.col("node") == F.col("_f"))
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), "n_links", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")).unionByName(alone)
