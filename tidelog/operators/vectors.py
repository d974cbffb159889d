"""Vectors: exact top-k, centroids, signed-hyperplane buckets, neighbour edges, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CLUSTER_COSINE, LINK_COSINE, SEARCH_COSINE
from ..functions.text import text_of
from ..functions.titles import is_placeholder
from ..session import saved
from .graph import components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_k(rows: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector: str = "v", floor: float = SEARCH_COSINE) -> DataFrame:
    """One query's best ids by their best chunk: a scan and a top-k, nothing is sorted whole."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(cosine(F.col(vector), q), 6)
    best = rows.select(F.col(id_col).alias("id"), score.alias("score")).where(F.col("score") >= floor).groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.col("score").desc(), "id").limit(k)


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, centroid (unit length): sums per dimension, combined map-side."""
    dims = rows.select(key, F.posexplode(vector).alias("k", "x")).groupBy(key, "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    out = dims.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    return out.select(key, "n", unit(F.col("mean")).alias("centroid"))


def lsh_shape(n: int, cosine_floor: float = LINK_COSINE, miss: float = 0.1, per_bucket: int = 24, most: int = 64) -> tuple[int, int]:
    """(bits, tables) so that a pair at the floor shares a bucket with probability 1 - miss, at
    every n: where that takes over ``most`` tables, bits are fewer and buckets larger."""
    bits = min(20, max(3, round(math.log2(max(n, 1) / per_bucket)))) if n > 0 else 3
    p = 1 - math.acos(cosine_floor) / math.pi
    need = lambda k: max(4, math.ceil(math.log(miss) / math.log(1 - p**k)))
    while bits > 1 and need(bits) > most:
        bits -= 1
    return bits, need(bits)


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def buckets(rows: DataFrame, dim: int, bits: int, tables: int, id_col: str = "id", vector: str = "v", seed: int = 11) -> DataFrame:
    """id, t, b: the sign bits of each table's hyperplanes."""
    planes, weights = hyperplanes(dim, bits, tables, seed), 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def signs(vs: pd.Series) -> pd.Series:
        good = [k for k, v in enumerate(vs) if v is not None and len(v) == dim]
        out: list = [None] * len(vs)
        if good:
            x = np.stack([vs.iloc[k] for k in good])
            for k, keys in zip(good, ((x @ planes.T) > 0).reshape(len(x), tables, bits) @ weights, strict=True):
                out[k] = keys
        return pd.Series(out, index=vs.index, dtype=object)

    return rows.select(F.col(id_col).alias("id"), F.posexplode(signs(F.col(vector))).alias("t", "b"))


def pairs_above(rows: DataFrame, bucketed: DataFrame, floor: float = LINK_COSINE, hot: int = 2000) -> DataFrame:
    """(a, b, score), a < b: pairs that share a bucket and reach the floor exactly.  Buckets of
    over ``hot`` members are split by a second hash into cells, and each pair of cells meets in
    its own task, so no bucket is gathered whole."""
    sizes = bucketed.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "b", F.ceil(F.col("n") / hot).cast("int").alias("cells"))
    placed = bucketed.join(sizes, ["t", "b"]).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    left = placed.select("t", "b", F.col("id").alias("a"), "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    right = placed.select("t", "b", F.col("id").alias("z"), F.col("cell").alias("other"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    found = left.join(right, ["t", "b", "cell", "other"]).where(F.col("a") < F.col("z")).select("a", "z").distinct()
    v = rows.select("id", "v")
    joined = found.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("z"), F.col("v").alias("vz")), "z")
    return joined.select("a", F.col("z").alias("b"), F.round(cosine(F.col("va"), F.col("vz")), 6).alias("score")).where(F.col("score") >= floor)


def _unit_links(rows: pd.DataFrame, t: int, bits: int, tables: int, floor: float, step: int = 1024) -> pd.DataFrame:
    """Links of one bucket, or of two of its cells: (node, n, other), counts of the pairs that share
    no earlier table's bucket (other null), and edges that join what is linked (n null)."""
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    signs = np.unpackbits(np.stack([np.frombuffer(s, np.uint8) for s in rows["sig"]]), axis=1, count=tables * bits)
    earlier = signs.reshape(len(x), tables, bits)[:, :t] @ (1 << np.arange(bits))
    cell, copies, names = rows["cell"].to_numpy(), rows["copies"].to_numpy(), rows["node"].to_numpy()
    left = np.flatnonzero(cell == cell.min())
    right = np.flatnonzero(cell == cell.max())
    within = cell.min() == cell.max()
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for s in range(0, len(left), step):
        a = left[s : s + step]
        i, j = np.nonzero(x[a] @ x[right].T >= floor - 5e-7)  # as scores are rounded to 6 places
        i, j = a[i], right[j]
        if within:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 1 << 17):
            p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            new = ~(earlier[p] == earlier[q]).any(axis=1)
            p, q = p[new], q[new]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            while (apart := root[p] != root[q]).any():
                p, q = p[apart], q[apart]
                np.minimum.at(root, np.maximum(root[p], root[q]), np.minimum(root[p], root[q]))
                while (root != root[root]).any():
                    root = root[root]
    some, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
    return pd.DataFrame({"node": np.concatenate([names[some], names[tied]]), "n": pd.array([*n[some], *[None] * len(tied)], "Int64"), "other": np.concatenate([np.full(len(some), None, object), names[root[tied]].astype(object)])})


def link_components(rows: DataFrame, floor: float = LINK_COSINE, miss: float = 0.01, per_bucket: int = 2048, hot: int = 4000, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id) of each row (id, v), ids being unique: links are pairs that reach
    the floor, of any dimension; a component is named by its least id.  Equal vectors are one
    node, and pairs are counted inside of tasks, never emitted.  A link at the floor is missed
    with probability ``miss`` at most, a closer one more seldom.  Vectors without a direction
    (null, empty, all zero, or with a part that is null or not finite) have no links."""
    v = F.col("v")
    ok = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) & F.exists(v, lambda x: x != 0), F.lit(False))
    nodes = rows.where(ok).groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    kind, parts = rows.schema["id"].dataType.simpleString(), []
    for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each dimension
        bits, tables = lsh_shape(r["n"], floor, miss, per_bucket)
        parts.append(_links(nodes.where(F.size("v") == r["dim"]), r["dim"], bits, tables, floor, hot, seed, kind))
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not parts:
        return alone
    found = reduce(DataFrame.unionByName, parts)
    found = saved(found)
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = nodes.join(counts, "node", "left").join(roots, "node", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    return rows.where(ok).select("id", "v").join(facts, "v").select("id", "n_links", "component_id").unionByName(alone)


def _links(nodes: DataFrame, dim: int, bits: int, tables: int, floor: float, hot: int, seed: int, kind: str) -> DataFrame:
    planes, weights = hyperplanes(dim, bits, tables, seed), 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("b array<int>, sig binary")
    def signs(vs: pd.Series) -> pd.DataFrame:
        x = np.stack(vs.to_numpy()).astype(np.float64) if len(vs) else np.zeros((0, dim))
        over = ((x / np.abs(x).max(axis=1, keepdims=True)) @ planes.T) > 0
        return pd.DataFrame({"b": list((over.reshape(len(x), tables, bits) @ weights).astype(np.int32)), "sig": [s.tobytes() for s in np.packbits(over, axis=1)]})

    signed = nodes.withColumn("s", signs("v"))
    # A row for each ``hot`` rows of the buckets at most; broadcast only if they are few.
    large = saved(signed.select(F.posexplode("s.b").alias("t", "b")).groupBy("t", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("t", "b", F.ceil(F.col("n") / hot).cast("int").alias("cells")))
    few = large.limit(100_001).count() <= 100_000
    placed = signed.select("node", "copies", "v", "s.sig", F.posexplode("s.b").alias("t", "b")).join(F.broadcast(large) if few else large, ["t", "b"], "left")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("node"), F.coalesce("cells", F.lit(1))).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)))
    units = placed.select("t", "b", F.least("cell", "o").alias("c1"), F.greatest("cell", "o").alias("c2"), "cell", "node", "copies", "v", "sig")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["c1"].iloc[0] != rows["c2"].iloc[0] and rows["cell"].nunique() == 1:
            return pd.DataFrame({"node": [], "n": [], "other": []})  # the other cell is empty
        return _unit_links(rows, int(rows["t"].iloc[0]), bits, tables, floor)

    return units.groupBy("t", "b", "c1", "c2").applyInPandas(meet, f"node {kind}, n long, other {kind}")


def neighbourhood(edges: DataFrame, start: Sequence, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` of the starting ids, with their distance; one join a hop."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], f"id {dict(edges.dtypes)['a']}, hop int")
    for hop in range(1, hops + 1):
        new = seen.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(new).groupBy("id").agg(F.min("hop").alias("hop"))
    return seen


def leader_clusters(rows: DataFrame, key: str, order: str, vector: str = "v", id_col: str = "id", floor: float = CLUSTER_COSINE, most: int = 4096) -> DataFrame:
    """Single-pass leader clustering within each key, in order: a vector joins the nearest
    leader (the last one on ties) at ``floor`` or more, else leads.  Sequential by definition,
    so each key's rows go in blocks of ``most``, one round a block for all keys together: a block meets the
    leaders of every earlier block in a task of its own, and what is left is settled in order within
    the block.  No task holds more than two blocks of vectors, however many leaders a key has; the
    products grow with the square of the longest key, as they must where most rows lead."""
    narrow = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(order).alias("_o")).where(F.col("v").isNotNull())
    kinds = dict(narrow.dtypes)
    place = F.row_number().over(Window.partitionBy("key").orderBy("_o", "id")) - 1
    placed = saved(narrow.select("key", "id", "v", place.alias("place")).withColumn("block", F.floor(F.col("place") / most).cast("int")))
    last = placed.agg(F.max("block")).head()[0] or 0

    def unit(vs: pd.Series) -> np.ndarray:
        x = np.stack(vs.to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1.0)

    def nearest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"key": [], "place": [], "score": [], "at": [], "leader": []})
        theirs = theirs.sort_values("at", ascending=False)  # the last one is found first
        x, names, at = unit(theirs["v"]), theirs["leader"].to_numpy(), theirs["at"].to_numpy()
        scores, best = [], []
        for s in range(0, len(mine), 512):
            dots = unit(mine["v"].iloc[s : s + 512]) @ x.T
            best.append(dots.argmax(axis=1))
            scores.append(dots.max(axis=1))
        k = np.concatenate(best)
        return pd.DataFrame({"key": mine["key"].to_numpy(), "place": mine["place"].to_numpy(), "score": np.concatenate(scores), "at": at[k], "leader": names[k]})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, x, names = object(), np.zeros((0, 0)), []
        for batch in batches:
            out, leads = [], []
            for k, v, near, far in zip(batch["key"], unit(batch["v"]) if len(batch) else (), batch["score"], batch["leader"], strict=True):
                if k != now:
                    now, x, names = k, np.zeros((16, len(v))), []
                i = batch["id"].iloc[len(out)]
                scores = x[: len(names)] @ v
                best = len(scores) - 1 - int(np.argmax(scores[::-1])) if len(scores) else -1
                if best >= 0 and scores[best] >= floor and not scores[best] < near:
                    out.append(names[best])
                elif near >= floor:
                    out.append(far)
                else:
                    if len(names) == len(x):
                        x = np.vstack([x, np.zeros_like(x)])
                    x[len(names)] = v
                    names.append(i)
                    out.append(i)
                leads.append(len(names) > len(scores))
            yield batch[["key", "id", "v", "place"]].assign(leader=pd.Series(out, index=batch.index, dtype=batch["id"].dtype), leads=leads)

    done: list[DataFrame] = []
    for b in range(last + 1):
        mine = placed.where(F.col("block") == b).select("key", "id", "v", "place")
        if done:
            led = reduce(DataFrame.unionByName, done).where("leads").select("key", "of", F.col("place").alias("at"), "leader", "v")
            units = mine.join(led.select(F.col("key").alias("_k"), F.col("of").alias("of")).distinct(), F.col("key") == F.col("_k"))
            met = units.select("key", "of", "place", "v").groupBy("key", "of").cogroup(led.groupBy("key", "of")).applyInPandas(lambda a, z: nearest(a, z), f"key {kinds['key']}, place int, score double, at int, leader {kinds['id']}")
            best = met.groupBy("key", "place").agg(F.max(F.struct("score", "at", "leader")).alias("_b")).select("key", "place", "_b.score", "_b.leader")
            mine = mine.join(best, ["key", "place"], "left")
        else:
            mine = mine.withColumns({"score": F.lit(None).cast("double"), "leader": F.lit(None).cast(kinds["id"])})
        dealt = mine.repartition("key").sortWithinPartitions("key", "place")
        settled = dealt.mapInPandas(settle, f"key {kinds['key']}, id {kinds['id']}, v {kinds['v']}, place int, leader {kinds['id']}, leads boolean")
        done.append(saved(settled.withColumn("of", F.lit(b))))
    return reduce(DataFrame.unionByName, done).select("key", "id", "leader")


def name_clusters(members: DataFrame, rows: DataFrame, least: int = 3, share: float = 0.3, words: int = 3) -> DataFrame:
    """leader, n, named_by, title, words, name of the clusters (id, leader) of ``least`` members.  ``rows``
    have id, v, title.  The name is the title of the member nearest the centroid whose title says something
    (ties to the least id), and where no member has one, the cluster's own words: those that stand in the titles of two
    members and of ``share`` of them, by their share over the logarithm of their frequency in all titles."""
    big = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    m = members.join(big, "leader").join(rows.select("id", "v", "title"), "id")
    centre = centroids(m, "leader", "v").drop("n")
    says = ~is_placeholder(F.col("title"))
    near = m.join(centre, "leader").withColumn("_s", F.round(cosine(F.col("v"), F.col("centroid")), 9))
    best = near.groupBy("leader").agg(
        F.max("n").alias("n"), F.min(F.struct((-F.col("_s")).alias("s"), "id"))["id"].alias("named_by"),
        F.min(F.when(says, F.struct((-F.col("_s")).alias("s"), "id", F.substring(F.trim("title"), 1, 40).alias("title"))))["title"].alias("title"),
    )
    told = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text_of(t)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.rlike(r"^[\dv]+$")))
    # One shuffle by the word: in all titles, and in each cluster's.
    flat = rows.select("id", F.explode(told(F.col("title"))).alias("word")).join(members.select("id", "leader"), "id", "left")
    counts = flat.groupBy("word", "leader").agg(F.count(F.lit(1)).alias("in"))
    df = F.sum("in").over(Window.partitionBy("word"))
    rare = counts.withColumn("df", df).where("leader IS NOT NULL").join(big, "leader")
    rare = rare.where(F.col("in") >= F.greatest(F.lit(2.0), share * F.col("n"))).withColumn("_w", F.round(F.col("in") / F.col("n") / F.log(1 + F.col("df")), 9))
    own = rare.groupBy("leader").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_w")).alias("w"), "word"))), 1, words), lambda x: x["word"]), " · ").alias("words"))
    out = best.join(own, "leader", "left").withColumns({"title": text_of(F.col("title")), "words": text_of(F.col("words"))})
    return out.select("leader", "n", "named_by", "title", "words", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("words")).alias("name"))


def exact_edges(rows: DataFrame, floor: float, k: int, id_col: str, vector: str) -> DataFrame:
    """Each node's ``k`` best neighbours by bucketed search, as edges (a, b, score)."""
    n = rows.count()
    dim = rows.select(F.max(F.size(vector)).alias("d")).first()["d"] or 1
    bits, tables = lsh_shape(n, floor)
    v = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    pairs = pairs_above(v, buckets(v, dim, bits, tables), floor)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b")))
    return best.where(F.col("r") <= k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
