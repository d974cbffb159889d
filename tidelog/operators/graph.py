"""Entities, their ranks and postings, co-occurrence, aliases, and page components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ENTITY_DOCS, STOP_WORDS
from ..session import exists, saved

# The formats of entities that aren't names, and words that name nothing.
KINDS = {
    "postcode": r"(?<![A-Za-z0-9])[A-Z]{1,2}\d[A-Z0-9]? ?\d[A-Z]{2}(?![A-Za-z0-9])",
    "date": r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)",
    "quantity": r"(?<![\p{L}\d])\d+(?:\.\d+)? ?(?:kg|km|cm|mm|GB|MB|TB|%)(?![\p{L}\d])",
}
LABELS = ("语音", "截图", "剪贴板", "剪贴板图片", "图片", "screenshot", "clipboard", "audio", "voice")
WORD = r"[\p{L}\p{N}]+"
#: Latin words that are names by how they are written: with a digit; all capitals; a capital inside of a
#: sentence, or before another capitalised word.  Three letters at least, or two with a digit or capitals.
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_INSIDE = r"(?<=[^\s.!?。！？:：\"“(（\[【][ \t]{0,2})"
PROPER = (
    rf"{_EDGE}(?:(?=\p{{N}}*[\p{{L}}&&[^\p{{IsHan}}]])(?=[\p{{L}}&&[^\p{{IsHan}}]]*\p{{N}})[\p{{L}}\p{{N}}&&[^\p{{IsHan}}]]{{2,}}|\p{{Lu}}{{3,}}"
    rf"|{_INSIDE}\p{{Lu}}[\p{{L}}&&[^\p{{IsHan}}]]{{2,}}|\p{{Lu}}[\p{{L}}&&[^\p{{IsHan}}]]{{2,}}(?=,?[ \t]+\p{{Lu}})){_END}"
)
HEADS = ("title", "window", "url")


def head(e: DataFrame) -> Column:
    """What a record is headed by: title, window and address, of the columns it has."""
    return F.concat_ws(" ", *[F.col(c) for c in HEADS if c in e.columns])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _named(words: Column) -> Column:
    """Those that can name something: two characters, a letter, no filling word or label."""
    return F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}") & ~w.isin(*STOP_WORDS, *LABELS))


def _full(e: DataFrame, text: str) -> Column:
    return F.concat_ws("\n", head(e), F.col(text))


def dictionary(e: DataFrame, text: str = "text", reach: int = 60) -> DataFrame:
    """word, titled, place: what the records themselves say of words.  Titled words stand in some record's head;
    places stand within ``reach`` characters of a postcode, to either side of it."""
    titled = e.select(F.explode(F.array_distinct(_named(_words(head(e))))).alias("word"), F.lit(True).alias("titled"), F.lit(False).alias("place"))
    # Between two postcodes lies one piece; what is near a postcode is an end of a piece beside it.
    pieces = e.select(F.explode(F.array(F.split(_full(e, text), KINDS["postcode"]))).alias("_p")).where(F.size("_p") > 1)
    ends = F.transform("_p", lambda p, i: F.concat(F.when(i > 0, F.left(p, F.lit(reach))).otherwise(F.lit("")), F.lit(" "), F.when(i < F.size("_p") - 1, F.right(p, F.lit(reach))).otherwise(F.lit(""))))
    near = pieces.select(F.explode(F.array_distinct(_named(_words(F.array_join(ends, " "))))).alias("word"), F.lit(False).alias("titled"), F.lit(True).alias("place"))
    return titled.unionByName(near).groupBy("word").agg(F.max("titled").alias("titled"), F.max("place").alias("place"))


def candidates(e: DataFrame, text: str = "text", han: Callable[[Column], Column] | None = None) -> Column:
    """array of (kind, key, gated) of one record: its postcodes, dates and quantities, and outside of these its
    proper Latin words and, where ``han`` cuts them, Han words; those of two characters that are not
    in the record's own head are gated: some record's head must have them."""
    full = _full(e, text)
    as_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("key"), F.lit(False).alias("gated"))
    known = [F.transform(F.regexp_extract_all(full, F.lit(p), F.lit(0)), as_kind(k)) for k, p in KINDS.items()]
    rest = F.regexp_replace(full, "|".join(KINDS.values()), " ")
    proper = F.transform(_named(F.transform(F.regexp_extract_all(rest, F.lit(PROPER), F.lit(0)), F.lower)), as_kind("name"))
    found = [*known, proper]
    if han is not None:
        words = F.filter(_named(han(rest)), lambda w: w.rlike(r"^\p{IsHan}+$"))
        found.append(F.transform(words, lambda w: F.struct(F.lit("name").alias("kind"), w.alias("key"), ((F.length(w) < 3) & ~F.contains(F.lower(head(e)), w)).alias("gated"))))
    return F.array_distinct(F.concat(*found))


def entity_rows(e: DataFrame, text: str = "text", han: Callable[[Column], Column] | None = None, words: DataFrame | None = None, in_tasks: int = 200_000) -> DataFrame:
    """id, kind, key, titled: the entities of each record, gated by what all records' heads and
    postcodes say (``dictionary``): the first pass gathers it, the second one uses it.  Names beside
    postcodes are places.  The dictionary goes to every task if it has at most ``in_tasks`` words
    (it is counted first), else both sides are dealt by the word."""
    words = saved(dictionary(e, text) if words is None else words)
    few = words.limit(in_tasks + 1).count() <= in_tasks
    told = words.select(F.col("word").alias("key"), "titled", "place")
    # Texts are dealt by the id, as a file may have few pieces, and searched once, however often the rows are read.
    dealt = e.repartition("id")
    found = saved(dealt.select("id", F.inline(candidates(dealt, text, han))))
    return _gated(found, F.broadcast(told) if few else told)


def _gated(rows: DataFrame, told: DataFrame) -> DataFrame:
    rows = rows.join(told, "key", "left")
    titled, place = F.coalesce("titled", F.lit(False)), F.coalesce("place", F.lit(False))
    kind = F.when((F.col("kind") == "name") & place, "place").otherwise(F.col("kind"))
    return rows.where(~F.col("gated") | titled).select("id", kind.alias("kind"), "key", titled.alias("titled")).distinct()


def entity_df(rows: DataFrame, low: int = ENTITY_DOCS[0], high: int = ENTITY_DOCS[1]) -> DataFrame:
    """kind, key, df of those found in ``low`` to ``high`` records."""
    return rows.groupBy("kind", "key").agg(F.countDistinct("id").alias("df")).where(F.col("df").between(low, high))


def entity_index(rows: DataFrame, per_record: int = 20, low: int = ENTITY_DOCS[0], high: int = ENTITY_DOCS[1]) -> DataFrame:
    """id, kind, key, df, rank: each record's ``per_record`` first (see ``settle``), less what is
    left in one record only."""
    kept = settle(rows.join(entity_df(rows, low, high), ["kind", "key"]), per_record)
    again = kept.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= low)
    return kept.join(again.select("kind", "key"), ["kind", "key"], "left_semi").select("id", "kind", "key", "df", "rank")


def settle(rows: DataFrame, per_record: int) -> DataFrame:
    """Ranks within each record: what a format or a postcode tells first, then words that some head has,
    then others; in each the rarer first."""
    tier = F.when(F.col("kind") != "name", 0).when(F.col("titled"), 1).otherwise(2)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(tier, "df", "key", "kind")) - 1)
    return ranked.where(F.col("rank") < per_record)


def fill(e: DataFrame, path: str, rules: int, most: int | None = None, text: str = "text", han: Callable[[Column], Column] | None = None) -> int:
    """One pass of extraction: the records (``most`` at most, oldest ids first) that have no row at
    ``path`` under this version of the rules get one (id, rules, found); how many were done.  The
    gates are applied when the rows are read (``filled``), so heads that come later count for earlier rows."""
    spark = e.sparkSession
    todo = e
    if exists(spark, path):
        todo = e.join(spark.read.parquet(path).where(F.col("rules") == rules).select("id"), "id", "left_anti")
    if most is not None:
        todo = todo.orderBy("id").limit(most)
    new = saved(todo.select("id", F.lit(rules).alias("rules"), candidates(todo, text, han).alias("found")))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def filled(spark: SparkSession, path: str, rules: int, words: DataFrame) -> DataFrame:
    """id, kind, key, titled of the extracted records, gated by ``words``, as ``entity_rows`` gives them."""
    rows = spark.read.parquet(path).where(F.col("rules") == rules).select("id", F.inline("found"))
    return _gated(rows, words.select(F.col("word").alias("key"), "titled", "place"))


def vocab_postings(index: DataFrame, cap: int = 200, keep: int = 20) -> DataFrame:
    """key -> the ids that rank it under ``keep``; of longer lists the ``cap`` least ids."""
    rows = index.where(F.col("rank") < keep)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_r") <= cap)
    return first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def cooccurring(rows: DataFrame, least: int = 2, share: float = 0.8, per_record: int = 200) -> DataFrame:
    """Pairs of keys in ``least`` records together, and in ``share`` of the rarer one's.
    ``rows`` (id, key) must hold at most ``per_record`` keys a record, as ranked indexes do."""
    one = rows.select("id", "key").distinct()
    df = one.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    lists = one.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") <= per_record)
    left = lists.select(F.posexplode("keys").alias("k", "a"), "keys")
    pairs = left.select("a", F.explode(F.slice("keys", F.col("k") + 2, F.size("keys"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rarer = pairs.join(df.select(F.col("key").alias("a"), F.col("df").alias("df_a")), "a").join(df.select(F.col("key").alias("b"), F.col("df").alias("df_b")), "b")
    return rarer.where(F.col("n") >= share * F.least("df_a", "df_b")).select("a", "b", "n")


def aliases(terms: DataFrame, long: int = 8, short: int = 4) -> DataFrame:
    """(whole, part): terms of ``long`` characters that contain one of ``short`` or more at a word
    boundary.  Whole terms are cut into their word runs, which join by equality."""
    whole = terms.where(F.length("key") >= long).select(F.col("key").alias("whole"), F.split("key", " ").alias("_w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(F.sequence(i, F.size("_w")), lambda j: F.array_join(F.slice("_w", i, j - i + 1), " "))))
    cut = whole.select("whole", F.explode(F.array_distinct(runs)).alias("part")).where((F.col("part") != F.col("whole")) & (F.length("part") >= short))
    return cut.join(terms.select(F.col("key").alias("part")), "part").select("whole", "part").distinct()


def _least_of(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(u, v): each node of the edges (a, b) with the least one it hangs together with, where that is another."""
    codes, nodes = pd.factorize(np.concatenate([a, b]), sort=True)  # codes are in the nodes' order
    x, y = np.split(codes, 2)
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, further := up[up]):
            up = further
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[up[moved]]})


def contracted(edges: DataFrame, chunk: int = 200_000) -> DataFrame:
    """``edges`` (u, v) as stars: of every ``chunk`` edges that lie together, each node with the least
    one it hangs together with.  A narrow pass that leaves components as they are and paths short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= chunk:
                yield _least_of(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("u", "v")))
                held, n = [], 0
        if n:
            yield _least_of(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("u", "v")))

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInPandas(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, heavy: int = 100_000) -> DataFrame:
    """``edges`` (a, b) of any ordered type -> (node, root): the least node of each component, for
    every node with an edge to another one.  Loops and nulls are ignored.

    Edges that lie together are contracted first, once as they come and once as a hash of the edge deals
    them, as neighbours in a file may have little in common; then large and small stars follow in turn.  Each
    half step is one aggregate and one join.  Nodes with more than ``heavy`` edges are at most one for so many
    edges, so these are broadcast and their edges stay where they lie; thus neither a node with very many edges
    nor a large component is ever gathered in one task.  The number of rounds grows with the logarithm of
    the longest path; each is written to the shared folder."""

    def star(rows: DataFrame, key: str, other: str) -> DataFrame:
        """``rows`` with m: the least of ``key`` and all its ``other``."""
        least = saved(rows.groupBy(key).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_k"), F.least(key, "m").alias("m"), "_n"))
        hubs, rest = least.where(F.col("_n") > heavy).drop("_n"), least.where(F.col("_n") <= heavy).drop("_n")
        same = F.col(key) == F.col("_k")
        lying = rows.join(F.broadcast(hubs), same)
        dealt = rows.join(F.broadcast(hubs.select("_k")), same, "left_anti").join(rest, same)
        return lying.unionByName(dealt).drop("_k")

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = saved(contracted(contracted(e).repartition("u", "v")).distinct())
    while True:
        # Stars already, if each node hangs on one root and no root hangs on another.
        heads = e.select(F.col("v").alias("u"), F.lit(1).alias("head")).distinct().unionByName(e.select("u", F.lit(0).alias("head")))
        bad = heads.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if bad.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = saved(star(both, "x", "y").where((F.col("y") > F.col("x")) & (F.col("y") != F.col("m"))).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        small = star(large, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        e = saved(small.select("p.*").where(F.col("u") != F.col("v")).distinct())


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label) after synchronous weighted-majority rounds over (a, b, weight).  A node votes
    for its own label as its heaviest edge does, so two sides never swap labels for ever; ties
    go to the least label, so a rerun agrees."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    own = both.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")
    both = both.where("a <> b").unionByName(own)
    labels = own.select(F.col("a").alias("node"), F.col("a").alias("label"))
    for k in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n"), "label").agg(F.sum("weight").alias("w"))
        labels = votes.groupBy("n").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select(F.col("n").alias("node"), F.col("best.label").alias("label"))
        if k % 4 == 3:
            labels = saved(labels)
    return labels
