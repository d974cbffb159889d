"""Ranked lexical search by Fagin's threshold algorithm.

Scores are sums of a term's parts: part(term, document) = w * ((10^9 * tf) div (1000 * tf + 20 * m)) in
64-bit integers, where w falls with the term's document frequency and m is the document's length as
a share of the mean (see ``parts``).

1. Items (queries) are taken in blocks of at most ``block_terms`` of their terms, so what goes to the
   executors is bounded, whatever the number of items; every block meets all documents.
2. One narrow pass cuts the whole texts and writes the forward index of the block's terms: for
   each document its terms with their counts.  Document frequencies and the mean length come
   from it; both are sums.
3. Each task reads its documents in portions of bounded size and sorts each term's list by
   impact (part).  For an item its lists are read in turn, best impacts first; each document met
   for the first time gets its whole score by random access to the forward index.  When the sum
   of the last impacts read falls strictly below the k-th score, no other document can reach
   it, nor tie with it, and the item is done.  The k-th score is carried from one portion to the next.
4. Each task's best k of an item meet in one window per item, which keeps at most k a task.

Lists are read in rounds of growing length, so a round is a few numpy operations; a list read
further than needed costs time, never a result.

Defined results: null and word-free texts hold no terms and are not counted in N; items without
terms, or whose terms no document holds, have no rows.  Rows of one item_id are one item with all their
terms; a null item_id is an id like others.  Equal scores stand by ascending doc_id, a null id last; repeated
documents are ranked each.  doc_ids are read as long integers.  Other columns aren't read.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .licenses import lower_ascii

#: ASCII letters and digits, and everything beyond ASCII; cut before A-Z are lower-cased.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = regex.compile(TERM_PATTERN)
NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_item, term: each term of an item once."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), upper, lower), F.lit(TERM_PATTERN), F.lit(0)))
    return items.select(F.col(f"`{id_col}`").alias("_item"), F.explode(words).alias("term")).distinct()


def blocks(terms: DataFrame, most: int) -> Iterator[dict]:
    """item -> its terms, for consecutive items with at most ``most`` terms (or one item)."""
    block: dict = {}
    held, last = 0, object()
    own: list[str] = []
    for row in terms.sort("_item", "term").toLocalIterator():
        if row["_item"] != last:
            if own:
                if block and held + len(own) > most:
                    yield block
                    block, held = {}, 0
                block[last] = own
                held += len(own)
            last, own = row["_item"], []
        own.append(row["term"])
    if own:
        if block and held + len(own) > most:
            yield block
            block = {}
        block[last] = own
    if block:
        yield block


def forward_index(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """_id, n (all terms of the text), terms, counts (those of the vocabulary, by number)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                n, terms, counts = [], [], []
                for value in batch.column(1):
                    text = value.as_py()
                    found = TERM.findall(lower_ascii(text)) if text else []
                    mine = {known[t]: c for t, c in Counter(found).items() if t in known}
                    n.append(len(found))
                    terms.append(list(mine))
                    counts.append(list(mine.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, "_id long, n long, terms array<int>, counts array<int>")


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def parts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What each (term, document) adds to a score."""
    m = 50 + (50 * n * n_docs) // max(all_terms, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The best ``k`` documents of an item so far: by score, then by id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def floor(self) -> int | None:
        """The k-th score, once there is one."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores > 0 if self.floor is None else scores >= max(self.floor, 1)
        if use.any():
            scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class Portion:
    """Some documents: their forward index, and each term's list sorted by impact."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        self.ids, self.sizes, self.terms, self.impacts = ids, sizes, terms, impacts
        self.starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = owner[order], impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.met = np.zeros(len(ids), dtype=bool)
        self.read = 0  # entries read from lists, for tests

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents for the asked terms (a mask over all)."""
        sizes = self.sizes[docs]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[docs] - first, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(np.where(asked[self.terms[at]], self.impacts[at], 0), first)

    def search(self, item: np.ndarray, asked: np.ndarray, best: Best, step: int) -> None:
        """Adds to ``best`` whatever of this portion belongs there."""
        place, end = self.bounds[item], self.bounds[item + 1]
        place, end = place[place < end], end[place < end]
        touched: list[np.ndarray] = []
        while len(place):
            upto = np.minimum(place + step, end)
            length = upto - place
            shift = np.repeat(place - (np.cumsum(length) - length), length)
            docs = np.unique(self.list_docs[shift + np.arange(int(length.sum()))])
            docs = docs[~self.met[docs]]
            self.read += int(length.sum())
            if len(docs):
                self.met[docs] = True
                touched.append(docs)
                best.add(self.scores(docs, asked), self.ids[docs])
            threshold = int(self.list_impacts[upto[upto < end] - 1].sum())
            if threshold == 0 or (best.floor is not None and threshold < best.floor):
                break
            place, end = upto[upto < end], end[upto < end]
            step *= 2
        for docs in touched:
            self.met[docs] = False


def best_of_tasks(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, all_terms: int, k: int, portion: int, step: int) -> DataFrame:
    """_number (of the item), _id, score: the best k of each task."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best = [Best(k) for _ in items]
        asked = np.zeros(len(weights), dtype=bool)
        held: list[tuple[np.ndarray, ...]] = []

        def searched() -> None:
            ids, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            impacts = parts(weights[terms], counts.astype(np.int64), np.repeat(n, sizes), n_docs, all_terms)
            here = Portion(ids, sizes, terms, impacts, len(weights))
            for terms_of_item, found in zip(items, best, strict=True):
                asked[terms_of_item] = True
                here.search(terms_of_item, asked, found, step)
                asked[terms_of_item] = False
            held.clear()

        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            ids = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), NO_ID, batch.column(0).fill_null(0).to_numpy())
            held.append((ids, batch.column(1).to_numpy(), sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy()))
            if sum(len(x[3]) for x in held) >= portion:
                searched()
        if held and sum(len(x[3]) for x in held):
            searched()
        for number, found in enumerate(best):
            if len(found.ids):
                ids = pa.array(found.ids, pa.int64(), mask=found.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number), pa.int32()), ids, pa.array(found.scores, pa.int64())], names=["_number", "_id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(run, "_number int, _id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 50_000, portion: int = 1_000_000, step: int = 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's ``k`` best documents."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"_item {kind}, rank int, _id long, score long")
    for block in blocks(item_terms(items, item_col, item_text), block_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for own in block.values() for t in own}))}
        index = saved(forward_index(docs, vocabulary, id_col, text_col))
        # One row, and one for each of the block's terms.
        sums = index.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[row["term"]] = row["count"]
        numbers = [np.array([vocabulary[t] for t in own]) for own in block.values()]
        found = best_of_tasks(index, numbers, term_weights(df, sums["docs"]), sums["docs"], sums["terms"], k, portion, step)
        order = Window.partitionBy("_number").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(block)), f"_n int, _item {kind}"))
        out = out.unionByName(top.join(names, F.col("_number") == F.col("_n")).select("_item", "rank", "_id", "score"))
    return out.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
