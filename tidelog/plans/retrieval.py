"""Retrieval: lexical tiers, the blended record search, vector neighbours, questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import KEEP
from ..functions.text import snippet
from ..operators import hygiene, pages, search, vectors
from ..operators.filters import Filter, clamp, matching
from . import index_store
from .dates import parse_range


class Index:
    """Postings over entries, with a table of the indexed records.  ``save`` writes them as the tables of
    ``index_store``, which can be dropped and rebuilt at any time; ``load`` opens them, and ``current`` opens
    them anew where a step has finished since."""

    def __init__(self, e: DataFrame, post: DataFrame | None = None, lengths: DataFrame | None = None, store: index_store.Store | None = None):
        self.e, self.store = e, store
        self.cutter = store.cutter if store is not None else None
        self.post = search.postings(e) if post is None else post
        self.lengths = search.document_lengths(e) if lengths is None else lengths
        self._total: int | None = None

    def save(self, path: str, cells: int | None = None, words: DataFrame | None = None) -> Index:
        return Index._of(self.e, index_store.build(self.e, path, cells, words=words))

    @staticmethod
    def load(e: DataFrame, path: str) -> Index:
        return Index._of(e, index_store.open_store(e.sparkSession, path))

    @staticmethod
    def _of(e: DataFrame, store: index_store.Store) -> Index:
        return Index(e, store.postings, store.records.drop("cell"), store)

    def current(self) -> Index:
        return self if self.store is None or self.store.newest() else Index.load(self.e, self.store.path)

    def refreshed(self, e: DataFrame, changed: DataFrame) -> Index:
        """The index of ``e``, of which only the records with the ids of ``changed`` are new, changed
        or gone: their postings are replaced and no other record is read.  Nothing is written; a saved
        index is kept by ``index_store.follow``."""
        ids = changed.select("id").distinct()
        now = e.join(ids, "id", "left_semi")
        new = search.postings(now)
        post = self.post.join(ids, "id", "left_anti").select(*new.columns).unionByName(new)
        lengths = search.document_lengths(now)
        return Index(e, post, self.lengths.join(ids, "id", "left_anti").unionByName(lengths.select(*self.lengths.columns)))

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.lengths.count() if self.store is None else self.store.totals()[0]
        return self._total

    def term_df(self) -> DataFrame:
        """term, df of the whole vocabulary."""
        return search.term_df(self.post) if self.store is None else self.store.df()

    def df(self, terms: Sequence[str]) -> dict[str, int]:
        """Document frequencies of a query's own terms."""
        found = search.term_df(search.matched(self.post, terms)) if self.store is None else self.store.df(terms)
        return {r["term"]: r["df"] for r in found.collect()}

    def phrases(self, phrases: Sequence[Sequence[str]]) -> DataFrame:
        """Ids that hold each phrase, its terms side by side."""
        single = [p[0] for p in phrases if len(p) == 1]
        found = [search.all_terms(self.post, single)] if single else []
        found += [search.phrase(self.post, p).select("id") for p in phrases if len(p) > 1]
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), found)

    def scored(self, ids: DataFrame, terms: Sequence[str], tier: int, n: int) -> DataFrame:
        hits = search.matched(self.post, terms).join(ids, "id", "left_semi")
        hit = search.bm25(hits, self.lengths, terms)
        return search.ranked(hit, "all", F.col("score").desc(), F.col("id").desc(), n=n).select("id", F.lit(tier).alias("tier"), "rank")

    def search(self, q: str, n: int = KEEP * 4) -> DataFrame:
        """id, tier, rank.  Tier 1: all phrases, their terms side by side; 2: all terms of keywords,
        wherever they stand; 3: rare terms together, which also fill up the answer to a sentence;
        4: prefixes.  The first tier that finds anything answers, and nothing found is an
        empty answer."""
        cut = self.cutter.phrases if self.cutter else None
        phrases = search.query_phrases(q, cut=cut)
        if not phrases:
            newest = (F.col("created_at").desc(), F.col("id").desc())
            return search.ranked(self.lengths, "newest", *newest, n=n).select("id", F.lit(0).alias("tier"), "rank")
        terms = search.query_terms(q, cut=cut)
        df = self.df(list(dict.fromkeys([*terms, *(t for p in phrases for t in p)])))
        least = {p: min(df.get(t, 0) for t in p) for p in phrases}  # a phrase is no more frequent than its rarest term
        use = [p for p in phrases if least[p] <= search.COMMON_SHARE * self.total] or phrases
        rare = list(dict.fromkeys(min(p, key=lambda t: (df.get(t, 0), t)) for p in phrases if 0 < least[p] <= search.RARE_SHARE * self.total))
        loose = list(dict.fromkeys(t for p in use for t in p if len(t) > 1))
        tiers: list[DataFrame] = []
        is_sentence = search.sentence(phrases)
        if all(least[p] for p in use):
            first = self.scored(self.phrases(use), [t for p in use for t in p], 1, n)
            if is_sentence:
                tiers.append(first)
            elif not first.isEmpty():
                return first
        if not is_sentence and loose and len(loose) != len(use) and all(df.get(t) for t in loose):
            second = self.scored(search.all_terms(self.post, loose), loose, 2, n)
            if not second.isEmpty():
                return second
        if len(rare) >= 2:
            co = search.rare_cohits(self.post, self.lengths, rare, n)
            order = (F.col("n_terms").desc(), F.col("rarest"), F.col("created_at").desc(), F.col("id").desc())
            tiers.append(search.ranked(co, "rare", *order, n=n).select("id", F.lit(3).alias("tier"), "rank"))
        if tiers:
            out = tiers[0] if len(tiers) == 1 else tiers[0].unionByName(tiers[1])
            best = out.groupBy("id").agg(F.min(F.struct("tier", "rank")).alias("b")).select("id", "b.tier", "b.rank")
            if not best.isEmpty():
                return best
        known, unknown = [t for t in loose if df.get(t)], [t for t in loose if not df.get(t)]
        if not unknown:
            return self.lengths.select("id", F.lit(4).alias("tier"), F.lit(0).alias("rank")).where(F.lit(False))
        ids = search.by_prefix(self.post, known, unknown)
        return search.ranked(ids.join(self.lengths, "id"), "prefix", F.col("created_at").desc(), F.col("id").desc(), n=n).select("id", F.lit(4).alias("tier"), "rank")

    def rare_terms(self, q: str) -> list[str]:
        """The rarest term of each of a query's phrases that few records hold."""
        phrases = search.query_phrases(q, cut=self.cutter.phrases if self.cutter else None)
        df = self.df(list(dict.fromkeys(t for p in phrases for t in p)))
        first = [min(p, key=lambda t: (df.get(t, 0), t)) for p in phrases]
        return list(dict.fromkeys(t for t in first if 0 < df.get(t, 0) <= search.RARE_SHARE * self.total))

    def select(self, q: str, today: date, keep: int = KEEP) -> DataFrame:
        """A question's range is read off it first; the rest is searched inside the range, and
        where that finds nothing the range itself is the answer."""
        found = parse_range(q, today)
        if not found:
            return self.search(q, keep)
        inside = self.e.where(F.col("date_key").between(found.first.isoformat(), found.last.isoformat()))
        part = Index(inside, self.post.join(inside.select("id"), "id", "left_semi"), self.lengths.join(inside.select("id"), "id", "left_semi"))
        part.cutter = self.cutter
        hits = part.search(found.rest(q), keep)
        return hits if not hits.isEmpty() else part.search("", keep)


def search_entries(e: DataFrame, q: str, f: Filter | None = None, limit: int = 20) -> DataFrame:
    """The records that answer ``q``: exact hits (all terms contained), hits by the shape asked
    for, and scored hits, blended under quotas; with place, title and excerpt."""
    limit = clamp(limit)
    pool = matching(e, f) if f else e
    pool = pool.where(~F.coalesce(F.col("status") == "error", F.lit(False)))
    terms = search.query_terms(q)
    newest = (F.col("created_at").desc(), F.col("id").desc())
    if not terms:
        top = pool.orderBy(*newest).limit(limit)
        legs = search.ranked(top, "found", *newest, n=limit)
    else:
        exact = search.ranked(search.substring_hits(pool, terms), "found", *newest, n=limit)
        scored = search.ranked(search.scan_words(pool, terms), "scan", F.col("score").desc(), "id", n=limit)
        legs = exact.unionByName(scored)
        if shape := search.shape_of(q):
            legs = legs.unionByName(search.ranked(search.shape_scan(pool, shape, terms), "shape", F.col("score").desc(), "id", n=limit))
    places = search.blend(legs, keep=limit)  # at most ``limit`` rows
    needle = terms[0] if terms else ""
    return pool.join(F.broadcast(places), "id").select("place", "id", "title", snippet(F.col("text"), needle).alias("excerpt")).orderBy("place")


def near(e: DataFrame, chunks: DataFrame, query: Sequence[float], exclude: Sequence[int] = (), k: int = 12, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
    """Records by their best chunk's cosine, inside both bounds of the range."""
    inside = e
    if day_from:
        inside = inside.where(F.col("date_key") >= day_from)
    if day_to:
        inside = inside.where(F.col("date_key") <= day_to)
    if exclude:
        inside = inside.where(~F.col("id").isin(*exclude))
    return vectors.top_k(chunks.join(inside.select("id"), "id", "left_semi"), query, k)


def feedback_terms(post: DataFrame, seeds: DataFrame, total: int, n_seeds: int = 5, least: int = 2, share: float = 0.05, most: int = 3) -> DataFrame:
    """Terms that ``least`` of the first seeds share, in under ``share`` of all records."""
    first = seeds.orderBy("rank", "id").limit(n_seeds)
    votes = post.join(first.select("id"), "id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    df = search.term_df(post.join(votes.select("term"), "term", "left_semi"))
    return votes.join(df, "term").where(F.col("df") <= share * total).orderBy(F.col("n").desc(), "df", "term").limit(most)


def ask(index: Index, questions: Sequence[str], today: date, planner: Callable[[str], Sequence[str]] | None = None, carried: Sequence[int] = (), keep: int = KEEP) -> DataFrame:
    """A question with its planned companions (a planner may add some; at most 16): one list
    each, taken in turn, with what earlier turns used in a lane of its own (at most 4)."""
    asked = list(dict.fromkeys([*questions, *(planner(questions[0]) if planner else ())]))[:16]
    legs = [index.select(q, today, keep).orderBy("tier", "rank").limit(keep).select(F.lit(f"{k:02d}").alias("leg"), F.col("rank") + F.col("tier") * keep, "id").toDF("leg", "rank", "id") for k, q in enumerate(asked)]
    spark = index.e.sparkSession
    if carried:
        legs.append(spark.createDataFrame([("zz", k, i) for k, i in enumerate(carried[:4])], "leg string, rank int, id long"))
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    return search.interleave(out, keep)


def planned(queries: Sequence[str], banned: Sequence[str] = (), most: int = 8, chars: int = 40) -> list[str]:
    """A planner's queries that are worth asking: short, different, and not of banned words only."""
    bad = {b.lower() for b in banned}
    short = [q for x in queries if (q := " ".join(x.split())) and len(q) <= chars]
    return [q for q in dict.fromkeys(short) if not all(w.lower() in bad for w in q.split())][:most]


def carried_over(turns: Sequence[Sequence[int]], each: int = 3, most: int = 4) -> list[int]:
    """Records that the last two turns used: ``each`` of a turn, the later turn first, ``most`` in all."""
    return list(dict.fromkeys(i for turn in list(turns)[-2:][::-1] for i in list(turn)[:each]))[:most]


def near_related(index: Index, q: str, today: date, nodes: DataFrame | None = None, chunks: DataFrame | None = None, query: Sequence[float] | None = None, exclude: Sequence[int] = (), limit: int = 12) -> DataFrame:
    """id, how, rank: what a question is close to.  Its nearest vectors where there are some, else what
    its first hits' own words find; and then what stands on the same pages as they."""
    if chunks is not None and query is not None:
        seeds = search.ranked(near(index.e, chunks, query, exclude, limit), "near", F.col("score").desc(), F.col("id"), n=limit)
    else:
        hits = index.select(q, today, limit)
        words = [r["term"] for r in feedback_terms(index.post, hits, index.total).collect()]  # three at most
        own = search.query_terms(q)
        found = search.rare_cohits(index.post, index.lengths, [w for w in words if w not in own], 4 * limit).join(hits.select("id"), "id", "left_anti")
        seeds = search.ranked(found.where(~F.col("id").isin(*exclude)) if exclude else found, "feedback", F.col("n_terms").desc(), "rarest", F.col("id").desc(), n=limit)
    out = seeds.select("id", F.col("leg").alias("how"), "rank")
    if nodes is None:
        return out.limit(limit)
    hop = pages.same_page(nodes, seeds).join(seeds.select("id", "rank"), "id").groupBy(F.col("other").alias("id")).agg(F.min("rank").alias("rank"))
    hop = hop.join(out.select("id"), "id", "left_anti").select("id", F.lit("page").alias("how"), "rank")
    both = (out.unionByName(hop.where(~F.col("id").isin(*exclude))) if exclude else out.unionByName(hop)).orderBy("rank", F.col("how") == "page", "id")
    return both.limit(limit)


def answer(index: Index, questions: Sequence[str], today: date, planner: Callable[[str], Sequence[str]] | None = None, turns: Sequence[Sequence[int]] = (), asked_before: Sequence[str] = (), trail: DataFrame | None = None, keep: int = KEEP, reserved: int = 3) -> DataFrame:
    """place, kind, ref: the records (by id) and pages seen in passing (by address) that a question
    gets.  Lanes of the question and of what a planner adds are taken in turn and set in tiers (records
    that several rare terms meet, on the topic, the rest, mere repeats of the question), then blended
    with the question's shape and words over all records; records that only repeat an earlier
    question go, and ``reserved`` places are the best pages'."""
    main = questions[0]
    lanes = ask(index, [*questions, *planned(planner(main))] if planner else questions, today, None, carried_over(turns), keep)
    pool = search.indexed(index.e)
    if asked_before:
        pool = pool.where(hygiene.not_echo(pool, asked_before))
    terms = search.query_terms(main)
    order = (F.col("round"), F.col("leg"), F.col("id"))
    found = lanes.select("id", "round", "leg").join(pool.select("id"), "id", "left_semi")
    found = search.ranked(found, "found", *order, n=keep).select("id", "rank")
    rare = index.rare_terms(main)
    both = search.rare_cohits(index.post, index.lengths, rare, 4 * keep).where("n_terms >= 2") if len(rare) >= 2 else None
    tiered = search.rerank(found, pool, terms, [main], both)  # ``keep`` rows
    legs = search.ranked(tiered, "found", F.col("tier"), F.col("rank"), F.col("id"), n=keep)
    if terms:
        legs = legs.unionByName(search.ranked(search.scan_words(pool, terms), "scan", F.col("score").desc(), F.col("id"), n=keep))
    if shape := search.shape_of(main):
        legs = legs.unionByName(search.ranked(search.shape_scan(pool, shape, terms), "shape", F.col("score").desc(), F.col("id"), n=keep))
    seen = None
    if trail is not None and terms:
        found = pages.find_pages(trail, terms, reserved)
        seen = found.select((F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("at").desc(), "url")) - 1).alias("place"), F.lit("page").alias("kind"), F.col("url").alias("ref"))  # ``reserved`` rows
    taken = seen.count() if seen is not None else 0
    records = search.blend(legs, keep - taken).select("place", F.lit("record").alias("kind"), F.col("id").cast("string").alias("ref"))
    return records if seen is None else records.unionByName(seen.withColumn("place", F.col("place") + (keep - taken)))
