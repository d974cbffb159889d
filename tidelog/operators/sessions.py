"""Sequences in time: spans, runs, focus sessions, changes, pages, speaker turns.

All of them partition by a key (a user, a day of a log), so state never crosses keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import GLANCE_S, RUN_GAP_S, SPAN_CAP_S


def _us(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


def app_spans(rows: DataFrame, key: str, at: str, app: str, tie: str, cap_s: int = SPAN_CAP_S) -> DataFrame:
    """Seconds per app: the time to the next row, at most ``cap_s``; a last row counts 0."""
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = F.coalesce(_us(F.lead(at).over(w)) - _us(at), F.lit(0))
    spans = rows.select(key, app, F.least(gap, F.lit(cap_s * 1_000_000)).alias("us"))
    return spans.groupBy(key, app).agg(F.round(F.sum("us") / 1_000_000, 3).alias("secs"), F.count(F.lit(1)).alias("n"))


def islands(rows: DataFrame, key: str, at: str, tie: str, gap_s: int = RUN_GAP_S) -> DataFrame:
    """``rows`` with run: numbers from 1 of the stretches without a gap over ``gap_s``; rows at
    the same time stay together."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((_us(at) - _us(F.lag(at).over(w)) > gap_s * 1_000_000).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(rows: DataFrame, key: str, at: str, tie: str, gap_s: int = RUN_GAP_S) -> DataFrame:
    return islands(rows, key, at, tie, gap_s).groupBy(key, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def changes(rows: DataFrame, key: str, at: str, watched: str, tie: str, heartbeat_s: int = 300) -> DataFrame:
    """Rows whose watched value differs from the one before, or that come ``heartbeat_s`` after it."""
    w = Window.partitionBy(key).orderBy(at, tie)
    kept = F.lag(at).over(w).isNull() | ~F.col(watched).eqNullSafe(F.lag(watched).over(w)) | (_us(at) - _us(F.lag(at).over(w)) >= heartbeat_s * 1_000_000)
    return rows.withColumn("_kept", kept).where("_kept").drop("_kept")


def focus_sessions(rows: DataFrame, key: str, at: str, app: str, title: str, tie: str, heartbeat_s: int = 300, glance_s: int = GLANCE_S, as_of_us: int | None = None) -> DataFrame:
    """key, app, title, start_us, end_us, n: sessions of one app and title.

    Rows of one app and title with no gap over the heartbeat are a block; it ends a heartbeat
    after its last row, but not in the next block and not after ``as_of_us``.  Blocks without a
    pause over the heartbeat are a stretch.  In it a glance (a block of another app than the one
    in use, under ``glance_s``) belongs to the session around it.  The app in use is that of the
    last block which is no glance-length one, or of the stretch's first; so whether a block is a
    glance, and whether one that isn't differs from the one before it, are windows over blocks."""
    hb = heartbeat_s * 1_000_000
    w = Window.partitionBy("key").orderBy("us", "tie")
    r = rows.select(F.col(key).alias("key"), _us(at).alias("us"), F.col(app).alias("app"), F.col(title).alias("title"), F.col(tie).alias("tie"))
    same = F.lag("app").over(w).eqNullSafe(F.col("app")) & F.lag("title").over(w).eqNullSafe(F.col("title")) & (F.col("us") - F.lag("us").over(w) <= hb)
    block = F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = r.withColumn("block", block).groupBy("key", "block").agg(F.first("app").alias("app"), F.first("title").alias("title"), F.min("us").alias("start"), F.max("us").alias("seen"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("block")
    limits = [F.col("seen") + hb, F.lead("start").over(w), *([F.lit(as_of_us)] if as_of_us is not None else [])]
    b = b.withColumn("end", F.greatest("seen", F.least(*limits)))
    pause = F.coalesce(F.col("start") - F.lag("end").over(w) > hb, F.lit(True))
    b = b.withColumns({"first": pause, "stretch": F.sum(pause.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    w = Window.partitionBy("key", "stretch").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    long_ = F.col("first") | (F.col("end") - F.col("start") >= glance_s * 1_000_000)
    in_use = F.last(F.when(long_, F.struct("app")), ignorenulls=True).over(before)
    b = b.withColumn("kept", long_ | in_use["app"].eqNullSafe(F.col("app")))
    named = F.last(F.when(F.col("kept"), F.struct("app", "title")), ignorenulls=True).over(before)
    new = F.col("kept") & (F.col("first") | ~named.eqNullSafe(F.struct("app", "title")))
    b = b.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct("app", "title"), "block")
    out = b.groupBy("key", "stretch", "session").agg(first.alias("_f"), F.min("start").alias("start_us"), F.max("end").alias("end_us"), F.sum("n").alias("n"))
    return out.select("key", F.col("_f.app").alias("app"), F.col("_f.title").alias("title"), "start_us", "end_us", "n")


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bin_s: int = 3600) -> DataFrame:
    """Points with the span of their key that holds them, start <= at < end (or at = start).
    A range join as an equi join: spans are spread over the time bins they touch."""
    to_bin = lambda c: F.floor(_us(c) / (bin_s * 1_000_000))
    s = spans.withColumn("_bin", F.explode(F.sequence(to_bin(start), to_bin(end))))
    p = points.withColumn("_bin", to_bin(at))
    return p.join(s, [key, "_bin"]).where((F.col(at) >= F.col(start)) & ((F.col(at) < F.col(end)) | (F.col(at) == F.col(start)))).drop("_bin")


def pages_of_day(rows: DataFrame, url: str, at: str, text: str, title: str) -> DataFrame:
    """Per URL and day: first visit, the longest text, the first title that says anything."""
    seen = rows.where(F.coalesce(F.col(url), F.lit("")) != "")
    blank = F.when(F.trim(F.coalesce(F.col(title), F.lit(""))) != "", F.struct(F.col(at), F.col(title)))
    return seen.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(url).alias("url")).agg(
        F.min(at).alias("first_at"), F.max_by(text, F.struct(F.length(text), F.col(text))).alias("text"), F.min(blank)[title].alias("title"), F.count(F.lit(1)).alias("visits"),
    )


def overlap_speakers(chunks: DataFrame, segments: DataFrame, key: str, chunk: str, least: float = 0.2, bin_s: float = 60.0) -> DataFrame:
    """For each chunk (key, chunk, start, end) the speaker of ``segments`` (key, speaker, start,
    end) with the most seconds in common, at least ``least``; ties go to the lesser name."""
    known = lambda rows: rows.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    first = F.floor(F.col("start") / bin_s)
    final = F.greatest(first, F.ceil(F.col("end") / bin_s) - 1)
    # Bins of chunks are numbered within the key, and a segment's first and last bin fall between two numbers:
    # a long segment costs two rows and those of the bins that it meets, not one for every bin it spans.
    c = known(chunks).select(key, F.explode(F.sequence(first, final)).alias("_bin"), F.lit(1).alias("_kind"), F.struct(chunk, "start", "end").alias("_c"))
    g = F.struct("speaker", F.col("start").alias("_s"), F.col("end").alias("_e")).alias("_g")
    s = known(segments).select(key, g, F.inline(F.array(F.struct(first.alias("_bin"), F.lit(0).alias("_kind")), F.struct(final.alias("_bin"), F.lit(2).alias("_kind")))))
    w = Window.partitionBy(key).orderBy("_bin", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = c.unionByName(s, allowMissingColumns=True).withColumn("_no", F.sum(F.when(F.col("_kind") == 1, 1).otherwise(0)).over(w))
    spans = marks.where("_kind <> 1").groupBy(key, "_g").agg(F.min("_no").alias("_lo"), F.max("_no").alias("_hi"), F.count_if(F.col("_kind") == 0).alias("_n")).where("_hi > _lo")
    near = spans.select(key, "_g.*", "_n", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_no")).join(marks.where("_kind = 1").select(key, "_no", "_bin", "_c.*"), [key, "_no"])
    lo, hi = F.greatest("start", "_s", F.col("_bin") * bin_s), F.least("end", "_e", (F.col("_bin") + 1) * bin_s)  # each bin counts its own part
    met = near.withColumn("_o", (hi - lo) * F.col("_n")).where("_o > 0")
    total = met.groupBy(key, chunk, "speaker").agg(F.round(F.sum("_o"), 6).alias("secs")).where(F.col("secs") >= least)
    best = total.groupBy(key, chunk).agg(F.min(F.struct((-F.col("secs")).alias("minus"), "speaker")).alias("b"))
    return best.select(key, chunk, F.col("b.speaker").alias("speaker"), (-F.col("b.minus")).alias("secs"))


def merge_turns(rows: DataFrame, key: str, order: str, who: str, text: str, most: int = 10_000) -> DataFrame:
    """Neighbouring rows of one speaker become one turn, their texts joined in order.  A turn of
    more than ``most`` rows comes in parts of at most so many, so no row holds more of them."""
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(who).eqNullSafe(F.lag(who).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    t = rows.withColumn("_new", new).withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = ((F.row_number().over(Window.partitionBy(key, "merged").orderBy(order)) - 1) / most).cast("int")
    t = t.withColumn("part", part)
    out = t.groupBy(key, "merged", "part", who).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(order, text))).alias("_t"))
    return out.select(key, "merged", "part", who, "n", F.array_join(F.transform("_t", lambda x: F.coalesce(x[text], F.lit(""))), "\n").alias("text"))


def speaker_shares(rows: DataFrame, key: str, least: float = 1.0) -> DataFrame:
    """key, speaker, secs, rank: who spoke how long, numbered by it; under ``least`` seconds nobody counts."""
    secs = rows.groupBy(key, "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("secs")).where(F.col("secs") >= least)
    return secs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("secs").desc(), "speaker")))


def speech_segments(blocks: DataFrame, key: str, order: str, speech: str, start_blocks: int = 2, stop_blocks: int = 10, least_blocks: int = 6, most_blocks: int = 1172, pre_roll: int = 2) -> DataFrame:
    """The segments that a recorder keeps: it starts after ``start_blocks`` speech blocks in a
    row, stops after ``stop_blocks`` silent ones or at ``most_blocks``, and drops segments
    with under ``least_blocks`` speech blocks.  State is a few numbers; rows stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            out = []
            for k, block, on in zip(batch["key"], batch["block"], batch["speech"], strict=True):
                if state is None or state.key != k:
                    if state is not None and (seg := state.end()):
                        out.append(seg)
                    state = Segmenter(k, start_blocks, stop_blocks, least_blocks, most_blocks, pre_roll)
                if seg := state.feed(int(block), bool(on)):
                    out.append(seg)
            yield pd.DataFrame(out, columns=["key", "first", "last", "voiced"])
        if state is not None and (seg := state.end()):
            yield pd.DataFrame([seg], columns=["key", "first", "last", "voiced"])

    rows = blocks.select(F.col(key).alias("key"), F.col(order).alias("block"), F.col(speech).alias("speech")).repartition("key").sortWithinPartitions("key", "block")
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, first long, last long, voiced long")


class Segmenter:
    """The recorder's state for one key, fed block by block; shared by batch and stream."""

    def __init__(self, key, start: int, stop: int, least: int, most: int, pre_roll: int, state: tuple | None = None):
        self.key, self.start, self.stop, self.least, self.most, self.pre_roll = key, start, stop, least, most, pre_roll
        self.in_row, self.silent, self.first, self.last, self.voiced = state or (0, 0, -1, -1, 0)

    def state(self) -> tuple[int, int, int, int, int]:
        return self.in_row, self.silent, self.first, self.last, self.voiced

    def end(self) -> tuple | None:
        out = (self.key, self.first, self.last, self.voiced) if self.first >= 0 and self.voiced >= self.least else None
        self.in_row, self.silent, self.first, self.last, self.voiced = 0, 0, -1, -1, 0
        return out

    def feed(self, block: int, speech: bool) -> tuple | None:
        if self.first < 0:
            self.in_row = self.in_row + 1 if speech else 0
            if self.in_row >= self.start:
                self.first, self.last = max(0, block - self.in_row + 1 - self.pre_roll), block
                self.voiced, self.silent = self.in_row, 0
            return None
        self.last = block
        self.voiced += speech
        self.silent = 0 if speech else self.silent + 1
        return self.end() if self.silent >= self.stop or self.last - self.first + 1 >= self.most else None
