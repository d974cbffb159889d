"""Streams of events: once-a-day pages, copies, slots, sessions, changes, speech segments.

Times must be timestamps: ``stamped`` casts those without a zone, which watermarks refuse.
Stateful processors take ``expire_s``: what a key left behind is then dropped after so long, by
the clock.  Give it to streams that run on; a stream that ends when all is read would never end.

What ends by silence is told by timers (``quiet_keys``, ``spans``, ``on_speech`` with a time): each key has one, at the
end of its last event's grace, by the stream's own time or by the clock.  So a last segment, span or
sign of life is told although nothing more of its key comes, and its state goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import Segmenter


def stamped(rows: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def once_a_day(rows: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """The first event of each key and day.  Rows without a key or text count nowhere: filter
    them before, so that a later good one still comes through."""
    return stamped(rows, at, "1 day").withColumn("day", F.to_date(at)).dropDuplicatesWithinWatermark([key, "day"])


def without_copies(rows: DataFrame, identity: str, at: str = "ts", window: str = "2 minutes") -> DataFrame:
    return stamped(rows, at, window).dropDuplicatesWithinWatermark([identity])


def slots(rows: DataFrame, at: str = "ts", size: str = "5 minutes") -> DataFrame:
    w = stamped(rows, at).groupBy(F.window(at, size)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("slot"), "n")


def sessions(rows: DataFrame, keys: list[str], at: str = "ts", gap: str = "5 minutes") -> DataFrame:
    w = stamped(rows, at).groupBy(*keys, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return w.select(*keys, F.col("session_window.start").alias("start"), "last", "n")


def _ttl(expire_s: int | None) -> int | None:
    return None if expire_s is None else expire_s * 1000


def _mode(expire_s: int | None) -> str:
    return "None" if expire_s is None else "ProcessingTime"


class OnChange(StatefulProcessor):
    """Lets an event through if its value differs from the key's last one, or comes a heartbeat
    after it; remembers one value and time for each key."""

    def __init__(self, heartbeat_s: int, expire_s: int | None = None):
        self.heartbeat_s, self.ttl_ms = heartbeat_s, _ttl(expire_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, at double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows, "ts")
        value, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in batch.itertuples(index=False):
            now = r.ts.timestamp()
            if at is None or r.value != value or now - at >= self.heartbeat_s:
                out.append((key[0], r.ts, r.value))
            value, at = r.value, now
        self.last.update((value, at))
        yield pd.DataFrame(out, columns=["key", "ts", "value"])

    def close(self) -> None:
        pass


def on_change(rows: DataFrame, key: str, value: str, at: str = "ts", heartbeat_s: int = 300, expire_s: int | None = None) -> DataFrame:
    flat = rows.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(value).cast("string").alias("value"))
    return flat.groupBy("key").transformWithStateInPandas(OnChange(heartbeat_s, expire_s), f"key {dict(flat.dtypes)['key']}, ts timestamp, value string", "Append", _mode(expire_s))


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, whose size the source's options bound."""
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Timed(StatefulProcessor):
    """One timer for each key: ``wait`` moves it, ``over`` says what its expiry tells.  A key that is
    told loses all it left behind."""

    def __init__(self, grace_s: float, by_clock: bool = False):
        self.grace_ms, self.by_clock = int(grace_s * 1000), by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def wait(self, last_ms: int, timers) -> None:
        """The key's grace begins anew: with its last event, or now where the clock counts."""
        self.stop()
        at = (timers.getCurrentProcessingTimeInMs() if self.by_clock else last_ms) + self.grace_ms
        self.handle.registerTimer(at)
        self.due.update((at,))

    def stop(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer that was moved in the batch in which it ran out is no longer the key's.
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
            yield self.over(key)

    def over(self, key) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    return int(ts.timestamp() * 1000)


class QuietKeys(Timed):
    """Tells each key that has given no sign of life for the grace, with its last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (pd.Timestamp(self.last.get()[0]) if self.last.exists() else None), []
        for ts in _sorted(rows, "ts")["ts"]:
            if last is not None and not self.by_clock and (ts - last).total_seconds() * 1000 > self.grace_ms:
                out.append((key[0], last))  # it had fallen silent before the stream's time told
            last = ts if last is None else max(ts, last)
        self.last.update((last.to_pydatetime(),))
        self.wait(_ms(last), timerValues)
        yield pd.DataFrame(out, columns=["key", "since"])

    def over(self, key) -> pd.DataFrame:
        since = self.last.get()[0]
        self.last.clear()
        return pd.DataFrame([(key[0], since)], columns=["key", "since"])


class Spans(Timed):
    """Stretches of one value: a span ends when the value changes, after a gap, or in silence."""

    COLUMNS = ["key", "value", "start", "last", "n", "ended_by"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.span = handle.getValueState("span", "value string, start timestamp, last timestamp, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = (tuple(self.span.get()) if self.span.exists() else None), []
        for r in _sorted(rows, "ts").itertuples(index=False):
            ts, value = r.ts.to_pydatetime(), None if r.value is None or r.value != r.value else r.value
            if held is not None:
                gap = (ts - held[2]).total_seconds() * 1000 > self.grace_ms
                if gap or value != held[0]:
                    out.append((key[0], *held, "gap" if gap else "change"))
                    held = None
            held = (value, ts, ts, 1) if held is None else (value, held[1], max(ts, held[2]), held[3] + 1)
        self.span.update(held)
        self.wait(_ms(held[2]), timerValues)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def over(self, key) -> pd.DataFrame:
        held = tuple(self.span.get())
        self.span.clear()
        return pd.DataFrame([(key[0], *held, "silence")], columns=self.COLUMNS)


class OnSpeech(Timed):
    """The speech segmenter as a stream; its state is five numbers for each key.  With a grace, a segment
    that is open when the key falls silent is ended by its timer, and an idle key keeps no state."""

    def __init__(self, limits: tuple[int, ...], grace_s: float | None = None, by_clock: bool = False):
        super().__init__(grace_s or 0, by_clock)
        self.limits, self.timed = limits, grace_s is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.timed:
            super().init(handle)
            self.seen = handle.getValueState("seen", "ms long")
        self.kept = handle.getValueState("segment", "a long, b long, c long, d long, e long")

    def _segmenter(self, key) -> Segmenter:
        return Segmenter(key[0], *self.limits, state=tuple(self.kept.get()) if self.kept.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._segmenter(key), []
        last = self.seen.get()[0] if self.timed and self.seen.exists() else None
        for r in _sorted(rows, "block").itertuples(index=False):
            if self.timed:
                now = _ms(r.ts)
                if last is not None and not self.by_clock and now - last > self.grace_ms and (seg := s.end()):
                    out.append(seg)  # it had ended before the stream's time told
                last = now if last is None else max(now, last)
            if seg := s.feed(int(r.block), bool(r.speech)):
                out.append(seg)
        self.kept.update(s.state())
        if self.timed:
            self.seen.update((last,))
            self.wait(last, timerValues)
        yield pd.DataFrame(out, columns=["key", "first", "last", "voiced"])

    def over(self, key) -> pd.DataFrame:
        seg = self._segmenter(key).end()
        self.kept.clear()
        self.seen.clear()
        return pd.DataFrame([seg] if seg else [], columns=["key", "first", "last", "voiced"])


def _time_mode(by_clock: bool) -> str:
    return "ProcessingTime" if by_clock else "EventTime"


def on_speech(rows: DataFrame, key: str, block: str, speech: str, start: int = 2, stop: int = 10, least: int = 6, most: int = 1172, pre_roll: int = 2, at: str | None = None, silence_s: float | None = None, by_clock: bool = False, late: str = "10 seconds") -> DataFrame:
    """key, first, last, voiced.  With ``silence_s``, an open segment also ends when its key has sent no block
    for so long: by the time in column ``at``, or by the clock."""
    kind = dict(rows.dtypes)[key]
    columns = [F.col(key).alias("key"), F.col(block).alias("block"), F.col(speech).alias("speech")]
    if silence_s is None:
        return rows.select(*columns).groupBy("key").transformWithStateInPandas(OnSpeech((start, stop, least, most, pre_roll)), f"key {kind}, first long, last long, voiced long", "Append", "None")
    flat = stamped(rows.select(*columns, F.col(at).alias("ts")), "ts", late)
    made = OnSpeech((start, stop, least, most, pre_roll), silence_s, by_clock)
    return flat.groupBy("key").transformWithStateInPandas(made, f"key {kind}, first long, last long, voiced long", "Append", _time_mode(by_clock))


def quiet_keys(rows: DataFrame, key: str, at: str = "ts", after_s: float = 660, by_clock: bool = False, late: str = "0 seconds") -> DataFrame:
    """key, since: each key once for each time that it falls silent for ``after_s``."""
    flat = stamped(rows.select(F.col(key).alias("key"), F.col(at).alias("ts")), "ts", late)
    return flat.groupBy("key").transformWithStateInPandas(QuietKeys(after_s, by_clock), f"key {dict(flat.dtypes)['key']}, since timestamp", "Append", _time_mode(by_clock))


def spans(rows: DataFrame, key: str, value: str, at: str = "ts", gap_s: float = 300, by_clock: bool = False, late: str = "10 seconds") -> DataFrame:
    """key, value, start, last, n, ended_by (change, gap or silence): stretches of one value, such as
    the program in front.  Nothing is left open: the last one is told after ``gap_s`` of silence."""
    flat = stamped(rows.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.col(at).alias("ts")), "ts", late)
    schema = f"key {dict(flat.dtypes)['key']}, value string, start timestamp, last timestamp, n long, ended_by string"
    return flat.groupBy("key").transformWithStateInPandas(Spans(gap_s, by_clock), schema, "Append", _time_mode(by_clock))


#: How long a copy of each kind is the same copy; pictures are compared by likeness.
COPY_WINDOWS = {"text": "2 minutes", "image": "2 minutes", "url": "1 day"}


def without_copies_by_kind(rows: DataFrame, kind: str, identity: str, at: str = "ts", windows: dict[str, str] | None = None) -> DataFrame:
    """Each kind of copied thing less what was copied already within the kind's window."""
    parts = [without_copies(rows.where(F.col(kind) == k), identity, at, w) for k, w in (windows or COPY_WINDOWS).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class OtherShapes(StatefulProcessor):
    """Lets a copied thing through unless it is another shape of one that was taken before.  A take
    comes with its other shapes; each of them is let go once, within ``keep_s``."""

    def __init__(self, keep_s: int, expire_s: int | None = None):
        self.keep_s, self.ttl_ms = keep_s, _ttl(expire_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getMapState("left", "shape string", "at double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _sorted(rows, "ts").itertuples(index=False):
            now = r.ts.timestamp()
            if self.left.containsKey((r.shape,)):
                at = self.left.getValue((r.shape,))[0]
                self.left.removeKey((r.shape,))
                if now - at <= self.keep_s:
                    continue
            for other in r.others if r.others is not None else ():
                if other != r.shape:
                    self.left.updateValue((other,), (now,))
            out.append((key[0], r.ts, r.shape))
        yield pd.DataFrame(out, columns=["key", "ts", "shape"])

    def close(self) -> None:
        pass


def without_other_shapes(rows: DataFrame, key: str, shape: str, others: str, at: str = "ts", keep_s: int = 300, expire_s: int | None = None) -> DataFrame:
    flat = rows.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(shape).alias("shape"), F.col(others).alias("others"))
    return flat.groupBy("key").transformWithStateInPandas(OtherShapes(keep_s, expire_s), f"key {dict(flat.dtypes)['key']}, ts timestamp, shape string", "Append", _mode(expire_s))


class RecentPictures(StatefulProcessor):
    """Lets a picture through unless one like it (fingerprints at most ``near`` bits apart, of the
    same size) came within ``keep_s``; remembers the last ``most`` of a key."""

    def __init__(self, keep_s: int, near: int, most: int, expire_s: int | None = None):
        self.keep_s, self.near, self.most, self.ttl_ms = keep_s, near, most, _ttl(expire_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "bits long, size string, at double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [tuple(x) for x in self.seen.get()] if self.seen.exists() else []
        out = []
        for r in _sorted(rows, "ts").itertuples(index=False):
            now = r.ts.timestamp()
            seen = [x for x in seen if now - x[2] < self.keep_s]
            if not any(x[1] == r.size and ((x[0] ^ int(r.bits)) & (2**64 - 1)).bit_count() <= self.near for x in seen):
                out.append((key[0], r.ts, int(r.bits)))
                seen = [*seen, (int(r.bits), r.size, now)][-self.most :]
        yield pd.DataFrame(out, columns=["key", "ts", "bits"])
        if seen:
            self.seen.put(seen)
        else:
            self.seen.clear()

    def close(self) -> None:
        pass


def without_same_pictures(rows: DataFrame, key: str, bits: str, size: str, at: str = "ts", keep_s: int = 60, near: int = 2, most: int = 12, expire_s: int | None = None) -> DataFrame:
    flat = rows.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(bits).cast("long").alias("bits"), F.col(size).cast("string").alias("size"))
    return flat.groupBy("key").transformWithStateInPandas(RecentPictures(keep_s, near, most, expire_s), f"key {dict(flat.dtypes)['key']}, ts timestamp, bits long", "Append", _mode(expire_s))


def stale(rows: DataFrame, key: str, at: str = "ts", after: str = "11 minutes") -> DataFrame:
    """key, since: keys that gave no sign of life for ``after``; known once the stream's own time has
    passed that far, by a session that closed."""
    w = stamped(rows, at, "0 seconds").groupBy(key, F.session_window(at, after)).agg(F.max(at).alias("since"))
    return w.select(key, "since")


def append_to(rows: DataFrame, path: str, checkpoint: str, partition: str | None = None, **trigger):
    """A stream as an appending sink of Parquet files; a restart goes on where it stopped, once each."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(partition) if partition else writer).trigger(**(trigger or {"availableNow": True})).start()


def maintain(rows: DataFrame, checkpoint: str, step, **trigger):
    """Runs ``step(batch, number)`` over what came in, a bounded piece at a time (set by the source's
    maxFilesPerTrigger), so that derived tables follow the records."""
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
