"""Substring dedup by relative Lempel-Ziv factors over windows, the corpus being its own reference.

What differs from the textbook parse: the reference isn't one text with a suffix structure, in which a longest match
is sought from each position (no machine holds one), but the table of all occurrences of ``window``-word
windows, found by an 80-bit hash that isn't confirmed on words.  A window's source is its first occurrence in its batch
or, for those, in the corpus; a factor is a greatest run of windows whose sources follow each other in one
document.  A longer match in a source that is neither isn't sought.

A block is a run of consecutive windows with the same anchor, the least hash among the windows' ``gram``-word
runs; equal windows have equal anchors, so all places that can match a block meet under its anchor.

1. Each document's anchors are dealt by hash, packed by batch; anchors that occur in one
   document only are done with.  Of an anchor that ``sure`` documents of a batch or more hold
   the batch deals one place with the number, as all of them have it repeated for sure.
2. Blocks of anchors that occur again are dealt with their windows' 80-bit hashes.  A batch
   sends only its own first occurrence of a window; its later ones are settled at once,
   so a passage that very many documents share sends one row a batch.  The different windows
   around such a passage may share an anchor in very many documents; windows of an anchor
   with more than ``hot`` places are dealt by their own hash, so no group of them is unbounded
   (equal windows still meet).  ``hot`` grows with the input so that such anchors, which are
   broadcast, are a million at most.
3. Each block is factored greedily against the first occurrences: a factor goes on while
   the next window is found right behind the last one in the same source.
4. A document's factors are put together: one that goes on over the border of two blocks becomes one
   again.  As every window is looked up, also those that lie over the border of two factors, the words
   that some factor covers are exactly those of windows that start earlier elsewhere; they are removed.

Defined results: documents are ordered by (id, nulls last), then text hash; rows that
agree in both are one document repeated, and are treated alike.  A null or empty text, or
one shorter than a window, loses nothing.  Of very long texts all is parsed, piece by
piece.  Only the id and the text are read; tables may be empty.  Ids are read as long integers.
The groups in which windows meet are as many as keep each at about ``GROUP_BYTES`` of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, mix64, saved, shuffle_partitions, window_hashes

_HASHES: list[WordHashes] = []
DOC_BITS = 40
GROUP_BYTES, TASK_BYTES = 4 << 20, 64 << 20


def _word_hashes(found: list[str]) -> np.ndarray:
    if not _HASHES:
        _HASHES.append(WordHashes())
    return _HASHES[0].of(found)


def _sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Least value of each ``n`` in a row, by doubling."""
    width = 1
    while width * 2 <= n:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    return np.minimum(g[: len(g) - (n - width)], g[n - width :]) if n > width else g


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of a text's word hashes."""
    if len(h) < window:
        return np.empty(0, dtype=np.uint64)
    return _sliding_min(window_hashes(h, gram), window - gram + 1)


def anchor_places(h: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place (and its hash) that is the anchor of one of the windows at ``starts``: a
    place whose hash equals the greatest of the least hashes of the windows around it."""
    span = window - gram + 1
    g = window_hashes(h, gram)
    least = np.zeros(len(g) - span + 1 + 2 * (span - 1), dtype=np.uint64)
    least[starts + span - 1] = _sliding_min(g, span)[starts]
    places = np.flatnonzero(~_sliding_min(~least, span) == g)
    return places, g[places]


def _groups(batch: pa.RecordBatch, text_at: int, most: int = 200_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, word hashes of their texts one after another, and their ends."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    total = 0
    for k, value in enumerate(batch.column(text_at)):
        h = _word_hashes(WORD.findall(value.as_py() or ""))
        rows.append(k)
        parts.append(h)
        total += len(h)
        if total >= most:
            yield rows, np.concatenate(parts), np.cumsum([len(p) for p in parts])
            rows, parts, total = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _windows(h: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one text, each one's text and place in it."""
    n = max(0, len(h) - window + 1)
    starts = np.arange(n)
    owner = np.searchsorted(ends, starts, side="right")
    inside = starts + window <= ends[owner] if n else np.zeros(0, bool)
    starts, owner = starts[inside], owner[inside]
    return starts, owner, starts - np.concatenate([[0], ends[:-1]])[owner] if n else starts


def repeated_anchors(texts: DataFrame, window: int, gram: int, buckets: int, parts: int, hot: int, sure: int = 32) -> DataFrame:
    """_dk, gram: the anchors of a document that another document, or none but it, has
    twice or more; _dk is short, so a few documents may get anchors of others too.  Rows
    without a _dk are the anchors with more than ``hot`` places."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dk = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            all_grams, all_docs = [], []
            for rows, h, ends in _groups(batch, 1):
                starts, owner, _ = _windows(h, ends, window)
                if not len(starts):
                    continue
                places, g = anchor_places(h, starts, window, gram)
                all_grams.append(g)
                all_docs.append(dk[np.asarray(rows)[np.searchsorted(ends, places, side="right")]])
            if not all_grams:
                continue
            g, d = np.concatenate(all_grams), np.concatenate(all_docs)
            bucket = (g % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((d, g, bucket))
            g, d, bucket = g[order], d[order], bucket[order]
            third = np.concatenate([np.ones(2, bool), (g[2:] != g[:-2]) | (d[2:] != d[:-2])])[: len(g)]
            g, d, bucket = g[third], d[third], bucket[third]  # two of a kind tell enough
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            count = np.diff(np.concatenate([first, [len(g)]]))
            many = np.repeat(count >= sure, count)
            n = np.ones(len(g), dtype="<u4")
            n[first] = np.where(count >= sure, count, 1)
            kept = ~many
            kept[first] = True
            # Documents that have it repeated for sure go to places of their own, below 0.
            g, n = np.concatenate([g[kept], g[many]]), np.concatenate([n[kept], n[many]])
            bucket = np.concatenate([bucket[kept], -1 - (d[many] % np.uint64(buckets)).astype(np.int64)])
            d = np.concatenate([d[kept], d[many]])
            order = np.argsort(bucket, kind="stable")
            g, d, n, bucket = g[order], d[order], n[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            low, high = (d & np.uint64(0xFFFFFFFF)).astype("<u4"), (d >> np.uint64(32)).astype("u1")
            packed = [[x[i:j].tobytes() for i, j in spans] for x in (g, low, high)]
            counts = [n[i:j].tobytes() if (n[i:j] > 1).any() else b"" for i, j in spans]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *[pa.array(x, pa.binary()) for x in (*packed, counts)]], names=["bucket", "g", "low", "high", "n"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        g = np.frombuffer(b"".join(rows["g"]), dtype="<u8")
        d = np.frombuffer(b"".join(rows["low"]), dtype="<u4").astype(np.int64) | np.frombuffer(b"".join(rows["high"]), dtype="u1").astype(np.int64) << 32
        if rows["bucket"].iloc[0] < 0:
            return pd.DataFrame({"_dk": pd.array(d, dtype="Int64"), "gram": g.astype(np.int64)})
        n = np.concatenate([np.frombuffer(c, dtype="<u4") if c else np.ones(len(x) // 8, dtype=np.uint32) for c, x in zip(rows["n"], rows["g"], strict=True)])
        order = np.lexsort((d, g))
        g, d, n = g[order], d[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        places = np.add.reduceat(n, first) if len(g) else n
        again = np.repeat(places > 1, np.diff(np.concatenate([first, [len(g)]])))
        often = g[first[places > hot]].astype(np.int64)
        g, d = g[again], d[again]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
        return pd.DataFrame({"_dk": pd.array([*d[new], *[None] * len(often)], dtype="Int64"), "gram": np.concatenate([g[new].astype(np.int64), often])})

    dealt = texts.select("_dk", "_text").mapInArrow(deal, "bucket long, g binary, low binary, high binary, n binary")
    return dealt.repartition(parts, "bucket").groupBy("bucket").applyInPandas(meet, "_dk long, gram long")


_WINDOW_TYPE = np.dtype([("hash", "<u8"), ("more", "<u2")])
_RUN_TYPE = np.dtype([("null", "u1"), ("id", "<i8"), ("hash", "<i8"), ("dk", "<i8"), ("start", "<u4"), ("n", "<u4")])
_FACTOR_TYPE = np.dtype([("start", "<u4"), ("n", "<u4"), ("null", "u1"), ("id", "<i8"), ("from", "<u4")])


def _factors(w: np.ndarray, null: np.ndarray, doc: np.ndarray, text: np.ndarray, dk: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """Windows with the same hash meet; those that aren't the first are factored greedily.
    Returns which windows are first, and (dk, doc, text, factors' array) for the others."""
    order = np.lexsort((at, text, doc, null, w["more"], w["hash"]))
    ws = w[order]
    head = np.concatenate([[True], ws[1:] != ws[:-1]]) if len(ws) else np.zeros(0, bool)
    source = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(ws) else order
    again = (doc[order] != doc[source]) | (text[order] != text[source]) | (at[order] != at[source]) | (null[order] != null[source])
    mine, src = order[again], source[again]
    line = np.lexsort((at[mine], text[mine], doc[mine], null[mine]))
    mine, src = mine[line], src[line]
    if len(mine):
        fresh = (doc[mine][1:] != doc[mine][:-1]) | (text[mine][1:] != text[mine][:-1]) | (null[mine][1:] != null[mine][:-1])
        step = at[mine][1:].astype(np.int64) - at[mine][:-1]
        keep = (step == 0) | (step == 1) & (doc[src][1:] == doc[src][:-1]) & (text[src][1:] == text[src][:-1]) & (at[src][1:].astype(np.int64) - at[src][:-1] == 1)
        start = np.flatnonzero(np.concatenate([[True], fresh | ~keep]))
        last = np.concatenate([start[1:], [len(mine)]]) - 1
        out = np.zeros(len(start), dtype=_FACTOR_TYPE)
        out["start"], out["n"] = at[mine][start], at[mine][last] - at[mine][start] + 1
        out["null"], out["id"], out["from"] = null[src][start], doc[src][start], at[src][start]
        owner = mine[start]
    else:
        out, owner = np.zeros(0, dtype=_FACTOR_TYPE), mine
    return order[head], (null[owner], doc[owner], text[owner], dk[owner]), out


def _joined(f: np.ndarray) -> np.ndarray:
    """A document's factors, sorted by start, those that go on in the same source as one."""
    a, b = f[:-1], f[1:]
    on = (b["start"] == a["start"] + a["n"]) & (b["from"] == a["from"] + a["n"]) & (b["id"] == a["id"]) & (b["null"] == a["null"])
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    out = f[first].copy()
    out["n"] = np.add.reduceat(f["n"].astype(np.int64), first)
    return out


def _packed(owner: tuple, factors: np.ndarray) -> tuple[list, list, list, list, list]:
    """One entry for each document among the factors' owners, which come sorted."""
    null, doc, text, dk = owner
    if not len(factors):
        return [], [], [], [], []
    cut = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (null[1:] != null[:-1])) + 1, [len(doc)]])
    first = cut[:-1]
    return dk[first].tolist(), null[first].tolist(), doc[first].tolist(), text[first].tolist(), [factors[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]


def factored(texts: DataFrame, anchors_: DataFrame, window: int, gram: int, buckets: int, parts: int) -> DataFrame:
    """_dk, list of (null, id, hash, factors) of the documents with repeated windows."""
    often = np.sort(np.array([r["gram"] for r in anchors_.where("_dk IS NULL").select("gram").collect()], dtype=np.int64).astype(np.uint64))
    shipped = texts.sparkSession.sparkContext.broadcast(often)
    found = anchors_.where("_dk IS NOT NULL").groupBy("_dk").agg(F.collect_list("gram").alias("grams"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dk = batch.column(0).to_numpy(zero_copy_only=False)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            text = batch.column(2).to_numpy(zero_copy_only=False)
            parts: list[list[np.ndarray]] = []
            for rows, h, ends in _groups(batch, 3):
                starts, owner, at = _windows(h, ends, window)
                if not len(starts):
                    continue
                a = anchors(h, window, gram)[starts]
                bound = np.searchsorted(owner, np.arange(len(rows) + 1))
                hit = np.zeros(len(a), dtype=bool)
                for k, row in enumerate(rows):
                    grams = batch.column(4)[row].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                    hit[bound[k] : bound[k + 1]] = np.isin(a[bound[k] : bound[k + 1]], grams)
                w = np.zeros(int(hit.sum()), dtype=_WINDOW_TYPE)
                chosen = starts[hit]
                w["hash"] = window_hashes(h, window)[chosen]
                w["more"] = window_hashes(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), window)[chosen] & np.uint64(0xFFFF)
                row = np.asarray(rows)[owner[hit]]
                parts.append([w, a[hit], row, at[hit].astype(np.uint32)])
            if not parts:
                continue
            w, a, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            first, owner, out = _factors(w, null[row], doc[row], text[row], dk[row], at)
            # What the batch settles itself travels along to the same table.
            own = _packed(owner, out)
            if own[0]:
                yield pa.RecordBatch.from_arrays([pa.array([x % buckets for x in own[0]], pa.int64()), pa.array([None] * len(own[0]), pa.binary()), pa.array([None] * len(own[0]), pa.binary()), *[pa.array(x, t) for x, t in zip(own, _OWN, strict=True)]], names=_NAMES)
            dealt_by = np.where(np.isin(a[first], shipped.value), w["hash"][first], a[first])
            bucket = (mix64(dealt_by) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at[first], row[first], bucket))
            first, bucket = first[order], bucket[order]
            r, p = row[first], at[first].astype(np.int64)
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]) if len(first) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            runs = np.zeros(len(begin), dtype=_RUN_TYPE)
            runs["null"], runs["id"], runs["hash"], runs["dk"] = null[r[begin]], doc[r[begin]], text[r[begin]], dk[r[begin]]
            runs["start"], runs["n"] = p[begin], np.diff(np.concatenate([begin, [len(first)]]))
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(first)]])
            in_runs = np.searchsorted(begin, cut)
            n = len(cut) - 1 if len(first) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut[:-1]] if n else [], pa.int64()), pa.array([runs[in_runs[k] : in_runs[k + 1]].tobytes() for k in range(n)], pa.binary()), pa.array([w[first[cut[k] : cut[k + 1]]].tobytes() for k in range(n)], pa.binary()), *[pa.array([0] * n, t) for t in _OWN[:-1]], pa.nulls(n, pa.binary())],  # no nulls: pandas would make floats
                names=_NAMES,
            )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        passed = rows[rows["factors"].notna()][["_dk", "null", "id", "hash", "factors"]]
        sent = rows[rows["runs"].notna()]
        runs = np.frombuffer(b"".join(sent["runs"]), dtype=_RUN_TYPE)
        w = np.frombuffer(b"".join(sent["windows"]), dtype=_WINDOW_TYPE)
        n = runs["n"].astype(np.int64)
        of = np.repeat(np.arange(len(runs)), n)
        at = (runs["start"].astype(np.int64)[of] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
        _, owner, out = _factors(w, runs["null"][of], runs["id"][of], runs["hash"][of], runs["dk"][of], at)
        found = pd.DataFrame(dict(zip(("_dk", "null", "id", "hash", "factors"), _packed(owner, out), strict=True)))
        return pd.concat([x for x in (passed, found) if len(x)]) if len(passed) or len(found) else passed

    rows = texts.join(found, "_dk").select("_dk", "_id", "_hash", "_text", "grams")
    sent = rows.mapInArrow(blocks, "bucket long, runs binary, windows binary, _dk long, null long, id long, hash long, factors binary")
    met = sent.repartition(parts, "bucket").groupBy("bucket").applyInPandas(meet, "_dk long, null long, id long, hash long, factors binary")
    return met.groupBy("_dk").agg(F.collect_list(F.struct("null", "id", "hash", "factors")).alias("found"))


_OWN = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["bucket", "runs", "windows", "_dk", "null", "id", "hash", "factors"]


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = 2000) -> DataFrame:
    """For each row: the id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), spans (start, end, source id, source start) in words, and with ``with_text`` the
    kept text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), size // TASK_BYTES)
    buckets = max(64, 4 * parts, size // GROUP_BYTES)
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    texts = docs.select(F.pmod(F.xxhash64(key, text), F.lit(1 << DOC_BITS)).alias("_dk"), key.alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    # An anchor's place takes a word or more, so there are size / 2 places at most.
    found = saved(repeated_anchors(texts, window, gram, buckets, parts, max(hot, size // 2_000_000)))
    parsed = factored(texts, found, window, gram, buckets, parts)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, hashes, lists = batch.column(0), batch.column(1), batch.column(3)
            for k, value in enumerate(batch.column(2)):
                words = WORD.findall(value.as_py() or "")
                parts = []
                for x in lists[k].as_py() or ():
                    if (bool(x["null"]), x["hash"]) == (ids[k].as_py() is None, hashes[k].as_py()) and (x["null"] or x["id"] == ids[k].as_py()):
                        parts.append(np.frombuffer(x["factors"], dtype=_FACTOR_TYPE))
                spans, n = [], 0
                if parts:
                    f = _joined(np.unique(np.concatenate(parts)))
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, f["start"].astype(np.int64), 1)
                    np.add.at(change, f["start"].astype(np.int64) + f["n"] - 1 + window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    n = int(gone.sum())
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                    spans = [{"start": int(x["start"]), "end": int(x["start"]) + int(x["n"]) - 1 + window, "source": None if x["null"] else int(x["id"]), "source_start": int(x["from"])} for x in f]
                kept = " ".join(words)
                out.append((len(words) + n, n, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), spans, kept if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names=["_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    rows = texts.join(parsed, "_dk", "left").select("_id", "_hash", "_text", "found")
    done = rows.mapInArrow(remove, "_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>, kept_text string")
    done = done.withColumnRenamed("_id", id_col)
    return done if with_text else done.drop("kept_text")
