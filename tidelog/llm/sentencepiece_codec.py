"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly.

Encoding by backtracking instead of by a queue of merges: an Aho-Corasick automaton
over all reachable pieces gives the longest piece at each place; a piece may follow
another one only if merging the two together gives just these two again; places from
which no such sequence reaches the end are marked in a bitfield, so none is tried twice.

Text is first cut where no merge can cross: before a word mark that follows another
character, and around characters that no piece holds (these become byte pieces).  The
cuts make short, much repeated chunks, which a bounded cache serves.

Defined results: a null text counts as empty; an empty text has no ids and decodes to
an empty text; repeated rows are encoded each.  Very long texts and chunks take time in
proportion to their length; chunks of over 64 characters aren't cached.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class _Room:
    """A limit in bytes that several caches share; when it is reached, all turn over."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.caches: list[_Cache] = []

    def take(self, key, value) -> None:
        self.used += 120 + sys.getsizeof(value) + (sys.getsizeof(key) if type(key) is str else 64)
        if self.used > self.limit:
            self.used = 0
            for cache in self.caches:
                cache.old = dict(cache)
                cache.clear()


class _Cache(dict):
    """Two generations: what was not used since the last turn-over is forgotten."""

    def __init__(self, make, room: _Room, keep=lambda key: True):
        super().__init__()
        self.make, self.room, self.keep, self.old = make, room, keep, {}
        room.caches.append(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if (type(key) is not str or len(key) <= 64) and self.keep(key):
            self.room.take(key, value)
            self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder for one model file; made once per Python worker.  Its caches hold at
    most twice ``cache_bytes`` together."""

    def __init__(self, model_path: str, cache_bytes: int = 64 << 20):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a word mark after other characters are not supported")
        chars = {c for p in self.ids for c in p}
        if not all(c in self.ids for c in chars):
            raise ValueError("a character of a longer piece has no piece of its own")
        reachable = [p for p in self.ids if self._merge(p) == [p]]
        self.left_edge: dict[str, list[tuple[str, float | None]]] = {}
        self.right_edge: dict[str, list[tuple[str, float | None]]] = {}
        self.ordered = all([self._edges(p) for p in reachable])
        self.prefix: dict[str, str | None] = {}
        known = set(reachable)
        for p in reachable:
            self.prefix[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None)
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        inner = "".join(re.escape(c) for c in sorted(chars - {MARK}))
        self.cut = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|.", re.DOTALL)
        self.chars = chars
        # decode(): each id's bytes, by the decimal text of the id
        self.raw: dict[str, bytes] = {}
        for i, p in enumerate(self.pieces):
            self.raw[str(i)] = bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else b"" if kinds[i] == CONTROL else " ⁇ ".encode() if kinds[i] == UNKNOWN else p.replace(MARK, " ").encode()
        self.is_byte = {str(i) for i, k in enumerate(kinds) if k == BYTE}
        self.is_control = {str(i) for i, k in enumerate(kinds) if k == CONTROL}
        self.is_normal_mark = {str(i) for i, k in enumerate(kinds) if k == NORMAL and self.pieces[i].startswith(MARK)}
        room = _Room(cache_bytes)
        self._fits = _Cache(self._compatible, room)
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self._chunks = _Cache(self._encode_chunk, room)
        # Two characters that stand side by side in no piece are parted by every encoding.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._words = _Cache(self._encode_word, room, lambda word: len(word) < 2 or word[-2:] in self.joined)

    def _merge(self, text: str) -> list[str]:
        """Merge characters by score, best first, leftmost first among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, piece: str) -> bool:
        """Note what stands at both edges of ``piece`` while it is merged, each with the score
        of the merge that takes it up (None: none).  False if a merge scores above one before
        it, so that scores don't give the order in time."""
        parts, score = list(piece), self.score
        left, right, before, ordered = [parts[0]], [parts[-1]], None, True
        taken_left, taken_right = [], []
        while len(parts) > 1:
            best, at = max(((score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in score))
            at = -at
            ordered &= before is None or best <= before
            before = best
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append(parts[0])
                taken_left.append(best)
            if at == len(parts) - 1:
                right.append(parts[-1])
                taken_right.append(best)
        self.left_edge[piece] = list(zip(left, [*taken_left, None], strict=True))
        self.right_edge[piece] = list(zip(right, [*taken_right, None], strict=True))
        return ordered

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Does merging both pieces' characters give just these two again?  Both are merged
        anew side by side; only a merge over the border between them can spoil it."""
        if not self.ordered:
            return self._merge(pair[0] + pair[1]) == [pair[0], pair[1]]
        a, b, score = self.right_edge[pair[0]], self.left_edge[pair[1]], self.score
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            over = score.get(x + y)
            if over is not None and (x_taken is None or over > x_taken) and (y_taken is None or over >= y_taken):
                return False
            if x_taken is None and y_taken is None:
                return True
            if y_taken is None or (x_taken is not None and x_taken >= y_taken):
                i += 1
            else:
                j += 1

    def _encode_chunk(self, chunk: str) -> str:
        """The chunk's ids as decimal numbers joined by commas."""
        if chunk[0] not in self.chars:
            return ",".join(str(self.byte_ids[b]) for b in chunk.encode("utf-8", "surrogatepass"))
        n = len(chunk)
        longest: list[str | None] = [None] * n
        for end, (before, piece) in self.automaton.iter(chunk):
            longest[end - before] = piece  # ends only grow, so the last one is the longest
        fits, prefix = self._fits, self.prefix
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[str] = []
        pos, nxt, last = 0, longest[0], None
        while pos < n:
            token = nxt
            while token is not None:
                end = pos + len(token)
                if open_at[end] and (last is None or fits[last, token]):
                    break
                token = prefix[token]
            if token is not None:
                tokens.append(token)
                last, pos = token, end
                nxt = longest[pos] if pos < n else None
            else:
                open_at[pos] = 0
                nxt = tokens.pop()
                last = tokens[-1] if tokens else None
                pos -= len(nxt)
        return ",".join([self.id_text[t] for t in tokens])

    def _encode_word(self, word: str) -> str:
        """A word that follows a space, or a line feed and the word that follows it.  A last sign that no
        merge can take up (most commas and full stops) is set behind the word without it."""
        if len(word) > 1 and word[-2:] not in self.joined and (last := self.id_text.get(word[-1])):
            return f"{self._words[word[:-1]]},{last}"
        if word[:1] == "\n":
            parts = [str(self.byte_ids[10])] if "\n" not in self.chars else []
            rest = word[1:] if parts else word
        else:
            parts, rest = [], MARK + word
        return ",".join([*parts, *map(self._encode_chunk, self.cut.findall(rest))])

    def encode_joined(self, text: str | None) -> str:
        """All ids of a whole text, in decimal, joined by commas."""
        if not text:
            return ""
        if self.dummy_prefix and MARK not in text and "  " not in text and " \n" not in text and text[0] != " ":
            return ",".join(map(self._words.__getitem__, text.replace("\n", " \n").split(" ")))
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        return ",".join(map(self._chunks.__getitem__, self.cut.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> str:
        """The text of ids given in decimal, joined by commas."""
        if not joined:
            return ""
        ids = joined.split(",")
        raw = list(map(self.raw.__getitem__, ids))
        if self.dummy_prefix:
            at = 0
            while at < len(ids) and ids[at] in self.is_control:
                at += 1
            if at < len(ids) and ids[at] in self.is_normal_mark:
                raw[at] = raw[at][1:]
        try:
            return b"".join(raw).decode("utf-8")
        except UnicodeDecodeError:
            pass
        out: list[str] = []
        k = 0
        while k < len(ids):
            if ids[k] in self.is_byte:
                j = k
                while j < len(ids) and ids[j] in self.is_byte:
                    j += 1
                out.append(_lenient(b"".join(raw[k:j])))
                k = j
            else:
                out.append(raw[k].decode("utf-8"))
                k += 1
        return "".join(out)

    def decode(self, ids: list[int] | None) -> str:
        return self.decode_joined(",".join(map(str, ids or [])))


def _lenient(data: bytes) -> str:
    """UTF-8, each byte outside a whole character becoming U+FFFD."""
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode("utf-8"))
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: array<int> of each whole text (null text: empty)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(model_path)
        return texts.map(lambda t: c.encode(t if isinstance(t, str) else None))

    return docs.withColumn(ids_col, ids(F.col(f"`{text_col}`")))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of each id list (null list: empty)."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        c = codec(model_path)
        return lists.map(lambda x: c.decode([] if x is None else list(x)))

    return rows.withColumn(text_col, text(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both: the id,
    n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids themselves.
    One narrow pass: nothing moves between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in (whole.slice(k, 250) for whole in batches for k in range(0, whole.num_rows, 250)):
            n, ids_sha, text_sha, lists = [], [], [], []
            for value in batch.column(1):
                joined = c.encode_joined(value.as_py())
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_joined(joined).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(joined, dtype=np.int32, sep=","))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("_id", id_col)
