"""Byte-level BPE encoding and decoding, exactly, by batched merge rounds in numpy.

A text is cut at the file's special tokens and, between them, into words by the usual pattern.
The distinct words of a block become one flat array of byte symbols.  In each round every
word's pair of lowest rank is merged wherever it stands in the word: pairs are keys in a
sorted array that binary search finds, a word's lowest rank is a minimum over its stretch
of the array, and only the pairs beside a merge are looked up again.  Words without a pair
leave the array, so late rounds are small.  Ranks must rise along each piece's history
(checked when the file is read); then all places of the lowest pair may merge at once.

A block holds about 100,000 words, and a longer text goes through in several blocks, so memory
doesn't follow a text's length (only that of a single word).  Nothing is kept between blocks.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
text; repeated rows are encoded each.  Other columns aren't read; an empty table gives an empty
one.  Ids that the file doesn't know are skipped in decoding; bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and numbers that the encoding library's Unicode tables don't know yet.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LETTER, _NUMBER, _OTHER = (rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?{_OTHER}+|\s+(?!\S)|\s+", regex.V1)
#: The same words of a text in ASCII, found several times faster.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

NONE = np.uint32(0xFFFFFFFF)
BLOCK_WORDS, PIECE_CHARS = 100_000, 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in the file: itself if it is printable Latin-1 (and
    no soft hyphen), else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + length], one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]


class ByteCodec:
    """Encoder and decoder for one tokenizer file; made once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files without normaliser and prefix space are supported")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must match as they are written")
        vocab, chars = model["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        born = {m: r for r, m in enumerate(made)}
        if len(born) < len(made) or any(max(born.get(vocab[a], -1), born.get(vocab[b], -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError("ranks must rise along the history of each piece")
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.uint64)
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.uint32), np.array(made, dtype=np.uint32)
        self.special = {t["content"]: t["id"] for t in added if t["content"]}
        longest_first = sorted(self.special, key=lambda x: (-len(x), x))
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if self.special else None
        # decode(): all pieces' bytes in one flat array
        raw = [b""] * (max([*vocab.values(), *self.special.values()], default=-1) + 1)
        for piece, i in vocab.items():
            raw[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        for piece, i in self.special.items():
            raw[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.lengths = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.decimal = [str(i) for i in range(len(raw))]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that don't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words in one flat array, and how many each word has."""
        if not words:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            # One array of the words still open, without gaps; right and left are their neighbours.
            n = len(symbol)
            right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
            alive = np.ones(n, dtype=bool)
            rank = np.full(n, NONE)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
            starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            gone = 0
            while True:
                least = np.minimum.reduceat(rank, starts)
                still_open = least != NONE
                if 4 * gone > n or 2 * np.count_nonzero(still_open) < len(starts):
                    break
                at = np.flatnonzero((rank == least[place]) & (rank != NONE))
                # In a run of equal symbols only every second pair is free.
                chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
                taken = right[at]
                symbol[at] = self.made[rank[at]]
                alive[taken], rank[taken] = False, NONE
                after = right[taken]
                right[at] = after
                inside = after < n
                left[after[inside]] = at[inside]
                gone += len(at)
                # Pairs beside a merge: with what follows it, and with what stands before it.
                first = np.unique(np.concatenate([at, left[at]]))
                first = first[first >= 0]
                second = right[first]
                ok = second < n
                ok[ok] = word[first[ok]] == word[second[ok]]
                rank[first] = NONE
                rank[first[ok]] = self._rank(symbol[first[ok]], symbol[second[ok]])
            closed = alive & ~still_open[place]
            done.append((word[closed], symbol[closed]))
            stay = alive & still_open[place]
            word, symbol = word[stay], symbol[stay]
        owner = np.concatenate([w for w, _ in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(owner, minlength=len(words))

    def _ids(self, words: list[str], text_starts: list[int]) -> list[np.ndarray]:
        """The ids of each text, given all texts' words and where each text's words start."""
        index: dict[str, int] = {}
        code = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
        names = list(index)
        special = {index[t]: i for t, i in self.special.items() if t in index}
        flat, counts = self.merge([b"\0" if k in special else w.encode("utf-8", "surrogatepass") for k, w in enumerate(names)])
        starts = np.cumsum(counts) - counts
        for k, i in special.items():
            flat[starts[k]] = i
        ids, per_word = gathered(flat, starts[code], counts[code]), np.concatenate([[0], np.cumsum(counts[code])])
        bounds = per_word[np.array([*text_starts, len(words)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The text's words and special tokens, a bounded piece at a time: a word ends wherever a
        space follows another character than white space."""
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield [part]
                continue
            at = 0
            while at < len(part):
                end = part.find(" ", at + PIECE_CHARS)
                while 0 < end < len(part) and part[end - 1].isspace():
                    end = part.find(" ", end + 1)
                end = len(part) if end < 0 else end
                piece = part[at:end]
                yield (ASCII_WORDS if piece.isascii() else WORDS).findall(piece)
                at = end

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids): every text's ids in order, in one part or several; a text without
        words has none."""
        words: list[str] = []
        owners: list[int] = []
        starts: list[int] = []
        for k, text in enumerate(texts):
            for piece in self._pieces(text) if text else ():
                owners.append(k)
                starts.append(len(words))
                words += piece
                if len(words) >= BLOCK_WORDS:
                    yield from zip(owners, self._ids(words, starts), strict=True)
                    words, owners, starts = [], [], []
        if owners:
            yield from zip(owners, self._ids(words, starts), strict=True)

    def encode(self, text: str | None) -> np.ndarray:
        parts = [ids for _, ids in self.stream([text])]
        return np.concatenate(parts).astype(np.int32) if parts else np.empty(0, dtype=np.int32)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        return gathered(self.flat, self.starts[ids], self.lengths[ids]).tobytes()

    def decode(self, ids: np.ndarray | list[int] | None) -> str:
        return self.bytes_of(np.array([] if ids is None else ids, dtype=np.int64)).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


_CODECS: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that results leave the worker early."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: array<int> of each whole text (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            lists: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for k, ids in c.stream(x.as_py() for x in batch.column(batch.num_columns - 1)):
                lists[k].append(ids)
            column = pa.array([np.concatenate(x).astype(np.int32) if x else np.empty(0, dtype=np.int32) for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "_ids"])

    return _mapped(docs, docs[f"`{text_col}`"], run, ids_col, "array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of each id list (null list: empty; null ids are skipped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            texts = [c.decode([i for i in x.as_py() or () if i is not None]) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "_ids"])

    return _mapped(rows, rows[f"`{ids_col}`"], run, text_col, "string")


def _mapped(df: DataFrame, column, run, name: str, kind: str) -> DataFrame:
    """``df`` with column ``name`` that ``run`` makes of ``column``; a column of that name is replaced."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    columns = [df[f"`{c}`"].alias(f"_c{k}") for k, c in enumerate(kept)]
    schema = ", ".join([*(f"_c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)), f"_ids {kind}"])
    out = df.select(*columns, column.alias("_value")).mapInArrow(run, schema)
    return out.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)), F.col("_ids").alias(name))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both: the id, n_tokens,
    ids_sha256 and decoded_sha256.  One narrow pass: nothing moves between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            n = [0] * batch.num_rows
            ids_sha, text_sha = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
            for k, ids in c.stream(x.as_py() for x in batch.column(1)):
                if len(ids):
                    ids_sha[k].update(("," * bool(n[k]) + c.joined(ids)).encode())
                    text_sha[k].update(c.decode(ids).encode("utf-8"))
                    n[k] += len(ids)
            digests = [pa.array([h.hexdigest() for h in x], pa.string()) for x in (ids_sha, text_sha)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *digests], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
