"""Byte-level BPE against the library it has to equal."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import bpe_codec, queries
from tidelog.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, texts):
    got = [[] for _ in texts]
    for k, ids in codec.stream(texts):
        got[k] += ids.tolist()
    for text, ids in zip(texts, got, strict=True):
        assert ids == library.encode(text or "", add_special_tokens=False).ids, (text or "")[:80]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_chosen_texts(codec, library):
    same(codec, library, [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|> ", "<|endoftext", "it's IT'S 'tx ''s  's\n's\t\t x   "])
    same(codec, library, ["aaa aaaa aaaaa" * 50, "ab" * 3333, "\0\x1c\x1d x\x85y\xa0z　", "漢字かな交じり文 12345 ١٢٣ é é ﷺ 👨‍👩‍👧", "\r\n\r\n x\n\n"])


@pytest.mark.parametrize("alphabet", ["ab ", "aA1 .'\n\t", "abcdefghijklmnopqrstuvwxyz ", "é漢  \xa0x'st "])
def test_random_texts(codec, library, alphabet):
    draw = random.Random(alphabet)
    same(codec, library, ["".join(draw.choice(alphabet) for _ in range(draw.randrange(150))) for _ in range(300)])


def test_every_code_point(codec, library):
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    same(codec, library, ["".join(f"a{c}1{c}#{c} {c}" for c in every[k : k + 20_000]) for k in range(0, len(every), 20_000)])


def test_long_texts_in_pieces(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "PIECE_CHARS", 40)
    monkeypatch.setattr(bpe_codec, "BLOCK_WORDS", 30)
    draw = random.Random(5)
    same(codec, library, ["".join(draw.choice("ab' \n<é") for _ in range(2000)) for _ in range(5)] + ["word and  " * 500, "<|endoftext|> x" * 100])


def test_one_very_long_word(codec, library):
    draw = random.Random(6)
    same(codec, library, ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))])


def test_decoding_any_ids(codec, library):
    draw = random.Random(7)
    for _ in range(300):
        ids = [draw.randrange(50_257) for _ in range(draw.randrange(12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(None) == "" and codec.decode([-1, 10**6, 64]) == "a"


def test_files_that_are_not_supported(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "a.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe_codec.ByteCodec(str(tmp_path / "a.json"))


def test_tables(spark, library):
    texts = [None, "", "a b", "a b", "long " * 30_000, "é<|endoftext|>'s"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "y"), (1, "", "again")], "doc_id long, text string, ids string")
    rows = bpe_codec.round_trip(docs, PATH).collect()
    assert len(rows) == 8
    for r in rows:
        text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe_codec.encode(docs, PATH)  # a column of that name is replaced
    assert encoded.columns == ["doc_id", "text", "ids"]
    back = bpe_codec.decode(encoded, PATH, text_col="back").where(F.coalesce("text", F.lit("")) != F.col("back"))
    assert back.count() == 0
    assert bpe_codec.round_trip(docs.limit(0), PATH).count() == 0 and bpe_codec.encode(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, library):
    rows = {r.doc_id: r for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        assert rows[doc.doc_id].n_tokens == len(ids)
        assert rows[doc.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc.doc_id].decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
