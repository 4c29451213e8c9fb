"""Packing: tokens as the tokenizer gives them, gapless sequences, and few of them."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dayspan.llm.packing import Encoder, OpenBins, cut, pack_documents, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", " ", "a", "it's we'll 'tis", "Größe ß ½ x²  y\n\n\n z \t\t ", "\x1c\x1d a\x85b\xa0c", "œuvre – 中文 ᾳ",
                                  " " * 300, "a" * 5000, "_-__ 12ab34 \x00\x7f", "tab\t\tnew\r\nline ", "!!! ??\xad\xb4 ª",
                                  "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|> a\nb <|endoftext|>",
                                  "中文 <|endoftext|> ü", "< |endoftext|> <|endoftext|", "word " * 50 + "<|endoftext|>"])
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)
    assert Encoder(PATH).ids(text) == want


def test_random_latin_texts(tokenizer):
    r, encoder = random.Random(1), Encoder(PATH)
    for _ in range(300):
        text = "".join(chr(r.choice([32, 10, 39, r.randrange(256)])) for _ in range(r.randrange(60)))
        assert encoder.ids(text) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_added_tokens_are_found_anywhere(tokenizer):
    r, encoder = random.Random(2), Encoder(PATH)
    for _ in range(100):
        text = "".join(r.choice(["<|endoftext|>", "a", " ", "\n", "word ", "<|", "endoftext", "|>", "é"]) for _ in range(r.randrange(30)))
        assert encoder.ids(text) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_best_fit_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert [bins.place(n) for n in (7, 8)] == [(2, 0), (3, 0)]  # three open: the one of 8 closes
    assert bins.remaining() == {1: 5, 2: 7}


def check(rows, texts, tokenizer):
    ids = {}
    for doc_id, text in texts:
        ids[doc_id] = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == cut(len(ids[doc_id]), 1024)
        for p in pieces:
            own = ids[doc_id][p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return by_sequence, sum(map(len, ids.values()))


def test_pack_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(40)
    rows = pack_documents(docs, PATH).collect()
    by_sequence, total = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    assert len(by_sequence) <= -(-total // 1024) * 1.02 + 2


def test_edges_and_sequences(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "word " * 3000), (4, "same"), (5, "same"), (-7, "中文")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, piece int, bin string")
    placed = pack_documents(docs, PATH, open_bins=2)
    rows = placed.collect()
    check(rows, texts, tokenizer)
    arrays = {r["sequence_id"]: r["ids"] for r in sequences(docs, placed, PATH).collect()}
    for r in rows:
        own = arrays[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) == r["ids_crc32"]


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
    rows = pack_documents(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], schema), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (1, 2), (1, 2)]
    assert sorted(r["offset"] for r in rows) == [0, 2, 4]
