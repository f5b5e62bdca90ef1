"""Byte-level BPE beside the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from prumo.llm.bpe import ByteBPE, Encoder
from prumo.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab cd\n\t\r\x0b\x85\xa0 éÉß漢字½Ⅷ'sS.,!😀_-12"


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return Encoder(file.read(), public_tokenizers.PATTERN)


def test_random_and_long_texts(encoder, other):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "xyz" * 40, "é" * 64, "q" * 64, "q" * 65, " " * 300, "<|endoftext|>", "", "x"]
    assert encoder.encode(texts).to_pylist() == [other.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(encoder, other, monkeypatch):
    monkeypatch.setattr("prumo.llm.bpe.REMEMBERED", 3)
    for text in ("one two three four", "two three", "five one four"):
        assert encoder.encode([text]).to_pylist() == [other.encode_ordinary(text)]


def test_columns(spark, other):
    texts = [None, "", "One two", "One two", "three\n\n four", "😀" * 400]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    bpe = ByteBPE(spark, PATH, public_tokenizers.PATTERN)
    rows = df.select("doc_id", "text", bpe.encode(F.col("text")).alias("found")).select(
        "*", bpe.decode(F.col("found")).alias("back")
    )
    for row in rows.collect():
        assert row.found == other.encode_ordinary(row.text or "")
        assert bytes(row.back) == (row.text or "").encode()
    empty = df.filter("doc_id < 0").select(bpe.encode(F.col("text")).alias("found"))
    assert empty.collect() == []


def test_query(spark, other):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = other.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
