"""Token files: exact round trips, partial reads, what a lost attempt leaves, and the query beside the tokenizer itself."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prumo.llm import planes
from prumo.llm.planes import FileReader, FileWriter, ids_of, listed, read_tokens, register, restored, transposed, write_tokens
from prumo.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


class Kept(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("ids", [[0], [1, 2, 3], [2**32 - 1, 0, 77], list(range(300)), [65_536] * 17])
def test_planes_come_back(bits, ids):
    given = np.array(ids, dtype="<u4")
    cut = transposed(given, bits)
    assert len(cut) == (max(1, max(ids).bit_length()) if bits == 1 else max(1, -(-max(ids).bit_length() // 8)))
    assert restored(cut, len(ids), bits).tolist() == ids


@pytest.mark.parametrize("bits", [1, 8])
def test_any_stretch_of_a_file(bits):
    dice = np.random.default_rng(3)
    docs = [dice.integers(0, 2 ** int(dice.integers(1, 33)), int(n), dtype=np.uint64).astype("<u4") for n in dice.integers(0, 900, 60)]
    out = Kept()
    writer = FileWriter(out, bits, chunk=256)
    for n, ids in enumerate(docs):
        writer.add(n if n % 7 else None, ids)
    writer.close()
    whole = np.concatenate(docs)
    reader = FileReader(Kept(out.getvalue()))
    assert reader.docs["count"].tolist() == list(map(len, docs)) and len(reader.chunks) == -(-len(whole) // 256)
    for a, b in [(0, len(whole)), (0, 0), (255, 257), (256, 512), (1000, 1001), (len(whole) - 1, len(whole))]:
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    damaged = bytearray(out.getvalue())
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        FileReader(Kept(bytes(damaged)))


DOCS = [(7, "héllo wörld"), (3, ""), (9, None), (5, "<|endoftext|> again"), (None, "no id"), (4, "x y z " * 60_000), (7, "héllo wörld"), (7, "another")]


def test_remembered_pieces_are_the_librarys(monkeypatch):
    """Random strings of many scripts, and forgetting between them."""
    with open(VOCABULARY, encoding="utf-8") as file:
        blob = file.read()
    monkeypatch.setattr(planes, "REMEMBERED", 500)
    own, other = planes.Encoder(blob, public_tokenizers.PATTERN, 2), planes.Encoder(blob, None, 2)
    dice = random.Random(5)
    letters = " \n\t'  ​　" * 3 + "abcsSTdmlve éßİжЯ中文かカ한019½².,!?-_“”…€" + "\U0001f600́कก٠Ꟁ\U00010d40"
    for _ in range(30):
        texts = ["".join(dice.choice(letters[: dice.choice([8, 60, len(letters)])]) for _ in range(dice.randint(0, 60))) for _ in range(200)]
        assert own.encode([*texts, None]) == other.encode([*texts, None])


def written(spark, tmp_path, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int")
    write_tokens(df, str(tmp_path), VOCABULARY, pattern=public_tokenizers.PATTERN, end=2, **more)
    return sorted(read_tokens(spark, str(tmp_path)).collect(), key=lambda r: r.start)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_documents_in_order_with_nulls_ties_and_long_texts(spark, tmp_path, kind):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    rows = written(spark, tmp_path, DOCS, planes=kind)
    assert [r.doc_id for r in rows] == sorted([d for d, _ in DOCS], key=lambda d: (d is not None, d or 0))
    start, texts = 0, []
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.start == start and ids[-1] == 2
        start += len(ids)
        texts.append((r.doc_id, ids[:-1]))
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in DOCS]
    assert sorted(texts, key=repr) == sorted(want, key=repr)
    part = sorted(read_tokens(spark, str(tmp_path), 10, 60_000).collect(), key=lambda r: r.start)
    whole = b"".join(bytes(r.ids) for r in rows)
    assert b"".join(bytes(r.ids) for r in part) == whole[40:240_000] and part[0].start == 10
    lists = read_tokens(spark, str(tmp_path)).select("start", ids_of("ids").alias("ids")).collect()
    assert sum((r.ids for r in sorted(lists, key=lambda r: r.start)), []) == np.frombuffer(whole, dtype="<u4").tolist()


def test_no_documents(spark, tmp_path):
    assert written(spark, tmp_path / "none", []) == [] and listed(str(tmp_path / "none")) == []


def test_only_committed_files_are_read(spark, tmp_path):
    first = written(spark, tmp_path, DOCS)
    (tmp_path / "part-00000-lost.planes").write_bytes(b"half a file")
    assert len(read_tokens(spark, str(tmp_path)).collect()) == len(first)
    again = written(spark, tmp_path, [(1, "more")])  # appended after what is there
    assert len(again) == len(first) + 1 and again[-1].doc_id == 1 and again[-1].start == sum(len(r.ids) // 4 for r in first)
    register(spark)
    read_tokens(spark, str(tmp_path)).filter("doc_id = 7").select("doc_id", "ids").write.format(planes.FORMAT).mode("overwrite").save(
        str(tmp_path / "sevens")
    )
    assert read_tokens(spark, str(tmp_path / "sevens")).count() == 3


def test_a_failing_task_commits_nothing(spark, tmp_path):
    register(spark)
    df = spark.range(10).selectExpr("id doc_id", "if(id = 9, cast(raise_error('lost') as binary), X'01000000') ids")
    with pytest.raises(Exception, match="lost"):
        df.write.format(planes.FORMAT).mode("append").save(str(tmp_path / "lost"))
    assert read_tokens(spark, str(tmp_path / "lost")).collect() == []
    with pytest.raises(Exception, match="doc_id bigint and ids binary"):
        spark.range(3).write.format(planes.FORMAT).mode("append").save(str(tmp_path / "other"))


def test_hot_id(spark, tmp_path):
    dice = random.Random(1)
    rows = [(1, f"text {dice.random()}") for _ in range(400)] + [(i, "text") for i in range(800)]
    got = written(spark, tmp_path, rows)
    assert len(got) == 1200 and [r.doc_id for r in got] == sorted(r[0] for r in rows)


def test_query_equals_the_tokenizer(spark):
    folder = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    encoded = Tokenizer.from_file(VOCABULARY).encode_batch([t for _, t in docs], add_special_tokens=False)
    start, want = 0, []
    for (doc_id, _), e in zip(docs, encoded):
        ids = [*e.ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_planes"](spark, folder).collect())) == want
