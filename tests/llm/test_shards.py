"""Rendezvous sharding: what moves, slots, and the cases at the edge."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from prumo.llm.queries import QUERIES
from prumo.llm.shards import rendezvous, shard, sharded_rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shard int")


ROWS = [(i, f"text {i}") for i in range(2000)] + [(5, "text 5"), (5, "other"), (None, None), (None, ""), (6, None)]


def test_slots_sizes_and_growth(spark):
    rows = shard(table(spark, ROWS), [1.0] * 8).collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.05 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.18
    given = Counter((i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t in ROWS)
    assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == given
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


def test_weights(spark):
    counts = Counter(r[0] for r in spark.range(20000).select(rendezvous(F.col("id"), [1.0, 2.0, 1.0])).collect())
    assert 0.45 < counts[1] / 20000 < 0.55 and 0.2 < counts[0] / 20000 < 0.3


def test_removed_shard_moves_only_its_own(spark):
    both = spark.range(5000).select(
        rendezvous(F.col("id"), [1.0, 1.0, 1.0, 1.0]).alias("a"), rendezvous(F.col("id"), [1.0, 1.0, 1.0]).alias("b")
    )
    assert both.filter("a <> 3 AND a <> b").count() == 0


def test_rows_and_empty_table(spark):
    df = table(spark, ROWS)
    assert sharded_rows(df, [1.0, 1.0]).select("row.*").columns == df.columns
    assert shard(df.filter("false"), [1.0]).collect() == []


def test_query_is_stable(spark):
    folder = "/root/testdata/sf0.001"
    first, again = (sorted(map(tuple, QUERIES["op5_rendezvous_shards"](spark, folder).collect())) for _ in "ab")
    assert first == again and {r[3] for r in first} == {"key"} and len(first) == 200


def plain_shard(key, weights):
    """The least waiting time, worked out without Spark."""
    import math
    import struct

    import xxhash

    def score(i, w):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.encode(), seed=42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11
        return -math.log((bits + 0.5) * 2.0**-53) / w

    return min(range(len(weights)), key=lambda i: (score(i, weights[i]), i))


def test_query_against_a_plain_version(spark):
    """Every shard recomputed, sizes and checksums from the texts, and slots as a gapless numbering of each shard."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op5_rendezvous_shards"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.shard == plain_shard(str(r.doc_id), [1.0] * 24) and r.grown_shard == plain_shard(str(r.doc_id), [1.0] * 25)
        assert r.size == 8 + len((text or "").encode()) and r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
    for shard_ in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard_)
        assert slots == list(range(len(slots)))


def test_a_third_of_the_rows_on_one_id(spark):
    rows = [(7, f"text {i}") for i in range(1000)] + [(i, "text") for i in range(2000)] + [(None, "t")] * 50
    out = shard(table(spark, rows), [1.0, 2.0, 1.0]).collect()
    assert len(out) == len(rows) and len({r.shard for r in out if r.id == 7}) == 1
    for r in out[::50]:
        assert r.shard == plain_shard(None if r.id is None else str(r.id), [1.0, 2.0, 1.0])
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
