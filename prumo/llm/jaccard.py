"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct word n-grams, as 64-bit hashes. All sets are put in one order: frequent
n-grams last, otherwise by hash. With similarity t, two linked sets share an n-gram among the first
p = n - ⌈t·n⌉ + 1 of each, so only those are looked up.

Adaptive: a set that would meet many others there (the sum of its n-grams' other occurrences is the estimated cost)
takes a prefix longer by up to LONGER n-grams, and must then share correspondingly more of them: whatever two sets share
beyond the shorter-reaching prefix is at most what is left of that set, so at least
α - max(n_x - P_x, n_y - P_y) must be shared within prefixes of lengths P, where α is the overlap that t demands. Only pairs
that do are verified on their whole sets.

Groups: equal sets are one node. Each looked-up n-gram names one of its nodes as hub (the one with most frequent n-grams,
then the smallest); nodes are first verified against their hubs only, which joins groups of near copies without making
all their pairs. Pairs are made afterwards only between nodes of different components, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.llm.common import forget_made, named, small_batches
from prumo.session import materialize

LONGER = 16
WINDOW = 2_000_000  # n-grams counted together when frequent ones are sought
OFTEN = 3  # times in one window that make an n-gram worth counting
FREQUENT = 64  # counted times that make it frequent
MOST_FREQUENT = 1 << 18  # frequent n-grams kept: 2 MB for each task
BITS_EACH = 16  # bits of the filter on ids for each id that needs its whole set: one text in 16 comes along for nothing
MOST_BITS = 1 << 27  # of that filter: 16 MB, enough for 8 million ids; more of them meet the texts in a join

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def ngram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, one without words none."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        whole = xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))
        return np.array([whole], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    count = len(found) - words + 1
    grams = np.zeros(count, dtype=np.uint64)
    for i in range(words):  # a polynomial in an odd number, mixed at each step
        grams = (grams ^ each[i : i + count]) * ODD[0]
        grams ^= grams >> np.uint64(29)
    grams *= ODD[1]
    grams ^= grams >> np.uint64(32)
    grams *= ODD[2]
    grams ^= grams >> np.uint64(31)
    return np.unique(grams)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def frequent_ngrams(texts: DataFrame, words: int) -> np.ndarray:
    """N-grams in many texts, sorted: lossy counting over windows of all texts.

    Which n-grams count as frequent decides their place in the order and so the work, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_made()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            columns = [pa.array(grams[often].view(np.int64)), pa.array(times[often].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["gram", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(ngram_set(text, words))
                size += len(held[-1])
                if size >= WINDOW:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counted = texts.select("text").mapInArrow(count, "gram long, times long").groupBy("gram")
    kept = (
        counted.agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= FREQUENT)
        .orderBy(F.col("times").desc(), "gram")
        .limit(MOST_FREQUENT)
        .select("gram")
    )
    return np.sort(kept.toPandas()["gram"].to_numpy(dtype=np.int64).view(np.uint64))


def signatures(texts: DataFrame, words: int, similarity: Fraction, frequent: np.ndarray) -> DataFrame:
    """For each (id, text): n, rare (n-grams that are not frequent), two digests of the set, and the first n-grams in order,
    LONGER - 1 more than the prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_made()
        often = shared.value
        for batch in batches:
            n, rare, one, two, first = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = ngram_set(text, words)
                place = np.minimum(np.searchsorted(often, grams), max(0, len(often) - 1))
                last = often[place] == grams if len(often) else np.zeros(len(grams), dtype=bool)
                n.append(len(grams))
                rare.append(len(grams) - int(last.sum()))
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                one.append(int.from_bytes(digest[:8], "little", signed=True))
                two.append(int.from_bytes(digest[8:], "little", signed=True))
                reach = len(grams) - ceil(similarity * len(grams)) + LONGER
                first.append(np.concatenate([grams[~last][:reach], grams[last]])[:reach])
            longs = [pa.array(x, pa.int64()) for x in (n, rare, one, two)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, _lists(first)], ["id", "n", "rare", "one", "two", "first"]
            )

    return texts.select("id", "text").mapInArrow(
        sign, "id long, n long, rare long, one long, two long, first array<long>"
    )


def filter_bits(count: int) -> int:
    """Bits of the filter for so many ids, a power of two from 2^15; 0 where a join must do."""
    bits = max(1 << 15, 1 << (max(1, count * BITS_EACH) - 1).bit_length())
    return bits if bits <= MOST_BITS else 0


def whole_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, grams) for at least the ids of column `id`, which are distinct.

    A bitmap of hashed ids, sized by their count, goes to the tasks, so that no text is shuffled; a few texts that
    merely share a bit come along. Where the bitmap would be too large, ids and texts are joined.
    """
    size = filter_bits(ids.count())
    if size:
        slot = F.pmod(F.xxhash64("id"), F.lit(size)).cast("long")
        width = 32768  # bits in one of Spark's bitmaps
        parts = (
            ids.select(slot.alias("slot"))
            .groupBy(F.floor(F.col("slot") / width).alias("part"))
            .agg(F.bitmap_construct_agg(F.col("slot") % width).alias("bits"))
            .collect()
        )
        bitmap = np.zeros(size // 8, dtype=np.uint8)
        for part in parts:
            bitmap[part["part"] * width // 8 : (part["part"] + 1) * width // 8] = np.frombuffer(part["bits"], dtype=np.uint8)
        asked = texts.select("id", slot.alias("slot"), "text")
    else:
        bitmap = np.array([1], dtype=np.uint8)  # all that the join lets through
        asked = texts.join(ids, "id", "left_semi").select("id", F.lit(0).cast("long").alias("slot"), "text")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_made()
        bits = shared.value
        for batch in batches:
            slots = batch.column(1).to_numpy()
            wanted = np.flatnonzero(bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            if len(wanted):
                chosen = batch.take(pa.array(wanted))
                grams = [ngram_set(text, words) for text in chosen.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([chosen.column(0), _lists(grams)], ["id", "grams"])

    return asked.mapInArrow(build, "id long, grams array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected `edges` (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn until nothing changes; each step's edges are written, so lineage stays short.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _ceil(value: Column) -> Column:
    return F.ceil(value).cast("long")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The linked ones of the pairs (a, b): first by what their prefixes share, then on whole sets."""
    up, down = similarity.numerator, similarity.denominator
    sides = [
        nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"p_{s}")) for s in "ab"
    ]
    likely = pairs.join(sides[0], "a").join(sides[1], "b")
    least = _ceil(up * (F.col("n_a") + F.col("n_b")) / F.lit(up + down))
    left = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    likely = likely.filter(F.size(F.array_intersect("p_a", "p_b")) >= least - left).select("a", "b")
    likely = materialize(likely, "likely-pairs")
    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    ids = materialize(ids, "ids-of-pairs")
    sets = materialize(whole_sets(texts, ids, words), "whole-sets")
    sides = [sets.select(F.col("id").alias(s), F.col("grams").alias(f"g_{s}")) for s in "ab"]
    both = likely.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("g_a", "g_b"))
    either = F.size("g_a") + F.size("g_b") - common
    return materialize(both.filter(down * common >= up * either).select("a", "b").distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    similarity: Fraction = Fraction(4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component) for every row: the smallest id reachable by links of Jaccard similarity or more.

    Words are runs of characters other than ASCII white space, A-Z taken as a-z. A text with fewer than `words`
    words is one n-gram; a null, empty or blank text has none and links with nothing, so its component is its own
    id. Rows with one id count as one document: they share their links and their component. A null id cannot name a
    component: such a row gets the component of an equal text that has an id, else null, and links with nothing else. Give rows a
    number as their id where null ids are documents. Only the two named columns are read. An empty table gives an empty result.
    """
    docs = small_batches(docs)
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    signed = signatures(texts, words, similarity, frequent_ngrams(texts, words))
    signed = materialize(signed, "signatures")
    nodes = (
        signed.filter("n > 0 AND id IS NOT NULL")
        .groupBy("one", "two")
        .agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "rare", "first")])
    )
    nodes = materialize(nodes, "nodes")
    names = nodes.select("one", "two", "node")
    up, down = similarity.numerator, similarity.denominator
    short = F.col("n") - _ceil(up * F.col("n") / F.lit(down)) + 1
    looked = nodes.select("node", "n", "rare", F.posexplode(F.slice("first", F.lit(1), short.cast("int"))).alias("at", "gram"))
    shared = looked.groupBy("gram").agg(F.count("*").alias("texts")).filter("texts > 1")
    posts = materialize(looked.join(shared, "gram"), "shared-ngrams")

    # The prefix grows by two n-grams with every doubling of the estimated candidates.
    cost = posts.groupBy("node").agg(F.sum(F.col("texts") - 1).alias("cost"))
    longer = F.least(F.lit(LONGER - 1), 2 * F.ceil(F.log2(F.col("cost") + 1)))
    nodes = nodes.join(cost, "node").select(
        "node", "n", F.slice("first", F.lit(1), (short + longer).cast("int")).alias("prefix")
    )
    nodes = materialize(nodes, "prefixes")

    hubs = posts.groupBy("gram").agg(F.min(F.struct("rare", "n", "node")).alias("hub"))
    to_hub = posts.join(hubs, "gram").select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"), "n", "hub.n"
    )
    to_hub = to_hub.toDF("a", "b", "n", "m").filter(
        (F.col("a") < F.col("b")) & (down * F.least("n", "m") >= up * F.greatest("n", "m"))
    )
    to_hub = materialize(to_hub.select("a", "b").distinct(), "hub-pairs")
    links = _links(to_hub, nodes, texts, words, similarity)
    found = materialize(components(links), "first-components")

    # Pairs of different components that share a looked-up n-gram: the shorter one has it so early that enough may follow.
    placed = posts.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    placed = placed.select("gram", "node", "n", "at", "group")
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    open_ = placed.join(mixed.select("gram"), "gram", "left_semi")
    early = F.col("at") <= F.col("n") - _ceil(2 * up * F.col("n") / F.lit(up + down))
    one = open_.filter(early).toDF("gram", "x", "n_x", "at_x", "group_x")
    two = open_.toDF("gram", "y", "n_y", "at_y", "group_y")
    least = _ceil(up * (F.col("n_x") + F.col("n_y")) / F.lit(up + down))
    pairs = (
        one.join(two, "gram")
        .filter(
            (F.col("group_x") != F.col("group_y"))
            & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))))
            & (down * F.col("n_x") >= up * F.col("n_y"))
            & (F.col("at_x") <= F.col("n_x") - least)
            & (F.col("at_y") <= F.col("n_y") - least)
        )
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
        .join(to_hub, ["a", "b"], "left_anti")
    )
    pairs = materialize(pairs, "cross-pairs")
    more = _links(pairs, nodes, texts, words, similarity)
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
    members = signed.filter("n > 0 AND id IS NOT NULL").select("id", "one", "two").join(names, ["one", "two"])
    several = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("id", "a")
    one_id = members.join(several, "id").select("a", F.col("node").alias("b")).filter("a <> b")
    groups = components(stars.unionByName(more).unionByName(one_id))
    named_sets = names.join(groups, "node", "left").select("one", "two", F.coalesce("component", "node").alias("component"))
    out = signed.join(named_sets, ["one", "two"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
