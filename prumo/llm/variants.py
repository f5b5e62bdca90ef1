"""Spelling variants: words one letter apart, grouped under the form that is written far more often.

The words make a trie, their reversals another one, and the nodes of both are numbered. A word without its letter i is then two
integers: the node of what stands before the letter and the node of what stands after it, however long the word. Two
words with one such pair differ in that letter alone; a pair that equals the two nodes around a position of another word is that word
with a letter inserted there. So neighbours are found exactly, by joining pairs of integers.

A trie is numbered in sorted order: a word's prefix is a new node unless the word before shares it. Words are sorted in ranges,
each numbers its own trie, and what a range shares with the word before its first is renumbered, which needs two words a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.llm.common import named
from prumo.session import materialize

RANGE = 33  # bits for a row's place in its range


def shared_prefix(a: str, b: str) -> int:
    """How many letters two words have in common at their beginning."""
    if b.startswith(a):
        return len(a)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted (letters, …) the range, `place` and `nodes`: the numbers, in the trie of this range, of a word's
    prefixes of length 0, 1, …; those of its first word are 0, 1, …"""
    part = TaskContext.get().partitionId()
    before, nodes, count, row = "", [0], 1, 0
    for batch in batches:
        found = []
        for word in batch.column("letters").to_pylist():
            same = shared_prefix(before, word)
            nodes = nodes[: same + 1] + list(range(count, count + len(word) - same))
            count += len(word) - same
            before = word
            found.append(nodes)
        rows = batch.num_rows
        places = pa.array(range((part << RANGE) + row, (part << RANGE) + row + rows), pa.int64())
        row += rows
        added = [pa.array([part] * rows, pa.int32()), places, pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "place", "nodes"])


def trie(words: DataFrame, name: str) -> DataFrame:
    """`words(letters, …)`, distinct letters, plus `place` (ascending in code-point order) and `nodes`: for each length from 0
    the number of the node that stands for that prefix. Equal prefixes have equal numbers, others do not.

    The driver sees the first and the last word of each range, no more.
    """
    spark = words.sparkSession
    added = (("part", T.IntegerType()), ("place", T.LongType()), ("nodes", T.ArrayType(T.LongType())))
    schema = T.StructType([*words.schema.fields, *[T.StructField(*a) for a in added]])
    ordered = words.repartitionByRange("letters").sortWithinPartitions("letters")
    own = materialize(ordered.mapInArrow(_numbered, schema), name)
    edges = own.groupBy("part").agg(
        F.min("letters").alias("first"),
        F.max("letters").alias("last"),
        F.max_by("nodes", "place").alias("nodes"),
        F.max(F.array_max("nodes")).alias("greatest"),
    )
    shifts, base, last, way = [], 0, "", [0]
    for edge in sorted(edges.collect(), key=lambda e: e["part"]):
        spine = way[: shared_prefix(last, edge["first"]) + 1]  # these nodes are in an earlier range
        shifts.append((edge["part"], base, spine))
        last = edge["last"]
        way = [spine[x] if x < len(spine) else base + x for x in edge["nodes"]]
        base += edge["greatest"] + 1
    moved = spark.createDataFrame(shifts, "part int, base bigint, spine array<bigint>")
    number = F.transform(
        "nodes", lambda x: F.when(x < F.size("spine"), F.get("spine", x.cast("int"))).otherwise(F.col("base") + x)
    )
    return own.join(moved, "part").withColumn("nodes", number).drop("part", "base", "spine")


def pairs(words: DataFrame) -> DataFrame:
    """Of `words(id, letters, ahead, behind, n)`, with the trie nodes of prefixes and of suffixes by length: a row (p, s, id, n,
    whole, first) per letter skipped and per place where one could be inserted (`whole`).

    `first`: the letter is not that before it. In a run of equal letters dropping any gives one word, so only the first counts.
    """
    size = F.length("letters")
    letter = lambda i: F.substring("letters", i + 1, F.lit(1))
    skipped = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("ahead", i).alias("p"),
            F.get("behind", size - 1 - i).alias("s"),
            F.lit(False).alias("whole"),
            ((i == 0) | (letter(i) != letter(i - 1))).alias("first"),
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.get("ahead", i).alias("p"),
            F.get("behind", size - i).alias("s"),
            F.lit(True).alias("whole"),
            F.lit(False).alias("first"),
        ),
    )
    return words.select("id", "n", F.inline(F.concat(skipped, whole)))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words of `words` that have neighbours: how many, and the one of greatest n, of equal ones that of
    least id, as struct<n, behind: -id>.

    The words with one pair are spellings of one place: at most one for each letter of the alphabet, and the
    one word without it. Pairs meet in one shuffle, where each word sees how many others there are and which is the best; no two words are paired up.
    """
    group = Window.partitionBy("p", "s").orderBy("whole", F.col("n").desc(), "id")
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("n", (-F.col("id")).alias("behind"))
    seen = pairs(words).select(
        "id",
        "whole",
        "first",
        F.count_if(~F.col("whole")).over(every).alias("others"),
        F.count_if("first").over(every).alias("longer"),
        F.max(F.when(~F.col("whole"), me)).over(every).alias("top"),
        F.max(F.when(F.col("first"), me)).over(every).alias("top_longer"),
        F.max(F.when(F.col("whole"), me)).over(every).alias("shorter"),
        F.lead(F.when(~F.col("whole"), me)).over(group).alias("next"),
        me.alias("me"),
    )
    shorter = F.when(F.col("first"), F.col("shorter"))
    other = F.when(F.col("top") == F.col("me"), F.col("next")).otherwise(F.col("top"))
    near = F.when(F.col("whole"), F.col("longer")).otherwise(F.col("others") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(F.col("whole"), F.col("top_longer")).otherwise(F.greatest(other, shorter))
    found = seen.select("id", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = 10, *, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. `form` is the near word of
    greatest n, of equal ones the first by code points, where that n is at least `ratio` (2 or more) times the word's own;
    `root` is where forms lead, the word itself without one. Null words are left out, repeated ones count together; an empty
    word is a word; length does not matter, since a word is as many pairs as letters. An empty table gives no rows. Other columns do not get in the way.
    """
    counted = words.select(named(word_col).alias("letters"), named(n_col).cast("long").alias("n")).filter("letters IS NOT NULL")
    counted = counted.groupBy("letters").agg(F.sum("n").alias("n"))
    ahead = materialize(trie(counted, "variant-words").withColumnsRenamed({"place": "id", "nodes": "ahead"}), "variants-ahead")
    behind = trie(ahead.select(F.reverse("letters").alias("letters"), "id"), "variant-reversals")
    behind = behind.select("id", F.col("nodes").alias("behind"))
    near = materialize(neighbours(ahead.join(behind, "id")), "variant-neighbours")
    judged = ahead.select("id", "n").join(near, "id").filter(F.col("best.n") >= ratio * F.col("n"))
    links = materialize(judged.select("id", (-F.col("best.behind")).alias("to"), F.col("best.n").alias("form_n")), "variant-links")
    names = ahead.select("id", "letters")
    out = (
        ahead.select("id", "letters", "n")
        .join(near.select("id", "n_near"), "id", "left")
        .join(links, "id", "left")
        .join(_last(links.select("id", F.col("to").alias("root"))), "id", "left")
        .join(names.select(F.col("id").alias("to"), F.col("letters").alias("form")), "to", "left")
        .join(names.select(F.col("id").alias("root"), F.col("letters").alias("end")), "root", "left")
    )
    return out.select(
        F.col("letters").alias("word"),
        "form",
        F.coalesce("end", "letters").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        "form_n",
    )


def _last(links: DataFrame) -> DataFrame:
    """(id, root) with root followed to its last. A form has a multiple of its word's n, so chains are short and end; each
    round doubles the steps taken."""
    while True:
        further = links.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        links = materialize(links.join(further, "root", "left"), "variant-roots")
        if links.filter("_next IS NOT NULL").isEmpty():
            return links.select("id", "root")
        links = links.select("id", F.coalesce("_next", "root").alias("root"))
