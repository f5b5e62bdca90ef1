"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within its source the rows lie in key order; distributed prefix
sums of the sizes say where in that order a row begins, and each source is cut at its exact budget.
A budget above the source's size takes whole epochs first, then the same order again.

A hot source is spread over BUCKETS ranges of the key: sums per (source, range) are taken first, so
only those sums are put in one sequence per source and never the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.llm.common import named, numbered_ranges, row_of
from prumo.session import materialize

# Key ranges per source: the first three hexadecimal digits of the key.
DIGITS = 3
BUCKETS = 16**DIGITS


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")))
    return docs.select(
        row_of(docs).alias("row"),
        named(id_col).alias("id"),
        # A null source is a source of its own; the sign keeps it apart from an empty name.
        F.coalesce(F.concat(F.lit("="), named(source_col)), F.lit("")).alias("group"),
        word_count(named(text_col)).alias("size"),
        key.alias("key"),
        F.substring(key, 1, DIGITS).alias("bucket"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets per source from (group, source_size).

    Sources in code point order, null last, take the weights in turn. A budget of `share` of all
    sizes is dealt by weight; what exceeds `most` times a source's size is dealt again among the others until
    none is above. That ends at one level λ with target = min(most·size, λ·weight): with sources
    ordered by most·size/weight, the first whose ratio reaches the level left by those before it fixes λ.
    """
    ranked = numbered_ranges(sizes.withColumn("last", F.col("group") == ""), ["last", "group"])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(
        "group",
        "source_size",
        F.get(turn, (F.col("place") % len(weights)).cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("limit"),
    ).withColumn("ratio", F.col("limit") / F.col("weight"))
    ranked = materialize(numbered_ranges(ranked, ["ratio", "group"], ["limit", "weight"]), "levels")
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = 0.0
    if whole["size"]:
        left = F.lit(share * whole["size"]) - F.col("limit_before")
        level_here = left / (F.lit(whole["weight"]) - F.col("weight_before"))
        first = (
            ranked.select("place", "ratio", level_here.alias("level"))
            .filter(F.col("ratio") >= F.col("level"))
            .orderBy("place")
            .first()
        )
        level = first["level"]
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return ranked.select("group", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Each row of `docs` as struct `row`, with id, size, source_size, target and taken.

    `taken` counts the words that the mix takes from the row, repeats counted: as many whole epochs as
    fit the source's budget (its target, rounded to whole words), then the rows in key order up to the
    exact word, so at most one row per source is cut. `share` must be below `most`. A null text has no words and
    is not taken; a null id is a key like any other; repeated rows are rows of their own, ordered by
    size, and equal ones share out the same result. An empty table gives an empty result. Only the three named columns matter;
    others travel inside `row`, so they cannot clash.
    """
    if share > most:
        raise ValueError("share must not exceed most: the budget could not be placed")
    keyed = _keyed(docs, id_col, text_col, source_col)
    sums = materialize(keyed.groupBy("group", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    targets = source_targets(
        sums.groupBy("group").agg(F.sum("words").alias("source_size")), weights, share, most
    )
    earlier = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "group", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")
    ).join(targets, "group")
    before = (
        Window.partitionBy("group", "bucket")
        .orderBy("key", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.join(starts, ["group", "bucket"]).withColumn(
        "at", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0))
    )
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return placed.select(
        "row",
        "id",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + cut).cast("long").alias("taken"),
    )


def mixed_documents(mixed: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of a mix: one per epoch a row is taken in, with the columns of the mixed table.

    The one row per source where the budget ends keeps the words up to the cut, and its length column
    (where there is one) says so. Rows of which nothing is taken are left out.
    """
    fields = mixed.schema["row"].dataType.fieldNames()
    rows = mixed.filter(F.col("taken") > 0).withColumn(
        "words",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1),
                lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")),
            )
        ),
    )
    text = F.col("row")[text_col]
    # Words with the white space before them, so that what is kept stands as it was.
    steps = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), 0)
    first = F.array_join(F.slice(steps, F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("kept", F.when(F.col("words") < F.col("size"), first).otherwise(text))
    out = []
    for name in fields:
        if name == text_col:
            out.append(F.col("kept").alias(name))
        elif name == length_col:
            out.append(
                F.when(F.col("words") < F.col("size"), F.length("kept").cast("long"))
                .otherwise(F.col("row")[name])
                .alias(name)
            )
        else:
            out.append(F.col("row")[name].alias(name))
    return rows.select(*out)
