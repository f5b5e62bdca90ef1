"""Time rules over arrivals: admission windows, even pacing, daily caps, sweep plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import CLIENT_MAX, CLIENT_WINDOW_SECONDS, DAILY_CAP
from prumo.operators.grouping import BLOCK, number_rows, running_max
from prumo.session import materialize

SECOND = 1_000_000


# Arrivals of a key are kept in rows of PIECE times; RUN consecutive rows are folded by one task.
PIECE, RUN = 2048, 4096


def admit_piece(times, held: list[int], most: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Admit from sorted times (µs), given the admitted times still held. Jumps over denied
    arrivals, so the cost follows the admitted ones."""
    flags = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        now = int(times[i])
        held = [h for h in held if now - h <= window_us]
        if len(held) < most:
            flags[i] = True
            held.append(now)
            i += 1
        else:
            i = int(np.searchsorted(times, held[0] + window_us, side="right"))
    return flags.tolist(), held


def admit(
    events: DataFrame,
    key: str,
    at_us: str,
    tie: str,
    most: int = CLIENT_MAX,
    window_seconds: int = CLIENT_WINDOW_SECONDS,
    piece: int = PIECE,
    run: int = RUN,
) -> DataFrame:
    """Sliding-window admission per key: `admitted` if fewer than `most` admitted arrivals lie
    within the window; one exactly as old as the window still counts. Times and ties are not null; a null key is one key.

    The rule is sequential per key, but a key's arrivals are cut into runs that are folded side
    by side, streaming piece by piece. Each run first assumes nothing is held; then the runs
    whose predecessor hands over something else are folded again, until nothing changes, which
    is the sequential result. A quiet window between runs ends a chain of corrections, so the
    rounds are bounded by the runs of the longest stretch of one key without one.
    """
    window_us = window_seconds * SECOND
    nothing = F.array().cast("array<bigint>")
    # A null key is a key like any other, also in joins.
    events = events.withColumn("_who", F.to_json(F.struct(key)))
    key = "_who"
    numbered = number_rows(events, [key], [F.col(at_us).asc(), F.col(tie).asc()], "_n")
    at = F.floor((F.col("_n") - 1) / piece)
    pieces = materialize(
        numbered.groupBy(key, F.floor(at / run).alias("_run"), at.alias("_piece"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(at_us).alias("t"), F.col(tie).alias("tie")))).alias("rows"))
        .select(key, "_run", "_piece", F.col("rows.t").alias("times"), F.col("rows.tie").alias("ties")),
        "admission-pieces",
    )

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_run, held = None, []
        for frame in frames:
            out = []
            for k, r, p, times, given in zip(frame[key], frame["_run"], frame["_piece"], frame["times"], frame["given"]):
                if (k, r) != at_run:
                    at_run, held = (k, r), list(given)
                flags, held = admit_piece(np.asarray(times), held, most, window_us)
                out.append((k, r, p, flags, list(held)))
            yield pd.DataFrame(out, columns=[key, "_run", "_piece", "flags", "held"])

    schema = T.StructType(
        [pieces.schema[key], pieces.schema["_run"], pieces.schema["_piece"]]
        + [T.StructField("flags", T.ArrayType(T.BooleanType())), T.StructField("held", T.ArrayType(T.LongType()))]
    )

    def fold(df: DataFrame) -> DataFrame:
        return (
            df.select(key, "_run", "_piece", "times", "given")
            .repartition(key, "_run")
            .sortWithinPartitions(key, "_run", "_piece")
            .mapInPandas(stream, schema)
        )

    begins = pieces.groupBy(key, "_run").agg(F.min(F.col("times")[0]).alias("first"))
    given = begins.select(key, "_run", nothing.alias("given"))
    folded = materialize(fold(pieces.withColumn("given", nothing)), "admission")
    while True:
        handed = folded.groupBy(key, "_run").agg(F.max(F.struct("_piece", "held"))["held"].alias("offer"))
        offers = handed.select(key, (F.col("_run") + 1).alias("_run"), "offer").join(begins, [key, "_run"]).select(
            key, "_run", F.filter("offer", lambda h: F.col("first") - h <= window_us).alias("offer")
        )
        told = materialize(
            given.join(offers, [key, "_run"], "left").select(
                key, "_run", F.coalesce("offer", nothing).alias("given"),
                (F.coalesce("offer", nothing) != F.col("given")).alias("stale"),
            ),
            "admission-offers",
        )
        stale = told.where("stale").select(key, "_run", "given")
        if stale.isEmpty():
            break
        given = told.select(key, "_run", "given")
        folded = materialize(
            folded.join(stale.select(key, "_run"), [key, "_run"], "left_anti").unionByName(
                fold(pieces.join(stale, [key, "_run"]))
            ),
            "admission",
        )
    flagged = pieces.join(folded, [key, "_run", "_piece"]).select(
        key, F.inline(F.arrays_zip(F.col("ties").alias(tie), F.col("flags").alias("admitted")))
    )
    return events.join(flagged, [key, tie]).drop(key)


def pace(events: DataFrame, key: str, at_us: str, tie: str, interval_us: int) -> DataFrame:
    """Even pacing: start_i = max(arrival_i, start_(i-1) + interval), no debt after idling.

    Closed form: i·interval + the running maximum of arrival_j − j·interval.
    """
    order = [F.col(at_us).asc(), F.col(tie).asc()]
    numbered = number_rows(events, [key], order, "_n")
    numbered = materialize(numbered, "arrivals")
    slack = F.col(at_us) - F.col("_n") * F.lit(interval_us).cast("long")
    return (
        running_max(numbered, [key], "_n", slack, "_slack", BLOCK)
        .withColumn("start_us", F.col("_slack") + F.col("_n") * F.lit(interval_us).cast("long"))
        .drop("_n", "_slack")
    )


def daily_cap(events: DataFrame, at: str, tie: str, cap: int = DAILY_CAP) -> DataFrame:
    """The first `cap` events of each UTC day over all keys are `admitted`; an event without a time never is.

    Any cap will do: rows are counted in ranges of (day, time), so no day is gathered.
    """
    dated = events.withColumn("_day", F.date_trunc("day", F.col(at)))
    numbered = number_rows(dated, ["_day"], [F.col(at).asc(), F.col(tie).asc()], "_place")
    within = F.col(at).isNotNull() & (F.col("_place") <= cap)
    return numbered.withColumn("admitted", within).drop("_day", "_place")


def closed_days(sweeps: DataFrame, today: Column) -> DataFrame:
    """A day is closed once it is older than yesterday: later sweeps may skip it."""
    return sweeps.withColumn("closes", F.col("day") < F.date_sub(today, 1))


def sweep_plan(sweeps: DataFrame, today: Column, days: int, modalities: DataFrame) -> DataFrame:
    """(day, modality_id, next_page): a finished day is left out, a past day resumes after its
    last page, today and yesterday start over."""
    grid = modalities.select("modality_id").distinct().select(
        "modality_id", F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day")
    )
    past = F.col("day") < F.date_sub(today, 1)
    return (
        grid.join(sweeps.select("day", "modality_id", "last_page", "closed"), ["day", "modality_id"], "left")
        .where(~F.coalesce("closed", F.lit(False)))
        .select(
            "day",
            "modality_id",
            F.when(past, F.coalesce("last_page", F.lit(0)) + 1).otherwise(1).cast("int").alias("next_page"),
        )
    )
