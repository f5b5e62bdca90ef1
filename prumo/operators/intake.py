"""Replay of a question log under the three intake rules, in their order: an answer already
stored, the daily cap, the client's window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import CLIENT_MAX, CLIENT_WINDOW_SECONDS, DAILY_CAP
from prumo.operators.grouping import number_rows
from prumo.operators.pacing import SECOND, admit
from prumo.session import materialize

CACHED, OVER_CAP, OVER_WINDOW, ANSWERED, FAILED = "cached", "daily cap", "client window", "answered", "failed"
DAY_US = 86400 * SECOND
# Rows at the head of a day that are taken one after the other, and days whose heads one task takes. They change the work, not the result.
HEAD, DAYS = 16_384, 366
NEEDED = ("id", "at_us", "client", "tender_id", "normalized", "with_history", "fails")


def replay_questions(
    requests: DataFrame,
    cap: int = DAILY_CAP,
    most: int = CLIENT_MAX,
    window_seconds: int = CLIENT_WINDOW_SECONDS,
    head: int = HEAD,
    days: int = DAYS,
) -> DataFrame:
    """`requests(id, at_us, client, tender_id, normalized, with_history, fails)` plus `outcome`.

    A question without history whose answer is stored is served from the log and is free. Else,
    once the UTC day has stored its cap, it is refused; else the client's window decides, and
    takes the slot also when the model then fails. Only stored answers count for the day. `id` and `at_us` are not
    null and (at_us, id) is unique; a null flag counts as false, a null question or tender is never served from the log.

    What is decided moves forward through the days and is not looked at again. Only what comes before a day's cap changes
    anything later, so the first `head` rows of the days ahead are taken in order, up to the first day that neither ends
    nor reaches its cap within them. The rest of that day is decided side by side (`_rest_of_day`), and the heads go on
    from the day after. At the end one join tells every row of the log its outcome, so the work grows with the log.
    """
    log = requests.withColumn("_day", F.floor(F.col("at_us") / DAY_US))
    for flag in ("with_history", "fails"):
        log = log.withColumn(flag, F.coalesce(flag, F.lit(False)))
    log = materialize(number_rows(log, ["_day"], [F.col("at_us").asc(), F.col("id").asc()], "_n"), "question-log")
    window_us = window_seconds * SECOND
    span = log.agg(F.min("_day").alias("begin"), F.max("_day").alias("end")).first()
    decided, begin = None, span["begin"]
    while begin is not None and begin <= span["end"]:
        found = _heads(log, decided, begin, begin + days, head, cap, most, window_us)
        stop = found.where("outcome IS NULL").select("_day").first()
        decided = _with(decided, found.where("outcome IS NOT NULL"))
        if stop is None:
            begin += days
            continue
        rest = _rest_of_day(log.where((F.col("_day") == stop["_day"]) & (F.col("_n") > head)), decided, stop["_day"], cap, most, window_seconds)
        decided, begin = _with(decided, rest), stop["_day"] + 1
    if decided is None:
        return requests.withColumn("outcome", F.lit(None).cast("string"))
    stored = decided.where(F.col("outcome") == ANSWERED)
    placed = _placed(log, _first_answers(stored), _closings(stored, cap), cap)
    reached = decided.select("id", F.col("outcome").alias("_reached"))
    outcome = F.coalesce("turned", "_reached").alias("outcome")
    return placed.join(reached, "id", "left").select(*[F.col(c) for c in requests.columns], outcome)


def _with(decided: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if decided is None else decided.unionByName(more)


def _first_answers(stored: DataFrame) -> DataFrame:
    """When a question without history was first answered."""
    return stored.where("NOT with_history").groupBy("tender_id", "normalized").agg(F.min(F.struct("at_us", "id")).alias("first"))


def _closings(stored: DataFrame, cap: int) -> DataFrame:
    """The answer that closed a day; no more than the cap are stored in a day."""
    days = stored.groupBy("_day").agg(F.count("*").alias("n"), F.max(F.struct("at_us", "id")).alias("full"))
    return days.where(F.col("n") == cap).select("_day", "full")


def _placed(log: DataFrame, first: DataFrame, full: DataFrame, cap: int) -> DataFrame:
    """`turned`: why a question never reaches its client's window, if so, by what was stored before it."""
    here = F.struct("at_us", "id")
    late = F.coalesce(F.col("full") < here, F.lit(False)) if cap > 0 else F.lit(True)
    return (
        log.join(first, ["tender_id", "normalized"], "left")
        .join(full, "_day", "left")
        .withColumn(
            "turned",
            F.when(~F.col("with_history") & F.coalesce(F.col("first") < here, F.lit(False)), CACHED).when(late, OVER_CAP),
        )
        .drop("first", "full")
    )


def _slots(decided: DataFrame, since: int, window_us: int) -> DataFrame:
    """The decided questions that still hold a slot of their client's window at a time."""
    return decided.where(F.col("outcome").isin(ANSWERED, FAILED) & (F.col("at_us") >= since - window_us))


def _heads(
    log: DataFrame, decided: DataFrame | None, begin: int, end: int, head: int, cap: int, most: int, window_us: int
) -> DataFrame:
    """Decisions on the heads of the days begin to end - 1, in order; a row without outcome marks the day that they end in.

    One task takes at most `head` rows a day, and holds the answers it stored (`cap` a day) and the slots in use.
    """
    rows = log.where((F.col("_day") >= begin) & (F.col("_day") < end) & (F.col("_n") <= head + 1))
    rows = rows.select(*NEEDED, "_day", (F.col("_n") > head).alias("marker"), F.lit(False).alias("given"))
    if decided is not None:
        stored = decided.where(F.col("outcome") == ANSWERED)
        cached = ~F.col("with_history") & F.coalesce(F.col("first") < F.struct("at_us", "id"), F.lit(False))
        known = rows.join(_first_answers(stored), ["tender_id", "normalized"], "left")
        rows = known.where(F.col("marker") | ~cached).drop("first")
        held = _slots(decided, begin * DAY_US, window_us).withColumn("marker", F.lit(False)).withColumn("given", F.lit(True))
        rows = rows.unionByName(held.select(*rows.columns))
    schema = T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict = {}
        stored: set = set()
        day, count, closed = None, 0, False
        for batch in batches:
            picked, outcomes = [], []
            columns = (batch.column(c).to_pylist() for c in ("at_us", "client", "tender_id", "normalized", "with_history", "fails", "_day", "marker", "given"))
            for i, (at, client, tender, text, history, fails, of_day, marker, given) in enumerate(zip(*columns)):
                if given:
                    slots.setdefault(client, []).append(at)
                    continue
                if of_day != day:
                    day, count, closed = of_day, 0, cap <= 0
                    slots = {c: s for c, s in slots.items() if at - s[-1] <= window_us}
                if marker and not closed:
                    yield _picked(batch, [*picked, i], [*outcomes, None])
                    return
                question = (tender, text)
                if marker or closed or (not history and question in stored):
                    continue
                held = [s for s in slots.get(client, ()) if at - s <= window_us]
                picked.append(i)
                if len(held) >= most:
                    outcomes.append(OVER_WINDOW)
                    continue
                slots[client] = [*held, at]
                outcomes.append(FAILED if fails else ANSWERED)
                if not fails:
                    count += 1
                    closed = count >= cap
                    if not history and tender is not None and text is not None:
                        stored.add(question)
            yield _picked(batch, picked, outcomes)

    # Bounded: `head` rows of each of `days` days, and the slots in use when they begin.
    found = rows.repartition(1).sortWithinPartitions("at_us", "id").mapInArrow(fold, schema)
    return materialize(found.select(*NEEDED, "_day", "outcome"), "question-heads")


def _picked(batch: pa.RecordBatch, rows: list[int], outcomes: list[str | None]) -> pa.RecordBatch:
    taken = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(outcomes, pa.string())], [*batch.schema.names, "outcome"])


def _rest_of_day(rows: DataFrame, decided: DataFrame, day: int, cap: int, most: int, window_seconds: int) -> DataFrame:
    """Decisions on `rows`, what follows the head of a day, however many they are.

    Two tables decide everything: when a question's answer was first stored, and which answer closed the day.
    From a guess of both, the questions that reach the client windows follow by joins, the windows by `admit` (a client's
    arrivals are folded in runs), and from the answers both tables anew, the closing one through counts in ranges, so
    any cap will do. The earliest row that was still wrong is right after each round, so what no longer changes is the
    result of taking the rows one by one. Rows whose answer was known before are gone from the start.
    """
    here = F.struct("at_us", "id")
    stored = decided.where(F.col("outcome") == ANSWERED)
    left = cap - stored.where(F.col("_day") == day).count()
    known = rows.select(*NEEDED, "_day").join(_first_answers(stored), ["tender_id", "normalized"], "left")
    open_ = materialize(known.where("with_history OR first IS NULL").drop("first"), "open-questions")
    since = open_.agg(F.min("at_us")).first()[0]
    if since is None:
        return decided.limit(0)
    held = _slots(decided, since, window_seconds * SECOND).select(*NEEDED, "_day")
    empty = open_.withColumn("outcome", F.lit(ANSWERED)).limit(0)
    first, full, now = _first_answers(empty), _closings(empty, left), None
    while True:
        waiting = _placed(open_, first, full, left).where("turned IS NULL").drop("turned")
        arrivals = waiting.withColumn("given", F.lit(False)).unionByName(held.withColumn("given", F.lit(True)))
        admitted = admit(arrivals, "client", "at_us", "id", most, window_seconds).where("NOT given").drop("given")
        admitted = materialize(admitted, "questions-admitted")
        answers = admitted.where("admitted AND NOT fails")
        found = answers.where("NOT with_history").groupBy("tender_id", "normalized").agg(F.min(here).alias("first"))
        counted = number_rows(answers, ["_day"], [F.col("at_us").asc(), F.col("id").asc()], "n")
        closed = counted.where(F.col("n") == left).select("_day", here.alias("full"))
        first, full = materialize(found, "first-answers"), materialize(closed, "closed-days")
        before, now = now, _state(first, full)
        if now == before:
            break
    outcome = F.when(~F.col("admitted"), OVER_WINDOW).when(F.col("fails"), FAILED).otherwise(ANSWERED)
    return admitted.select(*NEEDED, "_day", outcome.alias("outcome"))


def _state(*tables: DataFrame) -> list:
    """What tells one set of rows from another: their number and the sum of their hashes."""
    rows = [t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first() for t in tables]
    return [tuple(r) for r in rows]
