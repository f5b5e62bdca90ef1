"""Boolean columns: ranges, deadlines, memberships, work queues, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import (
    FAILED,
    HISTORY_TURNS,
    MAX_ATTEMPTS,
    MIN_CHARS_PER_PAGE,
    PENDING,
    QUESTION_MAX,
    QUESTION_MIN,
    READABLE_TYPES,
    TURN_MAX,
)
from prumo.functions.text import as_col


def in_range_or_unknown(value, low, high) -> Column:
    """An undisclosed value is unknown, not out of range; a missing bound does not bind."""
    value, low, high = as_col(value), as_col(low), as_col(high)
    return value.isNull() | (
        F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))
    )


def is_open(closes_at, now) -> Column:
    closes_at = as_col(closes_at)
    return closes_at.isNull() | (closes_at > now)


def member_or_all(value, allowed) -> Column:
    """An empty list admits everything; otherwise a missing value is not a member."""
    allowed = as_col(allowed)
    return (F.size(allowed) == 0) | F.coalesce(F.array_contains(allowed, as_col(value)), F.lit(False))


def is_readable_type(type_id) -> Column:
    return F.coalesce(as_col(type_id).isin(*READABLE_TYPES), F.lit(False))


def eligible(state, attempts, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """Work not tried yet, or failed with tries left."""
    state = as_col(state)
    return (state == PENDING) | ((state == FAILED) & (as_col(attempts) < max_attempts))


def drop_scanned(pages: DataFrame, keys: list[str], min_average: int = MIN_CHARS_PER_PAGE) -> DataFrame:
    """Pages of documents with a text layer: enough characters per page on average."""
    readable = (
        pages.groupBy(*keys)
        .agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
        .where(F.col("chars") >= F.col("n") * min_average)
        .select(*keys)
    )
    return pages.join(readable, keys, "left_semi")


def contains_all(text, pieces) -> Column:
    text = as_col(text)
    return (F.length(text) > 0) & F.forall(as_col(pieces), lambda p: F.contains(text, p))


def matches_all(text, patterns) -> Column:
    """Every pattern matches somewhere, ignoring case."""
    text = F.lower(as_col(text))
    return F.forall(as_col(patterns), lambda p: F.regexp_like(text, F.concat(F.lit("(?iU)"), p)))


def valid_question(question, history) -> Column:
    """Length limits on the question, on every earlier turn and on their number."""
    question, history = F.length(as_col(question)), as_col(history)
    return (
        question.between(QUESTION_MIN, QUESTION_MAX)
        & (F.size(history) <= HISTORY_TURNS)
        & F.forall(history, lambda t: F.length(t) <= TURN_MAX)
    )
