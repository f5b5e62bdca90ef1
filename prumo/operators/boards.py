"""Listings that join judgements, analyses, tenders and their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import DONE, HISTORY_TURNS, PROMPT_ITEMS
from prumo.functions.predicates import eligible, is_open, is_readable_type
from prumo.functions.text import collapse_cut
from prumo.operators.grouping import number_rows, previous_rows, previous_value, top_per_key

PAIR = ["profile_id", "tender_id"]


def triage_board(triage: DataFrame, analyses: DataFrame, tenders: DataFrame, include_all: bool = False) -> DataFrame:
    """Judged tenders per profile with the outcome of their analysis; `board_order` sorts them."""
    shown = triage if include_all else triage.where("relevant")
    outcome = analyses.select(*PAIR, "recommendation", "citations_total", "citations_verified")
    return (
        shown.join(outcome, PAIR, "left")
        .join(tenders.withColumnRenamed("id", "tender_id"), "tender_id")
    )


def board_order() -> list[Column]:
    """Analysed first, then best score, then tender."""
    return [F.col("recommendation").isNull().asc(), F.col("score").desc(), F.col("tender_id").asc()]


def ranking(triage: DataFrame, tenders: DataFrame, cut: int = 80) -> DataFrame:
    """Judged tenders with their place on the profile's list, best score first, then tender."""
    shown = triage.join(tenders.withColumnRenamed("id", "tender_id"), "tender_id").select(
        "profile_id", "tender_id", "score", "state", collapse_cut("object", cut).alias("object"), "reason"
    )
    return number_rows(shown, ["profile_id"], [F.col("score").desc(), F.col("tender_id").asc()], "place")


def to_analyse(triage: DataFrame, analyses: DataFrame, k: int, redo: bool = False) -> DataFrame:
    """The k best relevant judgements per profile without an analysis, or with one when redone."""
    waiting = triage.where("relevant")
    if not redo:
        waiting = waiting.join(analyses.select(*PAIR), PAIR, "left_anti")
    return top_per_key(waiting, ["profile_id"], [F.col("score").desc(), F.col("tender_id").asc()], k, "place")


def tender_details(tenders: DataFrame, items: DataFrame, documents: DataFrame) -> DataFrame:
    """Everything about tenders in one listing: the tender, then its items by number, then its
    documents by sequence. Long form: a tender may have more children than one row can hold.
    """
    nothing = F.lit(None).cast("string")
    head = tenders.select(F.col("id").alias("tender_id"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.col("object").alias("text"), nothing.alias("note"))
    parts = [
        rows.join(tenders.select(F.col("id").alias("tender_id")), "tender_id", "left_semi").select(
            "tender_id", F.lit(section).alias("section"), F.col(number).cast("long").alias("at"),
            F.col(text).alias("text"), F.col(note).cast("string").alias("note"),
        )
        for rows, section, number, text, note in (
            (items, 1, "number", "description", "benefit"),
            (documents, 2, "seq", "title", "status"),
        )
    ]
    return head.unionByName(parts[0]).unionByName(parts[1])


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; an unknown key gives no row."""
    return df.join(ids.select(key), key, "left_semi")


def relevant_work(triage: DataFrame, tenders: DataFrame, documents: DataFrame) -> DataFrame:
    """Relevant tenders that still need their details, or whose details are there and which have
    documents to read. One row per judgement and piece of work."""
    wanted = triage.where("relevant").select(*PAIR, "score")
    joined = wanted.join(tenders.select(F.col("id").alias("tender_id"), "details_state"), "tender_id")
    details = joined.where(F.col("details_state") != DONE).select(
        *PAIR, "score", F.lit("details").alias("work"), F.lit(-1).cast("long").alias("seq")
    )
    queue = documents.where(is_readable_type("type_id") & eligible("status", "attempts"))
    reading = joined.where(F.col("details_state") == DONE).join(queue.select("tender_id", "seq"), "tender_id").select(
        *PAIR, "score", F.lit("document").alias("work"), F.col("seq").cast("long").alias("seq")
    )
    return details.unionByName(reading)


def detail_queue(tenders: DataFrame, now: Column, k: int) -> DataFrame:
    """Tenders whose details are due, the soonest deadline first, no deadline last."""
    due = tenders.where(eligible("details_state", "details_attempts") & is_open("closes_at", now))
    return due.orderBy(F.col("closes_at").asc_nulls_last(), F.col("id").asc()).limit(k)


def cached_answers(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests without history joined with the latest stored answer to the same question about
    the same tender, itself asked without history."""
    latest = (
        questions.where(~F.col("with_history"))
        .groupBy("tender_id", "normalized")
        .agg(F.max(F.struct("id", "answer")).alias("hit"))
        .select("tender_id", "normalized", F.col("hit.id").alias("question_id"), F.col("hit.answer").alias("answer"))
    )
    return requests.where(~F.col("with_history")).join(latest, ["tender_id", "normalized"])


def with_history(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """Every turn with the n turns before it, oldest first, as `history`."""
    numbered = number_rows(turns, ["conv_id"], [F.col("turn").asc()], "_n")
    return previous_rows(numbered, ["conv_id"], "_n", F.col("text"), n, "history").drop("_n")


def head_and_rest(items: DataFrame, k: int = PROMPT_ITEMS) -> DataFrame:
    """The first k items of a tender and how many there are beyond them."""
    first = top_per_key(items, ["tender_id"], [F.col("number").asc()], k, "place")
    totals = items.groupBy("tender_id").agg(F.count("*").alias("total"))
    return first.join(totals, "tender_id").withColumn("rest", F.greatest(F.col("total") - k, F.lit(0)))


def document_boundaries(pages: DataFrame) -> DataFrame:
    """Globally numbered pages with `starts_document`: the document differs from the page before."""
    marked = previous_value(pages, ["tender_id"], "page", F.col("document"), "_before")
    return marked.withColumn("starts_document", ~F.col("document").eqNullSafe(F.col("_before"))).drop("_before")

