"""Counts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import DONE, NOT_FOUND, SUPPORTED_STATUSES
from prumo.functions.predicates import matches_all


def status_report(tenders: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Tenders by state of their details, documents by status, pages in all."""
    return (
        tenders.groupBy(F.lit("tenders").alias("kind"), F.col("details_state").alias("state"))
        .agg(F.count("*").alias("n"))
        .unionByName(
            documents.groupBy(F.lit("documents").alias("kind"), F.col("status").alias("state")).agg(F.count("*").alias("n"))
        )
        .unionByName(pages.groupBy(F.lit("pages").alias("kind"), F.lit("text").alias("state")).agg(F.count("*").alias("n")))
    )


def sweep_counts(received: DataFrame, merged: DataFrame) -> DataFrame:
    """Portal pages read, rows new, rows updated; a repeat within the batch counts as updated."""
    zero = F.lit(0).cast("long")
    read = received.agg(F.count_distinct("page").alias("pages"), F.count("*").alias("rows")).withColumn("new", zero)
    added = merged.agg(F.count_if("inserted").alias("new")).select(zero.alias("pages"), zero.alias("rows"), "new")
    return read.unionByName(added).agg(
        F.sum("pages").alias("pages"), F.sum("new").alias("new"), (F.sum("rows") - F.sum("new")).alias("updated")
    )


def daily_counts(questions: DataFrame, at: str) -> DataFrame:
    """Stored questions per UTC day."""
    return questions.groupBy(F.date_trunc("day", F.col(at)).alias("day")).agg(F.count("*").alias("questions"))


def document_coverage(tenders: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per tender: documents read, documents listed, items."""
    docs = documents.groupBy("tender_id").agg(
        F.count_if(F.col("status") == DONE).alias("read"), F.count("*").alias("listed")
    )
    lines = items.groupBy("tender_id").agg(F.count("*").alias("items"))
    zero = F.lit(0).cast("long")
    return (
        tenders.select(F.col("id").alias("tender_id"))
        .join(docs, "tender_id", "left")
        .join(lines, "tender_id", "left")
        .select("tender_id", *[F.coalesce(c, zero).alias(c) for c in ("read", "listed", "items")])
    )


def board_header(board: DataFrame) -> DataFrame:
    return board.groupBy("profile_id").agg(
        F.count_if("relevant").alias("relevant"), F.count("recommendation").alias("analysed")
    )


def usage_totals(steps: DataFrame, key: str = "run_id") -> DataFrame:
    """Tokens and calls per run; output is candidates plus thoughts, a missing count is zero."""
    zero = F.lit(0)
    return steps.groupBy(key).agg(
        F.sum(F.coalesce("prompt_tokens", zero)).alias("tokens_in"),
        F.sum(F.coalesce("candidate_tokens", zero) + F.coalesce("thought_tokens", zero)).alias("tokens_out"),
        F.sum(F.coalesce("calls", zero)).alias("calls"),
    )


def analysis_sizes(analyses: DataFrame) -> DataFrame:
    """How many entries each section of an analysis has."""
    sections = ("requirements", "deadlines", "conditions", "risks")
    return analyses.select(
        "profile_id",
        "tender_id",
        *[F.coalesce(F.size(F.col("result")[s]), F.lit(0)).cast("long").alias(s) for s in sections],
    )


def score_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Hand-checked cases against answers.

    `cases(name, patterns, pages, absent)`, `answers(name, answer, citations, steps, seconds, model)`
    with citations array<struct<page, status>>. Right: every pattern matches. Cited: a supported
    quotation on an expected page, not needed when the fact is absent. Invented: quotations
    found nowhere.
    """
    supported = F.filter("citations", lambda c: c["status"].isin(*SUPPORTED_STATUSES))
    right = matches_all("answer", "patterns")
    cited = F.col("absent") | F.exists(supported, lambda c: F.array_contains(F.col("pages"), c["page"]))
    invented = F.size(F.filter("citations", lambda c: c["status"] == NOT_FOUND))
    scored = cases.join(answers, "name").select(
        "name",
        right.alias("right_answer"),
        F.coalesce(cited, F.lit(False)).alias("right_page"),
        F.size("citations").cast("long").alias("citations"),
        F.size(supported).cast("long").alias("verified"),
        invented.cast("long").alias("invented"),
        "steps",
        "seconds",
        "model",
    )
    return scored.withColumn("passed", F.col("right_answer") & F.col("right_page") & (F.col("invented") == 0))


def eval_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if("right_answer").alias("right_answer"),
        F.count_if("right_page").alias("right_page"),
        F.coalesce(F.sum("verified"), F.lit(0).cast("long")).alias("verified"),
        F.coalesce(F.sum("citations"), F.lit(0).cast("long")).alias("citations"),
        F.coalesce(F.sum("invented"), F.lit(0).cast("long")).alias("invented"),
    )


def inconclusive_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases nobody answered: reported, not failed."""
    return cases.join(answers.select("name"), "name", "left_anti").select("name")
