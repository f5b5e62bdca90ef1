"""Which open tenders suit which profiles, in batches for an external judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prumo.fixed_values import BATCH_SIZE, CANDIDATE_LIMIT, MAX_OBJECT, RELEVANT_SCORE
from prumo.functions.display import format_brl
from prumo.functions.predicates import in_range_or_unknown, is_open
from prumo.functions.text import collapse_cut, strip
from prumo.operators.grouping import keep_last, number_rows, running_total, top_per_key
from prumo.operators.search import SIMPLE, Language, analyze, index_texts, match_phrase, phrase_words, weight
from prumo.session import materialize


def search_text() -> Column:
    return F.concat_ws(" ", F.col("object"), F.coalesce("extra_info", F.lit("")))


def keywords_of(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("id").alias("profile_id"), F.explode("keywords").alias("phrase"))


def candidates(
    tenders: DataFrame,
    profiles: DataFrame,
    triage: DataFrame,
    now: Column,
    k: int = CANDIDATE_LIMIT,
    language: Language = SIMPLE,
) -> DataFrame:
    """The k best open tenders per profile that match it and were not judged for it yet.

    Only open tenders are indexed. Profiles that ask the same (phrases, states, bounds) are one ask, and tenders that no ask tells
    apart are one kind. Of each ask only the k best stay, and as many more as the most judged of its profiles has judged
    among the open ones; only those meet profiles. Rows so grow with asks times the kinds they match, and with asks and profiles times k.
    """
    members = _asks(profiles)
    distinct = members.groupBy("ask").agg(F.first("profile").alias("p")).select("ask", "p.*")
    open_ = tenders.where(is_open("closes_at", now))
    judged = triage.select("profile_id", F.col("tender_id").alias("id")).join(open_.select("id"), "id", "left_semi")
    needs = (
        members.join(judged.groupBy("profile_id").agg(F.count("*").alias("n")), "profile_id", "left")
        .groupBy("ask")
        .agg((F.max(F.coalesce("n", F.lit(0))) + k).alias("need"))
    )
    asks = materialize(distinct.join(needs, "ask"), "asks-needs")
    met = _matches(open_, asks, language)
    most = asks.agg(F.max("need")).first()[0] or k
    limited = top_per_key(met, ["ask"], _ranking(), most, "at") if most <= 1000 else number_rows(met, ["ask"], _ranking(), "at")
    best = materialize(limited.where(F.col("at") <= F.col("need")).drop("at", "need"), "best-of-asks")
    left = members.select("profile_id", "ask").join(best, "ask").drop("ask").join(judged, ["profile_id", "id"], "left_anti")
    return top_per_key(left, ["profile_id"], _ranking(), k, "place").withColumnRenamed("id", "tender_id")


def _ranking() -> list[Column]:
    return [F.col("rank").desc(), *_within()]


def _within() -> list[Column]:
    return [F.col("closes_at").asc_nulls_last(), F.col("id").asc()]


def _asks(profiles: DataFrame) -> DataFrame:
    """(profile_id, ask, profile): profiles with equal phrases, states and bounds share an ask, named by its smallest profile."""
    wanted = F.struct(
        F.array_sort(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))).alias("keywords"),
        F.array_sort(F.array_distinct("states")).alias("states"),
        "min_value",
        "max_value",
    )
    listed = materialize(profiles.select(F.col("id").alias("profile_id"), wanted.alias("profile")), "asks")
    named = listed.groupBy(F.col("profile").alias("same")).agg(F.min("profile_id").alias("ask"))
    return listed.join(named, F.col("profile").eqNullSafe(F.col("same"))).select("profile_id", "ask", "profile")


def _matches(open_: DataFrame, asks: DataFrame, language: Language) -> DataFrame:
    """(ask, id, closes_at, rank, need): open tenders that match an ask, all of its `need` best among them.

    An ask first meets groups of tenders: of one kind, area (a state, or all) and range of values. Their sizes tell the rank that the best
    must reach; only groups of that rank hand over tenders, and of a group whose values all fit only as many as are needed.
    """
    topics = materialize(asks.groupBy("keywords").agg(F.min("ask").alias("topic")), "topics")
    of_topics = topics.select(F.col("topic").alias("id"), "keywords")
    phrases = keywords_of(of_topics).where(F.trim("phrase") != "").distinct()
    words = analyze(phrases, "phrase", ["profile_id"], language).groupBy("profile_id").agg(F.collect_set("lexeme").alias("words"))
    tenders, kinds = _kinds(open_, phrases, language)
    tenders = _placed(tenders, _breaks(asks))
    group = ["kind", "area", "cell"]
    groups = tenders.groupBy(*group).agg(
        F.sum("one").alias("n"), F.min("estimated_value").alias("lo"), F.max("estimated_value").alias("hi")
    )
    # Sums of word weights; dividing by the profile's word count would not change the order.
    nothing = F.lit(0).cast("long")
    score = F.aggregate("words", nothing, lambda total, x: total + F.coalesce(F.col("weights")[x], nothing))
    ranks = (
        kinds.select("kind", F.explode("phrases").alias("phrase"))
        .join(phrases, "phrase")
        .select("profile_id", "kind")
        .distinct()
        .join(words, "profile_id")
        .join(kinds.select("kind", F.map_from_entries("weights").alias("weights")), "kind")
        .select(F.col("profile_id").alias("topic"), "kind", score.alias("rank"))
    )
    area = F.when(F.size("states") == 0, F.array(F.lit(ANYWHERE))).otherwise(F.transform("states", _state))
    wanted = (
        asks.join(topics, "keywords")
        .select("topic", "ask", "need", "min_value", "max_value", F.explode(area).alias("area"))
    )
    fits = lambda c: in_range_or_unknown(c, "min_value", "max_value")
    offers = (
        wanted.join(materialize(ranks, "ranks"), "topic")
        .join(groups, ["kind", "area"])
        .where(F.coalesce(F.col("hi") >= F.col("min_value"), F.lit(True)) & F.coalesce(F.col("lo") <= F.col("max_value"), F.lit(True)))
        .select("ask", "need", "min_value", "max_value", *group, "rank", "n", (fits("lo") & fits("hi")).alias("whole"))
    )
    offers = materialize(offers, "offers")
    sure = offers.where("whole").groupBy("ask", "need", "rank").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("ask").orderBy(F.col("rank").desc()))
    least = sure.withColumn("n", so_far).where(F.col("n") >= F.col("need")).groupBy("ask").agg(F.max("rank").alias("least"))
    kept = offers.join(least, "ask", "left").where(F.col("least").isNull() | (F.col("rank") >= F.col("least")))
    met = (
        kept.drop("n", "least")
        .join(tenders, group)
        .where(fits("estimated_value") & (~F.col("whole") | (F.col("at") < F.col("need"))))
        .select("ask", "id", "closes_at", "rank", "need", "one")
    )
    # A tender listed once meets an ask once.
    return met.where("one = 1").drop("one").unionByName(met.where("one = 0").drop("one").distinct())


ANYWHERE = ""


def _state(state: Column) -> Column:
    return F.concat(F.lit("="), state)


def _kinds(open_: DataFrame, phrases: DataFrame, language: Language) -> tuple[DataFrame, DataFrame]:
    """Tenders with their kind, and (kind, phrases, weights): tenders of a kind hold the same of the phrases and the words of phrases
    equally often, so every ask ranks them alike."""
    posted = materialize(index_texts(open_.where(F.col("id").isNotNull()), search_text(), ["id"], language), "postings")
    hits = match_phrase(posted, phrases, ["id"], language).groupBy("id").agg(F.sort_array(F.collect_list("phrase")).alias("phrases"))
    weights = (
        posted.join(phrase_words(phrases, language).distinct(), "lexeme", "left_semi")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("lexeme", weight("tf").alias("w")))).alias("weights"))
    )
    kind = F.unhex(F.sha2(F.to_json(F.struct("phrases", "weights")), 256))
    known = materialize(hits.join(weights, "id").select("id", kind.alias("kind"), "phrases", "weights"), "kinds")
    listed = open_.select("id", "state", "estimated_value", "closes_at").distinct()
    times = listed.groupBy("id").agg(F.count("*").alias("times"))
    # What is listed more than once, with different facts, counts for nothing where tenders are counted.
    tenders = listed.join(times, "id").join(known.select("id", "kind"), "id")
    tenders = tenders.withColumn("one", (F.col("times") == 1).cast("int")).drop("times")
    kinds = known.groupBy("kind").agg(F.first("phrases").alias("phrases"), F.first("weights").alias("weights"))
    return tenders, kinds


BREAKS = 64  # ranges of values; with as many different bounds or fewer, all tenders of a range fit a profile or none does


def _breaks(asks: DataFrame) -> tuple[list, list]:
    """Lower and upper bounds at which values are cut into ranges: all different ones, or quantiles of them."""

    def of(column: str) -> list:
        bounds = asks.select(F.col(column).alias("b")).where("b IS NOT NULL").distinct()
        found = [r.b for r in bounds.limit(BREAKS + 1).collect()]
        if len(found) > BREAKS:
            steps = [i / BREAKS for i in range(1, BREAKS)]
            found = bounds.agg(F.percentile_approx("b", steps, 10_000)).first()[0]
        return sorted(set(found))

    return of("min_value"), of("max_value")


def _placed(tenders: DataFrame, breaks: tuple[list, list]) -> DataFrame:
    """Each tender once for its state and once for anywhere, with the range of its value and `at`, how many of its group come before it."""
    lower, upper = ([F.lit(b) for b in bounds] for bounds in breaks)
    passed = [(F.col("estimated_value") >= b).cast("int") for b in lower] + [(F.col("estimated_value") > b).cast("int") for b in upper]
    cell = F.when(F.col("estimated_value").isNotNull(), sum(passed, F.lit(0))).otherwise(-1)
    areas = F.explode(F.array(F.lit(ANYWHERE), _state(F.col("state")))).alias("area")
    spread = tenders.withColumn("cell", cell).select("*", areas).drop("state").where("area IS NOT NULL")
    return materialize(running_total(spread, ["kind", "area", "cell"], _within(), F.col("one"), "at"), "placed")


def batch_by_rank(ranked: DataFrame, place: str = "place", size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches of a ranking, numbered inside from 1."""
    at = F.col(place) - 1
    return ranked.withColumn("batch", F.floor(at / size).cast("int")).withColumn(
        "n", (F.pmod(at, F.lit(size)) + 1).cast("int")
    )


def triage_prompts(batches: DataFrame, tenders: DataFrame, profiles: DataFrame) -> DataFrame:
    """One text per batch: the company, where it works, the numbered tenders. What is gathered
    per group is one batch."""
    place = F.concat(
        F.coalesce(F.nullif("city", F.lit("")), F.lit("?")), F.lit("/"), F.coalesce(F.nullif("state", F.lit("")), F.lit("?"))
    )
    line = F.concat(
        F.col("n").cast("string"), F.lit(". "), collapse_cut("object", MAX_OBJECT, "…"),
        F.lit("\n   Órgão: "), F.col("org"), F.lit(" ("), place, F.lit(") · Valor estimado: "),
        format_brl("estimated_value"),
    )
    listed = (
        batches.join(tenders.withColumnRenamed("id", "tender_id"), "tender_id")
        .groupBy("profile_id", "batch")
        .agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    )
    head = profiles.select(
        F.col("id").alias("profile_id"),
        F.concat_ws(
            "\n",
            F.lit("PERFIL DA EMPRESA"),
            F.col("description"),
            F.concat(
                F.lit("Atua em: "),
                F.when(F.size("states") > 0, F.array_join("states", ", ")).otherwise(F.lit("todo o Brasil")),
            ),
            F.lit(""),
            F.lit("LICITAÇÕES"),
        ).alias("head"),
    )
    return listed.join(head, "profile_id").select(
        "profile_id",
        "batch",
        F.concat_ws("\n", "head", F.array_join(F.col("lines.line"), "\n")).alias("prompt"),
    )


class NoAnswer(Exception):
    """Raised by a judge that has no answer for a batch."""


REPLIES = "profile_id long, batch int, n int, score int, reason string, model string, seq int"


def score_batches(
    prompts: DataFrame,
    judge: Callable[[str], list[tuple[int, int, str]]],
    model: str,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Ask an external judge about every batch. A batch without an answer (NoAnswer, or the OSError family: time-outs,
    connections) yields no rows: its tenders stay unjudged and come back on the next run. Any other error of the judge is
    a fault in its program and ends the job."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for profile_id, batch, prompt in zip(frame.profile_id, frame.batch, frame.prompt):
                try:
                    replies = judge(prompt)
                except (NoAnswer, OSError):
                    continue
                rows += [(profile_id, batch, n, s, r, model, i) for i, (n, s, r) in enumerate(replies)]
            yield pd.DataFrame(rows, columns=["profile_id", "batch", "n", "score", "reason", "model", "seq"])

    if parallel_calls:
        prompts = prompts.repartition(parallel_calls)
    return prompts.select("profile_id", "batch", "prompt").mapInPandas(ask, REPLIES)


def apply_scores(batches: DataFrame, replies: DataFrame, threshold: int = RELEVANT_SCORE) -> DataFrame:
    """Judgements of the tenders of each batch: the last reply to a number counts, numbers
    outside the batch are ignored, a skipped number leaves its tender unjudged.

    Stored replies are small for the rows they hold (one model, few reasons, numbers that repeat), so by their size
    alone Spark would gather millions of them on the driver to broadcast them.
    """
    last = keep_last(
        replies.select("profile_id", "batch", "n", "seq", "score", "reason", "model"), ["profile_id", "batch", "n"], ["seq"]
    )
    return batches.join(last.hint("merge"), ["profile_id", "batch", "n"]).select(
        "profile_id",
        "tender_id",
        "score",
        (F.col("score") >= threshold).alias("relevant"),
        strip("reason").alias("reason"),
        "model",
    )


def append_triage(triage: DataFrame, judged: DataFrame) -> DataFrame:
    """Earlier judgements stay; only pairs never judged are added. The pairs are not broadcast: stored, they are small for
    their rows."""
    known = triage.select("profile_id", "tender_id").hint("merge")
    fresh = judged.join(known, ["profile_id", "tender_id"], "left_anti")
    return triage.unionByName(fresh)


def triage_summary(batches: DataFrame, judged: DataFrame, replies: DataFrame) -> DataFrame:
    """Per profile: candidates, judged, relevant, batches that failed, models that answered."""
    sent = batches.groupBy("profile_id").agg(
        F.count("*").alias("candidates"), F.count_distinct("batch").alias("batches")
    )
    answered = replies.groupBy("profile_id").agg(F.count_distinct("batch").alias("answered"))
    scored = judged.groupBy("profile_id").agg(
        F.count("*").alias("scored"),
        F.count_if("relevant").alias("relevant"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )
    zero = F.lit(0).cast("long")
    return (
        sent.join(scored, "profile_id", "left")
        .join(answered, "profile_id", "left")
        .select(
            "profile_id",
            "candidates",
            F.coalesce("scored", zero).alias("scored"),
            F.coalesce("relevant", zero).alias("relevant"),
            (F.col("batches") - F.coalesce("answered", zero)).alias("failed_batches"),
            F.coalesce("models", F.lit("")).alias("models"),
        )
    )
