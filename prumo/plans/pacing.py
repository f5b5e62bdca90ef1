"""Queries for time rules over arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.functions.values import micros
from prumo.operators import pacing as E
from prumo.operators.intake import replay_questions
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql
from prumo.session import fresh_path
from prumo.streaming.admission import admit_stream

WINDOW = 6 * 3600


def arrivals(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", micros("ts").alias("at_us"), F.col("ts").cast("timestamp").alias("ts"))


# The admitted times still held are a list; arrivals of a user are taken one after the other.
ADMISSION = f"""ranked AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold(user_id, n, event_id, admitted, held) AS (
  SELECT user_id, n, event_id, true, [t] FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.n, r.event_id, len(list_filter(f.held, lambda h: r.t - h <= {WINDOW}000000)) < 2,
         CASE WHEN len(list_filter(f.held, lambda h: r.t - h <= {WINDOW}000000)) < 2
              THEN list_append(list_filter(f.held, lambda h: r.t - h <= {WINDOW}000000), r.t)
              ELSE list_filter(f.held, lambda h: r.t - h <= {WINDOW}000000) END
  FROM fold f JOIN ranked r ON r.user_id = f.user_id AND r.n = f.n + 1)"""


@query(with_sql(ADMISSION) + "SELECT event_id, user_id, admitted FROM fold")
def window_admission(t: Tables) -> DataFrame:
    """At most two admitted arrivals per user in six hours."""
    return E.admit(arrivals(t), "user_id", "at_us", "event_id", 2, WINDOW).select("event_id", "user_id", "admitted")


@query(
    """WITH RECURSIVE ranked AS (
         SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
       paced(event_type, n, event_id, start_us) AS (
         SELECT event_type, n, event_id, t FROM ranked WHERE n = 1
         UNION ALL
         SELECT r.event_type, r.n, r.event_id, greatest(r.t, p.start_us + 1200000000) FROM paced p
         JOIN ranked r ON r.event_type = p.event_type AND r.n = p.n + 1)
       SELECT event_id, event_type, start_us FROM paced"""
)
def even_pacing(t: Tables) -> DataFrame:
    """Starts at least twenty minutes apart per kind of event."""
    return E.pace(arrivals(t), "event_type", "at_us", "event_id", 1_200_000_000).select("event_id", "event_type", "start_us")


@query(
    "SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) <= 40 AS admitted FROM events"
)
def daily_cap(t: Tables) -> DataFrame:
    return E.daily_cap(arrivals(t), "ts", "event_id").select("event_id", "admitted")


SWEEPS = """sweeps AS (
  SELECT CAST(ts AS DATE) AS day, CAST(user_id % 3 AS INTEGER) AS modality_id, CAST(max(event_id) % 50 AS INTEGER) AS last_page,
         max(event_id) % 2 = 0 AS closed FROM events GROUP BY 1, 2)"""


def sweeps(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 3).cast("int").alias("modality_id")).agg(
        (F.max("event_id") % 50).cast("int").alias("last_page"), (F.max("event_id") % 2 == 0).alias("closed")
    )


TODAY = "2024-01-20"


@query(with_sql(SWEEPS) + f"SELECT strftime(day, '%Y-%m-%d') AS day, modality_id, day < DATE '{TODAY}' - 1 AS closes FROM sweeps")
def closed_days(t: Tables) -> DataFrame:
    out = E.closed_days(sweeps(t), F.to_date(F.lit(TODAY)))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "modality_id", "closes")


@query(
    with_sql(SWEEPS)
    + f"""SELECT strftime(g.day, '%Y-%m-%d') AS day, g.modality_id,
            CASE WHEN g.day < DATE '{TODAY}' - 1 THEN coalesce(s.last_page, 0) + 1 ELSE 1 END AS next_page
          FROM (SELECT CAST(DATE '{TODAY}' - CAST(i AS INTEGER) AS DATE) AS day, m AS modality_id
                FROM range(60) r(i), (SELECT DISTINCT CAST(user_id % 3 AS INTEGER) AS m FROM events)) g
          LEFT JOIN sweeps s ON s.day = g.day AND s.modality_id = g.modality_id WHERE NOT coalesce(s.closed, false)"""
)
def sweep_plan(t: Tables) -> DataFrame:
    """Sixty days back; the first of them were never swept."""
    done = sweeps(t)
    plan = E.sweep_plan(done, F.to_date(F.lit(TODAY)), 60, done.select("modality_id"))
    return plan.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "modality_id", "next_page")


def question_log(t: Tables) -> DataFrame:
    """Events as questions: a few texts per tender, some with history, some the model fails on."""
    return t.events.select(
        F.col("event_id").alias("id"),
        micros("ts").alias("at_us"),
        F.col("user_id").alias("client"),
        (F.col("user_id") % 10).alias("tender_id"),
        F.concat("event_type", F.lit(" "), (F.col("event_id") % 40).cast("string")).alias("normalized"),
        (F.col("event_type") == "purchase").alias("with_history"),
        (F.col("value") < 3).alias("fails"),
    )


# The log row by row: what is stored, the slots in use and the day's count go from one row to the next. Questions are numbered, so
# that the stored ones are a short list.
REPLAY = f"""log AS MATERIALIZED (
  SELECT event_id AS id, epoch_us(ts) AS t, epoch_us(ts) // 86400000000 AS day, user_id AS client, event_type = 'purchase' AS history, value < 3 AS fails,
         dense_rank() OVER (ORDER BY user_id % 10, event_type || ' ' || (event_id % 40)) AS question,
         row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
fold(n, id, client, outcome, stored, slots, day, answers) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, '', []::BIGINT[], []::STRUCT(c BIGINT, t BIGINT)[], -1::BIGINT, 0::BIGINT
  UNION ALL
  SELECT n + 1, r.id, r.client, outcome,
         CASE WHEN outcome = 'answered' AND NOT r.history THEN list_append(stored, r.question) ELSE stored END,
         CASE WHEN outcome IN ('answered', 'failed') THEN list_append(held, {{'c': r.client, 't': r.t}}) ELSE held END,
         r.day, so_far + (outcome = 'answered')::BIGINT
  FROM (SELECT *, CASE WHEN NOT r.history AND list_contains(stored, r.question) THEN 'cached' WHEN so_far >= 40 THEN 'daily cap'
                       WHEN len(list_filter(held, lambda s: s.c = r.client)) >= 2 THEN 'client window'
                       WHEN r.fails THEN 'failed' ELSE 'answered' END AS outcome
        FROM (SELECT n, stored, r, list_filter(slots, lambda s: r.t - s.t <= {WINDOW}000000) AS held,
                     CASE WHEN day = r.day THEN answers ELSE 0 END AS so_far
              FROM (SELECT f.n, f.stored, f.slots, f.day, f.answers, r FROM fold f JOIN log r ON r.n = f.n + 1))))"""


@query(with_sql(REPLAY) + "SELECT id, client, outcome FROM fold WHERE n > 0")
def replayed_questions(t: Tables) -> DataFrame:
    """The whole log under cache, daily cap and client window."""
    return replay_questions(question_log(t), cap=40, most=2, window_seconds=WINDOW).select("id", "client", "outcome")


@query(with_sql(ADMISSION) + "SELECT event_id, user_id, admitted FROM fold")
def streamed_admission(t: Tables) -> DataFrame:
    """The same rule as a stream that is stopped and resumed: three stretches of the month arrive
    one after the other."""
    source, state, sink = (fresh_path(t.spark, n) for n in ("stream-arrivals", "stream-state", "stream-admitted"))
    rows = arrivals(t).select("user_id", "event_id", "at_us", "ts")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for part in range(3):
        rows.where(third == part).drop("ts").write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.drop("ts").schema).parquet(source)
        run = (
            admit_stream(stream, "user_id", "at_us", "event_id", 2, WINDOW)
            .writeStream.format("parquet").option("checkpointLocation", state).option("path", sink)
            .outputMode("append").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return t.spark.read.parquet(sink).select("event_id", "user_id", "admitted")
