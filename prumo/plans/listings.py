"""Queries for boards, reports, evaluation and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.operators import boards as B
from prumo.operators import reports as R
from prumo.plans import tables as A
from prumo.plans.quotes import nested_analyses
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql

BASE = (A.TENDERS, A.TRIAGE, A.ANALYSES)

BOARD = """board AS (
  SELECT j.profile_id, j.tender_id, j.score, j.relevant, a.recommendation, a.citations_total, a.citations_verified, t.org, t.object
  FROM triage j LEFT JOIN analyses a ON a.profile_id = j.profile_id AND a.tender_id = j.tender_id JOIN tenders t ON t.id = j.tender_id)"""


@query(
    with_sql(*BASE, BOARD)
    + """SELECT profile_id, tender_id, CAST(score AS BIGINT) AS score, coalesce(recommendation, '') AS recommendation,
           CAST(coalesce(citations_total, -1) AS BIGINT) AS total, CAST(coalesce(citations_verified, -1) AS BIGINT) AS verified, org,
           row_number() OVER (PARTITION BY profile_id ORDER BY recommendation IS NULL, score DESC, tender_id) AS place
         FROM board WHERE relevant"""
)
def triage_board(t: Tables) -> DataFrame:
    """The board of every profile with each tender's place on it."""
    from prumo.operators.grouping import number_rows

    board = t.store("board", lambda: B.triage_board(A.triage(t), A.analyses(t), A.tenders(t)))
    none = F.lit(-1).cast("long")
    return number_rows(board, ["profile_id"], B.board_order(), "place").select(
        "profile_id", "tender_id", F.col("score").cast("long").alias("score"),
        F.coalesce("recommendation", F.lit("")).alias("recommendation"),
        F.coalesce(F.col("citations_total").cast("long"), none).alias("total"),
        F.coalesce(F.col("citations_verified").cast("long"), none).alias("verified"), "org", "place",
    )


@query(with_sql(*BASE, BOARD) + "SELECT profile_id, tender_id, CAST(score AS BIGINT) AS score, relevant FROM board")
def triage_board_all(t: Tables) -> DataFrame:
    """The discarded ones too."""
    return B.triage_board(A.triage(t), A.analyses(t), A.tenders(t), include_all=True).select(
        "profile_id", "tender_id", F.col("score").cast("long").alias("score"), "relevant"
    )


@query(
    with_sql(*BASE)
    + """SELECT j.profile_id, j.tender_id, CAST(j.score AS BIGINT) AS score, t.state, substring(t.object, 1, 80) AS object, j.reason,
           row_number() OVER (PARTITION BY j.profile_id ORDER BY j.score DESC, j.tender_id) AS place
         FROM triage j JOIN tenders t ON t.id = j.tender_id"""
)
def ranking_list(t: Tables) -> DataFrame:
    return B.ranking(A.triage(t), A.tenders(t)).withColumn("score", F.col("score").cast("long"))


def _to_analyse_sql(condition: str) -> str:
    return (
        with_sql(*BASE)
        + f"""SELECT profile_id, tender_id, CAST(score AS BIGINT) AS score, place FROM (
           SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, tender_id) AS place FROM triage j WHERE relevant {condition})
         WHERE place <= 3"""
    )


@query(
    _to_analyse_sql("AND NOT EXISTS (SELECT 1 FROM analyses a WHERE a.profile_id = j.profile_id AND a.tender_id = j.tender_id)")
)
def waiting_for_analysis(t: Tables) -> DataFrame:
    return _waiting(t, False)


@query(_to_analyse_sql(""))
def analyses_to_redo(t: Tables) -> DataFrame:
    return _waiting(t, True)


def _waiting(t: Tables, redo: bool) -> DataFrame:
    return B.to_analyse(A.triage(t), A.analyses(t), 3, redo).select(
        "profile_id", "tender_id", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place")
    )


# Documents attached to orders: one per event, three to an order.
FILES = """files AS (
  SELECT event_id // 3 AS tender_id, event_id AS seq, event_type || ' ' || event_id AS title,
         CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 4 WHEN 'error' THEN 16 ELSE 6 END AS type_id,
         CASE WHEN value < 20 THEN 'pendente' WHEN value < 60 THEN 'falhou' ELSE 'ok' END AS status,
         user_id % 8 AS attempts FROM events)"""


def files(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
            F.floor(F.col("event_id") / 3).alias("tender_id"),
            F.col("event_id").alias("seq"),
            F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("title"),
            F.when(kind == "click", 2).when(kind == "view", 4).when(kind == "error", 16).otherwise(6).alias("type_id"),
            F.when(F.col("value") < 20, "pendente").when(F.col("value") < 60, "falhou").otherwise("ok").alias("status"),
            (F.col("user_id") % 8).cast("int").alias("attempts"),
        )


@query(
    with_sql(A.TENDERS, A.ITEMS, A.ITEMS_LAST, FILES)
    + """SELECT id AS tender_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS at, object AS text, '' AS note FROM tenders
         UNION ALL SELECT tender_id, 1, number, description, coalesce(benefit, '') FROM items_last WHERE tender_id IN (SELECT id FROM tenders)
         UNION ALL SELECT tender_id, 2, seq, title, status FROM files WHERE tender_id IN (SELECT id FROM tenders)"""
)
def tender_details(t: Tables) -> DataFrame:
    out = B.tender_details(A.tenders(t), A.last_items(t), files(t))
    return out.select("tender_id", F.col("section").cast("long").alias("section"), "at", "text", F.coalesce("note", F.lit("")).alias("note"))


@query(with_sql(A.TENDERS) + "SELECT id, org, object FROM tenders WHERE id IN (SELECT doc_id * 7 FROM labels)")
def tenders_by_id(t: Tables) -> DataFrame:
    """A batch of ids, some unknown."""
    ids = t.labels.select((F.col("doc_id") * 7).alias("id"))
    return B.by_ids(A.tenders(t), ids, "id").select("id", "org", "object")


@query(
    with_sql(*BASE, FILES)
    + """SELECT j.profile_id, j.tender_id, CAST(j.score AS BIGINT) AS score, 'details' AS work, CAST(-1 AS BIGINT) AS seq
         FROM triage j JOIN tenders t ON t.id = j.tender_id WHERE j.relevant AND t.details_state <> 'ok'
         UNION ALL SELECT j.profile_id, j.tender_id, j.score, 'document', f.seq
         FROM triage j JOIN tenders t ON t.id = j.tender_id JOIN files f ON f.tender_id = j.tender_id
         WHERE j.relevant AND t.details_state = 'ok' AND f.type_id IN (2, 4, 6)
           AND (f.status = 'pendente' OR (f.status = 'falhou' AND f.attempts < 5))"""
)
def relevant_work(t: Tables) -> DataFrame:
    return B.relevant_work(A.triage(t), A.tenders(t), files(t)).withColumn("score", F.col("score").cast("long"))


@query(
    with_sql(A.TENDERS, FILES, A.DOCUMENT_PAGES)
    + """SELECT 'tenders' AS kind, details_state AS state, count(*) AS n FROM tenders GROUP BY details_state
         UNION ALL SELECT 'documents', status, count(*) FROM files GROUP BY status
         UNION ALL SELECT 'pages', 'text', count(*) FROM doc_pages"""
)
def status_report(t: Tables) -> DataFrame:
    return R.status_report(A.tenders(t), files(t), A.chunked(t))


@query(
    with_sql(FILES, A.ITEMS, A.ITEMS_LAST, A.TENDERS)
    + """SELECT t.id AS tender_id, coalesce(f.read, 0) AS read, coalesce(f.listed, 0) AS listed, coalesce(i.n, 0) AS items
         FROM tenders t
         LEFT JOIN (SELECT tender_id, count(*) FILTER (status = 'ok') AS read, count(*) AS listed FROM files GROUP BY tender_id) f ON f.tender_id = t.id
         LEFT JOIN (SELECT tender_id, count(*) AS n FROM items_last GROUP BY tender_id) i ON i.tender_id = t.id"""
)
def document_coverage(t: Tables) -> DataFrame:
    return R.document_coverage(A.tenders(t), files(t), A.last_items(t))


@query(
    with_sql(*BASE, BOARD)
    + "SELECT profile_id, count(*) FILTER (relevant) AS relevant, count(recommendation) AS analysed FROM board GROUP BY profile_id"
)
def board_header(t: Tables) -> DataFrame:
    return R.board_header(B.triage_board(A.triage(t), A.analyses(t), A.tenders(t), include_all=True))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS questions FROM events GROUP BY 1")
def questions_per_day(t: Tables) -> DataFrame:
    asked = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return R.daily_counts(asked, "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """SELECT user_id AS run_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS tokens_in,
         CAST(sum(CAST(floor(value) AS BIGINT) + CASE WHEN event_type = 'view' THEN 0 ELSE 3 END) AS BIGINT) AS tokens_out,
         count(*) FILTER (event_type = 'click') AS calls FROM events GROUP BY user_id"""
)
def usage_totals(t: Tables) -> DataFrame:
    """Token counts of the steps of each run; some steps lack a count."""
    kind = F.col("event_type")
    steps = t.events.select(
        F.col("user_id").alias("run_id"),
        F.when(kind != "error", F.get_json_object("props", "$.k").cast("long")).alias("prompt_tokens"),
        F.floor("value").cast("long").alias("candidate_tokens"),
        F.when(kind != "view", F.lit(3)).alias("thought_tokens"),
        F.when(kind == "click", F.lit(1)).alias("calls"),
    )
    return R.usage_totals(steps)


@query(
    """SELECT item_id AS profile_id, CAST(n > 2 AS BIGINT) AS requirements, CAST(n > 1 AS BIGINT) AS deadlines,
         CAST(n > 3 AS BIGINT) AS conditions, CAST(1 AS BIGINT) AS risks FROM (SELECT item_id, len(string_split(text, '. ')) AS n FROM benchmark)"""
)
def analysis_sizes(t: Tables) -> DataFrame:
    return R.analysis_sizes(nested_analyses(t)).drop("tender_id").withColumn("profile_id", F.col("profile_id").cast("long"))


# Evaluation: documents as answers, judged by patterns of their language; quotations from labels.
CASES = """answered AS (
  SELECT d.doc_id, d.lang, d.text, l.quality, l.toxic, d.n_chars,
         CASE d.lang WHEN 'en' THEN regexp_matches(lower(d.text), '\\bthe\\b') AND regexp_matches(lower(d.text), 'in')
              ELSE regexp_matches(lower(d.text), 'e[rn]') END AS right_answer,
         CASE WHEN l.quality = 1 THEN 'verificada' WHEN l.toxic = 1 THEN 'nao_encontrada' ELSE 'aproximada' END AS s1,
         CASE WHEN d.n_chars % 3 = 0 THEN 'corrigida' WHEN d.n_chars % 3 = 1 THEN 'nao_encontrada' ELSE 'verificada' END AS s2
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
marks AS (
  SELECT doc_id AS name, right_answer,
         lang = 'es' OR (s1 IN ('verificada', 'corrigida', 'aproximada')) OR (s2 IN ('verificada', 'corrigida', 'aproximada') AND n_chars % 5 IN (1, 3)) AS right_page,
         CAST(s1 <> 'nao_encontrada' AS BIGINT) + CAST(s2 <> 'nao_encontrada' AS BIGINT) AS verified,
         CAST(s1 = 'nao_encontrada' AS BIGINT) + CAST(s2 = 'nao_encontrada' AS BIGINT) AS invented FROM answered)"""


def eval_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    cases = t.documents.select(
        F.col("doc_id").alias("name"),
        F.when(F.col("lang") == "en", F.array(F.lit(r"\bTHE\b"), F.lit("IN"))).otherwise(F.array(F.lit("E[RN]"))).alias("patterns"),
        F.array(F.lit(1), F.lit(3)).alias("pages"),
        (F.col("lang") == "es").alias("absent"),
    )
    s1 = F.when(F.col("quality") == 1, "verificada").when(F.col("toxic") == 1, "nao_encontrada").otherwise("aproximada")
    rest = F.col("n_chars") % 3
    s2 = F.when(rest == 0, "corrigida").when(rest == 1, "nao_encontrada").otherwise("verificada")
    answers = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("name"),
        F.col("text").alias("answer"),
        F.array(
            F.struct(F.lit(1).alias("page"), s1.alias("status")),
            F.struct((F.col("n_chars") % 5).cast("int").alias("page"), s2.alias("status")),
        ).alias("citations"),
        F.lit(3).alias("steps"), F.lit(1.0).alias("seconds"), F.lit("m").alias("model"),
    )
    return cases, answers


@query(
    with_sql(CASES)
    + "SELECT name, right_answer, right_page, verified, invented, right_answer AND right_page AND invented = 0 AS passed FROM marks"
)
def scored_answers(t: Tables) -> DataFrame:
    return R.score_answers(*eval_tables(t)).select("name", "right_answer", "right_page", "verified", "invented", "passed")


@query(
    with_sql(CASES)
    + """SELECT count(*) AS cases, count(*) FILTER (right_answer AND right_page AND invented = 0) AS passed,
           count(*) FILTER (right_answer) AS right_answer, count(*) FILTER (right_page) AS right_page,
           CAST(sum(verified) AS BIGINT) AS verified, 2 * count(*) AS citations, CAST(sum(invented) AS BIGINT) AS invented FROM marks"""
)
def eval_summary(t: Tables) -> DataFrame:
    return R.eval_summary(R.score_answers(*eval_tables(t)))


@query("SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def inconclusive_cases(t: Tables) -> DataFrame:
    return R.inconclusive_cases(*eval_tables(t))
