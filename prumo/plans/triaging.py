"""Queries for triage: candidates, batches, prompts, scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.operators import prompts as R
from prumo.operators import scoring as L
from prumo.operators import triage as Q
from prumo.plans import tables as A
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql
from prumo.session import materialize

NOW = f"TIMESTAMP '{A.NOW}'"

CANDIDATES = f"""open_words AS (
  SELECT id, state, estimated_value, closes_at,
         regexp_extract_all(lower(object || ' ' || coalesce(extra_info, '')), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM tenders WHERE closes_at IS NULL OR closes_at > {NOW}),
keywords AS (SELECT id AS profile_id, unnest(keywords) AS phrase FROM profiles),
profile_words AS (
  SELECT profile_id, list_distinct(flatten(list(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}]+')))) AS words
  FROM keywords GROUP BY profile_id),
fitting AS (
  SELECT DISTINCT k.profile_id, t.id, t.closes_at, t.w
  FROM keywords k JOIN profiles p ON p.id = k.profile_id
  JOIN open_words t ON contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || lower(k.phrase) || ' ')
  WHERE trim(k.phrase) <> ''
    AND (len(p.states) = 0 OR list_contains(p.states, t.state))
    AND (t.estimated_value IS NULL OR p.min_value IS NULL OR t.estimated_value >= p.min_value)
    AND (t.estimated_value IS NULL OR p.max_value IS NULL OR t.estimated_value <= p.max_value)
    AND NOT EXISTS (SELECT 1 FROM triage j WHERE j.profile_id = k.profile_id AND j.tender_id = t.id)),
counted AS (
  SELECT f.profile_id, f.id, f.closes_at, x.lexeme, len(list_filter(f.w, lambda y: y = x.lexeme)) AS tf
  FROM fitting f JOIN (SELECT profile_id, unnest(words) AS lexeme FROM profile_words) x ON x.profile_id = f.profile_id),
scored AS (
  SELECT profile_id, id, closes_at, CAST(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1000000000 // (j * j)))) AS BIGINT) AS rank
  FROM counted WHERE tf > 0 GROUP BY profile_id, id, closes_at),
candidates AS (
  SELECT profile_id, id AS tender_id, rank, row_number() OVER (
    PARTITION BY profile_id ORDER BY rank DESC, closes_at ASC NULLS LAST, id) AS place FROM scored QUALIFY place <= 200)"""

BASE = (A.TENDERS, A.PROFILES, A.TRIAGE)


def stored_tenders(t: Tables) -> DataFrame:
    return t.store("tenders", lambda: A.tenders(t))


def candidate_rows(t: Tables) -> DataFrame:
    return Q.candidates(stored_tenders(t), A.profiles(t), t.store("triage", lambda: A.triage(t)), F.lit(A.NOW).cast("timestamp"))


@query(with_sql(*BASE, CANDIDATES) + "SELECT profile_id, tender_id, rank, place FROM candidates")
def triage_candidates(t: Tables) -> DataFrame:
    """Open, matching, affordable and not yet judged tenders of all profiles at once."""
    return candidate_rows(t).select("profile_id", "tender_id", "rank", F.col("place").cast("long").alias("place"))


def batches(t: Tables) -> DataFrame:
    return materialize(Q.batch_by_rank(candidate_rows(t)).select("profile_id", "tender_id", "batch", "n"), "batches")


BATCHES = """batches AS (
  SELECT profile_id, tender_id, (place - 1) // 20 AS batch, (place - 1) % 20 + 1 AS n FROM candidates)"""

PROMPTS = """lines AS (
  SELECT b.profile_id, b.batch, string_agg(b.n || '. ' || t.object || chr(10) || '   Órgão: ' || t.org || ' (' || t.city || '/' || t.state
           || ') · Valor estimado: ' || CASE WHEN coalesce(t.estimated_value, 0) = 0 THEN 'não informado'
              ELSE 'R$ ' || translate(format('{:,.2f}', CAST(t.estimated_value AS DOUBLE)), ',.', '.,') END, chr(10) ORDER BY b.n) AS body
  FROM batches b JOIN tenders t ON t.id = b.tender_id GROUP BY b.profile_id, b.batch),
prompts AS (
  SELECT l.profile_id, l.batch, 'PERFIL DA EMPRESA' || chr(10) || p.description || chr(10) || 'Atua em: '
    || CASE WHEN len(p.states) = 0 THEN 'todo o Brasil' ELSE array_to_string(p.states, ', ') END
    || chr(10) || chr(10) || 'LICITAÇÕES' || chr(10) || l.body AS prompt
  FROM lines l JOIN profiles p ON p.id = l.profile_id)"""


@query(with_sql(*BASE, CANDIDATES, BATCHES, PROMPTS) + "SELECT profile_id, batch, prompt FROM prompts")
def triage_prompts(t: Tables) -> DataFrame:
    return Q.triage_prompts(batches(t), stored_tenders(t), A.profiles(t)).withColumn("batch", F.col("batch").cast("long"))


def judge(prompt: str) -> list[tuple[int, int, str]]:
    """A fixed rule in place of an external model: the length of the listed object decides. It
    fails on a batch whose first object is short, skips every seventh number, answers some twice
    and adds a number that was not asked."""
    lines = re.findall(r"^(\d+)\. (.+)$", prompt, re.M)
    if len(lines[0][1]) <= 7:
        raise TimeoutError("no answer")
    first = [(int(n), len(o) * 3, "primeira") for n, o in lines if int(n) % 5 == 0]
    kept = [(int(n), min(100, len(o) * 6), f" objeto {o[:5]} ") for n, o in lines if int(n) % 7 != 0]
    return first + kept + [(99, 100, "fora da lista")]


REPLIES = """first_lines AS (SELECT b.profile_id, b.batch, length(t.object) AS chars FROM batches b JOIN tenders t ON t.id = b.tender_id WHERE b.n = 1),
judged AS (
  SELECT b.profile_id, b.tender_id, b.batch, CASE WHEN b.n % 7 <> 0 THEN least(100, length(t.object) * 6) ELSE length(t.object) * 3 END AS score,
         CASE WHEN b.n % 7 <> 0 THEN 'objeto ' || trim(substring(t.object, 1, 5)) ELSE 'primeira' END AS reason
  FROM batches b JOIN tenders t ON t.id = b.tender_id JOIN first_lines f ON f.profile_id = b.profile_id AND f.batch = b.batch
  WHERE f.chars > 7 AND (b.n % 7 <> 0 OR b.n % 5 = 0))"""


def scored(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = batches(t)
    replies = materialize(Q.score_batches(Q.triage_prompts(rows, stored_tenders(t), A.profiles(t)), judge, "regra"), "replies")
    return rows, replies, Q.apply_scores(rows, replies)


@query(
    with_sql(*BASE, CANDIDATES, BATCHES, REPLIES)
    + "SELECT profile_id, tender_id, CAST(score AS BIGINT) AS score, score >= 60 AS relevant, reason, 'regra' AS model FROM judged"
)
def applied_scores(t: Tables) -> DataFrame:
    """Batches through a judge that fails, skips, repeats and invents numbers."""
    return scored(t)[2].withColumn("score", F.col("score").cast("long"))


@query(
    with_sql(*BASE, CANDIDATES, BATCHES, REPLIES)
    + """, answered AS (
  SELECT b.profile_id, b.batch, b.n, t.object AS o FROM batches b JOIN tenders t ON t.id = b.tender_id
  JOIN first_lines f ON f.profile_id = b.profile_id AND f.batch = b.batch WHERE f.chars > 7)
SELECT profile_id, batch, n, CAST(length(o) * 3 AS BIGINT) AS score, 'primeira' AS reason FROM answered WHERE n % 5 = 0
UNION ALL SELECT profile_id, batch, n, CAST(least(100, length(o) * 6) AS BIGINT), ' objeto ' || substring(o, 1, 5) || ' ' FROM answered WHERE n % 7 <> 0
UNION ALL SELECT DISTINCT profile_id, batch, 99, CAST(100 AS BIGINT), 'fora da lista' FROM answered"""
)
def scored_batches(t: Tables) -> DataFrame:
    """The judge's raw replies."""
    _, replies, _ = scored(t)
    return replies.select(
        "profile_id", F.col("batch").cast("long").alias("batch"), "n", F.col("score").cast("long").alias("score"), "reason"
    )


@query(
    with_sql(*BASE, CANDIDATES, BATCHES, REPLIES)
    + """SELECT b.profile_id, b.candidates, coalesce(j.scored, 0) AS scored, coalesce(j.relevant, 0) AS relevant,
           b.batches - coalesce(a.answered, 0) AS failed_batches, CASE WHEN j.scored > 0 THEN 'regra' ELSE '' END AS models
         FROM (SELECT profile_id, count(*) AS candidates, count(DISTINCT batch) AS batches FROM batches GROUP BY profile_id) b
         LEFT JOIN (SELECT profile_id, count(*) AS scored, count(*) FILTER (score >= 60) AS relevant FROM judged GROUP BY profile_id) j
           ON j.profile_id = b.profile_id
         LEFT JOIN (SELECT profile_id, count(*) AS answered FROM first_lines WHERE chars > 7 GROUP BY profile_id) a
           ON a.profile_id = b.profile_id"""
)
def triage_summary(t: Tables) -> DataFrame:
    rows, replies, judged = scored(t)
    return Q.triage_summary(rows, judged, replies)


@query(
    with_sql(*BASE, CANDIDATES, BATCHES, REPLIES)
    + """SELECT profile_id, tender_id, CAST(score AS BIGINT) AS score, model FROM triage
         UNION ALL SELECT profile_id, tender_id, CAST(score AS BIGINT), 'regra' FROM judged"""
)
def appended_triage(t: Tables) -> DataFrame:
    """Earlier judgements with the new ones added; what was judged before is not judged again."""
    before = t.store("triage", lambda: A.triage(t)).withColumn("score", F.col("score").cast("int"))
    _, _, judged = scored(t)
    again = before.limit(0).unionByName(judged).unionByName(before.withColumn("model", F.lit("outra vez")))
    return Q.append_triage(before, again).select("profile_id", "tender_id", F.col("score").cast("long").alias("score"), "model")


# --- documents handed to an external reader ----------------------------------------------

@query(
    with_sql(*A.PAGE_VIEWS, A.PROFILES)
    + """, pairs AS (SELECT s_suppkey AS profile_id, 'src' || s_nationkey % 20 AS tender_id FROM supplier JOIN part ON p_partkey = s_suppkey),
asked AS (SELECT DISTINCT tender_id FROM pairs),
set_tenders AS (
  SELECT source AS id, 'Órgão de ' || source AS org, CASE WHEN source <> 'src3' THEN min(lang) END AS state,
         CASE WHEN source <> 'src5' THEN 'Curitiba' END AS city FROM documents GROUP BY source),
set_items AS (
  SELECT 'src' || p_size % 20 AS tender_id, row_number() OVER (PARTITION BY p_size % 20 ORDER BY p_partkey) AS number,
         CASE WHEN p_size <> 9 THEN p_brand || ' ' || p_name END AS description, CAST(p_size AS DECIMAL(18,4)) AS quantity, CASE WHEN p_type = 'STANDARD' THEN p_type END AS benefit
  FROM part),
totals AS (SELECT tender_id, count(*) AS total FROM set_items GROUP BY tender_id)
SELECT x.profile_id, x.tender_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS at,
  'EMPRESA' || chr(10) || p.description || chr(10) || 'Documentos que a empresa já possui:' || chr(10)
  || array_to_string(list_transform(p.documents, lambda d: '- ' || d), chr(10)) || chr(10) AS text
FROM pairs x JOIN profiles p ON p.id = x.profile_id
UNION ALL
SELECT NULL, x.tender_id, 1, 0,
  'LICITAÇÃO (dados do PNCP)' || chr(10) || 'Órgão: ' || s.org || ' (' || coalesce(s.city, '?') || '/' || coalesce(s.state, '?') || ')' || chr(10) || 'Objeto: Compra de ' || s.id
  || CASE WHEN m.total > 0 THEN chr(10) || 'Itens (' || m.total || ' no total):' ELSE '' END
FROM asked x JOIN set_tenders s ON s.id = x.tender_id LEFT JOIN totals m ON m.tender_id = x.tender_id
UNION ALL
SELECT NULL, x.tender_id, 2, i.number, '- ' || i.number || '. ' || coalesce(i.description, '') || ' ('
  || CASE WHEN i.quantity = 0 THEN '?' ELSE CAST(i.quantity AS VARCHAR) END || ' UN)' || coalesce(' [' || i.benefit || ']', '')
FROM asked x JOIN set_items i ON i.tender_id = x.tender_id WHERE i.number <= 40
UNION ALL
SELECT NULL, x.tender_id, 3, 0, '- ... e mais ' || (m.total - 40) || ' itens' FROM asked x JOIN totals m ON m.tender_id = x.tender_id WHERE m.total > 40
UNION ALL
SELECT NULL, x.tender_id, 4, 0, chr(10) || 'DOCUMENTOS' FROM asked x JOIN set_tenders s ON s.id = x.tender_id
UNION ALL
SELECT NULL, x.tender_id, 5, g.page, CASE WHEN g.first THEN chr(10) || '===== ' || g.document || ' =====' || chr(10) ELSE '' END
  || '[p. ' || g.page || ']' || chr(10) || g.text
FROM asked x JOIN (SELECT *, row_number() OVER (PARTITION BY tender_id, document ORDER BY page) = 1 AS first FROM global_pages) g ON g.tender_id = x.tender_id"""
)
def analysis_prompt_parts(t: Tables) -> DataFrame:
    """The document set of a source, read for every supplier of its number: each company, and once the tender, its
    first forty items and all pages. Some have no city, state or description."""
    from prumo.operators.grouping import number_rows

    part = t.part
    pairs = t.supplier.join(part.select("p_partkey"), F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("profile_id"), F.concat(F.lit("src"), (F.col("s_nationkey") % 20).cast("string")).alias("tender_id")
    )
    tenders = t.documents.groupBy("source").agg(F.min("lang").alias("state")).select(
        F.col("source").alias("id"), F.concat(F.lit("Órgão de "), "source").alias("org"), F.when(F.col("source") != "src5", F.lit("Curitiba")).alias("city"),
        F.when(F.col("source") != "src3", F.col("state")).alias("state"),
        F.concat(F.lit("Compra   de "), "source").alias("object"),
    )
    listed = part.select(
        F.concat(F.lit("src"), (F.col("p_size") % 20).cast("string")).alias("tender_id"),
        "p_partkey",
        F.when(F.col("p_size") != 9, F.concat("p_brand", F.lit("\t "), "p_name")).alias("description"),
        F.col("p_size").cast("decimal(18,4)").alias("quantity"),
        F.lit("UN").alias("unit"),
        F.when(F.col("p_type") == "STANDARD", F.col("p_type")).alias("benefit"),
    )
    items = number_rows(listed, ["tender_id"], [F.col("p_partkey").asc()], "number")
    parts = R.analysis_parts(pairs, A.profiles(t), tenders, items, A.global_pages(t))
    return parts.withColumn("section", F.col("section").cast("long"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'unreadable' WHEN o_totalprice > 300000 THEN 'score'
              WHEN o_orderpriority = '5-LOW' THEN 'reason' ELSE '' END AS error,
              CASE WHEN o_orderstatus = 'F' OR o_totalprice > 300000 OR o_orderpriority = '5-LOW' THEN -1
              ELSE CAST(floor(o_totalprice / 3000) AS BIGINT) END AS score FROM orders"""
)
def validated_replies(t: Tables) -> DataFrame:
    """Triage replies as JSON: cut off, with a score above 100, without a reason, or sound."""
    score = F.floor(F.col("o_totalprice") / 3000).cast("int")
    score = F.when(F.col("o_totalprice") > 300000, F.lit(101)).otherwise(score)
    reason = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    reason = F.when((F.col("o_totalprice") > 300000), F.lit("x")).otherwise(reason)
    reply = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("n"), score.alias("score"), reason.alias("reason"))).alias("evaluations")))
    sent = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.left(reply, F.lit(25)), F.lit("…"))).otherwise(reply).alias("reply")
    )
    out = L.validate_triage(sent, "reply")
    return out.select(
        "o_orderkey", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.col("data.evaluations")[0]["score"].cast("long"), F.lit(-1).cast("long")).alias("score"),
    )
