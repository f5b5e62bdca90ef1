"""Queries for predicates, chunking, page numbers and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.functions import predicates as P
from prumo.functions import text as X
from prumo.operators import boards as B
from prumo.operators import grouping as G
from prumo.operators import paging
from prumo.plans import tables as A
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql

NOW = f"TIMESTAMP '{A.NOW}'"


def now():
    return F.lit(A.NOW).cast("timestamp")


@query(
    with_sql(A.TENDERS)
    + """SELECT id FROM tenders
         WHERE estimated_value IS NULL OR ((modality = '1-URGENT' OR estimated_value >= 50000) AND (modality = '5-LOW' OR estimated_value <= 300000))"""
)
def value_range_or_unknown(t: Tables) -> DataFrame:
    """Bounds differ per row and either may be missing."""
    low = F.when(F.col("modality") != "1-URGENT", F.lit(50000))
    high = F.when(F.col("modality") != "5-LOW", F.lit(300000))
    return A.tenders(t).where(P.in_range_or_unknown("estimated_value", low, high)).select("id")


@query(with_sql(A.TENDERS) + f"SELECT id, closes_at IS NULL AS no_deadline FROM tenders WHERE closes_at IS NULL OR closes_at > {NOW}")
def open_tenders(t: Tables) -> DataFrame:
    return A.tenders(t).where(P.is_open("closes_at", now())).select("id", F.col("closes_at").isNull().alias("no_deadline"))


@query(
    with_sql(A.TENDERS, A.PROFILES)
    + """SELECT p.id AS profile_id, count(*) AS tenders FROM profiles p JOIN tenders t
         ON len(p.states) = 0 OR list_contains(p.states, t.state) GROUP BY p.id"""
)
def states_served(t: Tables) -> DataFrame:
    """Tenders of the states each profile serves; an empty state list admits every state. Tenders are counted
    by state first, profiles by their list, so nothing is paired but states with lists of states."""
    counts = A.tenders(t).groupBy("state").agg(F.count("*").alias("n"))
    lists = A.profiles(t).select(F.col("id").alias("profile_id"), F.array_sort(F.array_distinct("states")).alias("states"))
    # A list admits its own states; the empty one meets every state through a key of its own.
    keyed = lists.select("states").distinct().select("states", F.explode_outer("states").alias("key"))
    reached = counts.select("*", F.explode(F.array(F.col("state"), F.lit(None).cast("string"))).alias("reach"))
    served = (
        keyed.join(reached, F.col("key").eqNullSafe(F.col("reach")))
        .where(P.member_or_all("state", "states") & (F.col("key").isNotNull() | (F.size("states") == 0)))
        .groupBy("states")
        .agg(F.sum("n").alias("tenders"))
    )
    return lists.join(served, "states").select("profile_id", "tenders")


@query(with_sql(A.DOCUMENT_VIEW) + "SELECT document_id, type_id FROM document_view WHERE type_id IN (2, 4, 6)")
def readable_types(t: Tables) -> DataFrame:
    return A.documents(t).where(P.is_readable_type("type_id")).select("document_id", "type_id")


@query(
    with_sql(A.TENDERS)
    + "SELECT id FROM tenders WHERE details_state = 'pendente' OR (details_state = 'falhou' AND details_attempts < 5)"
)
def work_queue(t: Tables) -> DataFrame:
    return A.tenders(t).where(P.eligible("details_state", "details_attempts")).select("id")


@query(
    with_sql(A.DOCUMENT_PAGES)
    + """SELECT document_id, number FROM doc_pages WHERE document_id IN (
           SELECT document_id FROM doc_pages GROUP BY document_id HAVING sum(length(text)) >= 80 * count(*))"""
)
def documents_with_text(t: Tables) -> DataFrame:
    """Documents with too few characters per page are scans."""
    return P.drop_scanned(A.document_pages(t), ["document_id"]).select("document_id", F.col("number").cast("long").alias("number"))


@query(
    """SELECT doc_id, contains(text, 'tion') AND contains(text, 'en ') AS has_all FROM documents"""
)
def contains_all_pieces(t: Tables) -> DataFrame:
    pieces = F.array(F.lit("tion"), F.lit("en "))
    return t.documents.select("doc_id", P.contains_all("text", pieces).alias("has_all"))


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN regexp_matches(lower(text), '(?i)\\bTHE\\b') AND regexp_matches(lower(text), '(?i)ing?\\b')
         ELSE regexp_matches(lower(text), '(?i)E[NR]\\w') END AS matched FROM documents"""
)
def matches_all_patterns(t: Tables) -> DataFrame:
    """The patterns are a column: they differ by language."""
    patterns = F.when(F.col("lang") == "en", F.array(F.lit(r"\bTHE\b"), F.lit(r"ing?\b"))).otherwise(
        F.array(F.lit(r"E[NR][0-9A-Za-z_]"))
    )
    return t.documents.select("doc_id", P.matches_all("text", patterns).alias("matched"))


HISTORY = """numbered_turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
histories AS (
  SELECT a.conv_id, a.turn, a.text, list(b.text ORDER BY b.n) FILTER (b.text IS NOT NULL) AS history
  FROM numbered_turns a LEFT JOIN numbered_turns b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 6 AND a.n - 1
  GROUP BY a.conv_id, a.turn, a.text)"""


@query(
    with_sql(HISTORY)
    + """SELECT conv_id, turn, length(text) BETWEEN 3 AND 500 AND coalesce(len(history), 0) <= 6
           AND len(list_filter(coalesce(history, []), lambda h: length(h) > 4000)) = 0 AS valid FROM histories"""
)
def valid_questions(t: Tables) -> DataFrame:
    """Every turn as a question with the turns before it; the flag splits accepted from refused."""
    asked = B.with_history(t.conversations)
    return asked.select("conv_id", "turn", P.valid_question("text", "history").alias("valid"))


@query(
    with_sql(HISTORY)
    + """SELECT conv_id, turn, coalesce(len(history), 0) AS turns_before, coalesce(array_to_string(history, '¦'), '') AS history
         FROM histories"""
)
def turns_before_question(t: Tables) -> DataFrame:
    asked = B.with_history(t.conversations)
    return asked.select(
        "conv_id", "turn", F.size("history").cast("long").alias("turns_before"), F.array_join("history", "¦").alias("history")
    )


@query(with_sql(A.DOCUMENT_PAGES) + "SELECT document_id, CAST(number AS BIGINT) AS number, text FROM doc_pages")
def page_chunks(t: Tables) -> DataFrame:
    return A.chunked(t).select("document_id", F.col("number").cast("long").alias("number"), "text")


@query(
    with_sql(A.DOCUMENT_VIEW, A.DOCUMENT_PAGES)
    + """SELECT v.tender_id AS archive, p.document_id AS file, CAST(p.number AS BIGINT) AS page_in_file,
           row_number() OVER (PARTITION BY v.tender_id ORDER BY p.document_id % 2, p.document_id, p.number) AS number
         FROM doc_pages p JOIN document_view v ON p.document_id = v.document_id"""
)
def archive_page_numbers(t: Tables) -> DataFrame:
    """The documents of a source as the files of one archive: notices first, then by number."""
    pages = A.document_pages(t).join(A.documents(t).select("document_id", "tender_id"), "document_id")
    files = pages.select(
        F.col("document_id").alias("file"),
        F.col("tender_id").alias("document_id"),
        F.concat(
            F.when(F.col("document_id") % 2 == 0, F.lit("Edital ")).otherwise(F.lit("Anexo ")),
            F.col("document_id").cast("string"),
            F.lit(".pdf"),
        ).alias("source_file"),
        "page_in_file",
    )
    return paging.number_in_document(files).select(
        F.col("document_id").alias("archive"), "file", F.col("page_in_file").cast("long").alias("page_in_file"),
        F.col("number").cast("long").alias("number"),
    )


@query(with_sql(*A.PAGE_VIEWS) + "SELECT tender_id, document_id, CAST(number AS BIGINT) AS number, page, document FROM global_pages")
def global_page_numbers(t: Tables) -> DataFrame:
    return A.global_pages(t).select("tender_id", "document_id", F.col("number").cast("long").alias("number"), "page", "document")


@query(
    with_sql(*A.PAGE_VIEWS)
    + """SELECT tender_id, page, document, row_number() OVER (PARTITION BY tender_id, document ORDER BY page) = 1 AS starts_document
         FROM global_pages"""
)
def document_boundaries(t: Tables) -> DataFrame:
    return B.document_boundaries(A.global_pages(t).select("tender_id", "page", "document"))


@query(
    with_sql(A.DOCUMENT_PAGES)
    + """SELECT p.document_id, CAST(p.number AS BIGINT) AS number, 'doc ' || p.document_id AS document, p.text FROM doc_pages p
         JOIN (SELECT DISTINCT doc_id, 1 + quality AS number FROM labels) r ON r.doc_id = p.document_id AND r.number = p.number"""
)
def page_lookup(t: Tables) -> DataFrame:
    """A batch of references; those past the last page find nothing."""
    refs = t.labels.select(F.col("doc_id").alias("document_id"), (1 + F.col("quality")).alias("number"))
    return paging.lookup_pages(refs, A.document_pages(t), A.documents(t)).select(
        "document_id", F.col("number").cast("long").alias("number"), "document", "text"
    )


@query(
    with_sql(*A.PAGE_VIEWS)
    + """SELECT r.tender_id, r.page, coalesce(substring(p.text, 1, 8000), '') AS text,
           CASE WHEN p.page IS NULL THEN 'a página ' || r.page || ' não existe; as páginas vão de 1 a ' || coalesce(m.last, 0) ELSE '' END AS error
         FROM (SELECT DISTINCT d.source AS tender_id, l.doc_id AS page FROM labels l JOIN documents d ON d.doc_id = l.doc_id) r
         LEFT JOIN global_pages p ON p.tender_id = r.tender_id AND p.page = r.page
         LEFT JOIN (SELECT tender_id, max(page) AS last FROM global_pages GROUP BY tender_id) m ON m.tender_id = r.tender_id"""
)
def read_pages(t: Tables) -> DataFrame:
    """Pages asked for by number; many numbers lie beyond the last page."""
    refs = t.labels.join(t.documents, "doc_id").select(F.col("source").alias("tender_id"), F.col("doc_id").alias("page")).distinct()
    return paging.read_pages(refs, A.global_pages(t)).select(
        "tender_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error")
    )


@query(
    with_sql(A.ITEMS, A.ITEMS_LAST)
    + "SELECT tender_id, number, supplier, part, epoch_us(listed_at) AS listed_us FROM items_last"
)
def last_per_key(t: Tables) -> DataFrame:
    return A.last_items(t).select("tender_id", "number", "supplier", "part", F.unix_micros("listed_at").alias("listed_us"))


@query(
    with_sql(A.TRIAGE)
    + """SELECT profile_id, tender_id, CAST((place - 1) // 20 AS BIGINT) AS batch, CAST((place - 1) % 20 + 1 AS BIGINT) AS n
         FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, tender_id) AS place FROM triage)"""
)
def batches_by_rank(t: Tables) -> DataFrame:
    """All judgements of a profile in batches of twenty, best first."""
    from prumo.operators.triage import batch_by_rank

    ranked = G.number_rows(
        t.store("triage", lambda: A.triage(t)), ["profile_id"], [F.col("score").desc(), F.col("tender_id").asc()], "place"
    )
    return batch_by_rank(ranked).select(
        "profile_id", "tender_id", F.col("batch").cast("long").alias("batch"), F.col("n").cast("long").alias("n")
    )


@query(
    with_sql(A.TENDERS)
    + f"""SELECT id, coalesce(epoch_us(closes_at), -1) AS closes_us FROM tenders
         WHERE (details_state = 'pendente' OR (details_state = 'falhou' AND details_attempts < 5))
           AND (closes_at IS NULL OR closes_at > {NOW}) ORDER BY closes_at ASC NULLS LAST, id LIMIT 500"""
)
def detail_queue(t: Tables) -> DataFrame:
    return B.detail_queue(A.tenders(t), now(), 500).select("id", F.coalesce(F.unix_micros("closes_at"), F.lit(-1).cast("long")).alias("closes_us"))


@query(
    with_sql(A.ITEMS, A.ITEMS_LAST)
    + """SELECT tender_id, number, place, total, greatest(total - 2, 0) AS rest FROM (
           SELECT tender_id, number, row_number() OVER (PARTITION BY tender_id ORDER BY number) AS place,
                  count(*) OVER (PARTITION BY tender_id) AS total FROM items_last) WHERE place <= 2"""
)
def head_and_rest(t: Tables) -> DataFrame:
    """The first two items of every tender and how many more there are."""
    return B.head_and_rest(A.last_items(t), 2).select(
        "tender_id", "number", F.col("place").cast("long").alias("place"), "total", "rest"
    )


# Stored questions are the user turns, asked about one of twenty tenders; every third
# conversation was asked with history.
QUESTIONS = """questions AS (
  SELECT conv_id * 100 + turn AS id, conv_id % 20 AS tender_id, role || ' ' || length(text) % 9 AS normalized,
         conv_id % 3 = 0 AS with_history, text AS answer FROM conversations)"""


def questions(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 20).alias("tender_id"),
        X.normalize_question(F.concat(F.initcap("role"), F.lit(", "), (F.length("text") % 9).cast("string"), F.lit("?"))).alias(
            "normalized"
        ),
        (F.col("conv_id") % 3 == 0).alias("with_history"),
        F.col("text").alias("answer"),
    )


@query(
    with_sql(QUESTIONS)
    + """SELECT r.id AS request_id, q.id AS question_id, q.answer
         FROM questions r JOIN (
           SELECT *, row_number() OVER (PARTITION BY tender_id, normalized ORDER BY id DESC) AS k FROM questions WHERE NOT with_history) q
           ON q.k = 1 AND r.tender_id = q.tender_id AND r.normalized = q.normalized
         WHERE NOT r.with_history"""
)
def cached_answers(t: Tables) -> DataFrame:
    asked = questions(t)
    requests = asked.select(F.col("id").alias("request_id"), "tender_id", "normalized", "with_history")
    return B.cached_answers(requests, asked).select("request_id", "question_id", "answer")
