"""Queries for merges and replacements. The old state is derived from one table, the new batch
from another, so both share keys, differ in some and repeat some."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.operators import merge as M
from prumo.operators import reports as R
from prumo.operators.paging import paginate
from prumo.plans import tables as A
from prumo.plans.listings import FILES, files
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql
from prumo.sources import sinks as K

# The batch: lines by part number against tenders by order number; some orders are unknown.
BATCH = """received AS (
  SELECT l_partkey * 9 AS id, CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS updated_at, l_linestatus || l_quantity AS object,
         l_orderkey AS origin, l_linenumber AS line, l_suppkey AS page, l_extendedprice AS price FROM lineitem),
batch AS (SELECT id, r.u AS updated_at, r.o AS object FROM (
  SELECT id, max({'a': origin, 'n': line, 'p': page, 'x': price, 'u': coalesce(updated_at, TIMESTAMP '1900-01-01'), 'o': object}) AS r FROM received GROUP BY id)),
current AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate ELSE TIMESTAMP '1900-01-01' END AS updated_at,
  o_orderpriority AS object, CASE WHEN o_orderstatus = 'F' THEN 'falhou' ELSE 'ok' END AS details_state, o_custkey % 8 AS details_attempts FROM orders),
merged AS (
  SELECT coalesce(c.id, b.id) AS id, CASE WHEN b.id IS NULL THEN c.updated_at ELSE b.updated_at END AS updated_at,
         CASE WHEN b.id IS NULL THEN c.object ELSE b.object END AS object,
         CASE WHEN b.id IS NOT NULL AND (c.id IS NULL OR b.updated_at <> c.updated_at) THEN 'pendente' ELSE c.details_state END AS details_state,
         CASE WHEN b.id IS NOT NULL AND (c.id IS NULL OR b.updated_at <> c.updated_at) THEN 0 ELSE c.details_attempts END AS details_attempts,
         b.id IS NOT NULL AND c.id IS NULL AS inserted
  FROM current c FULL JOIN batch b ON b.id = c.id)"""


def merge_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    current = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
        F.col("o_orderpriority").alias("object"),
        F.when(F.col("o_orderstatus") == "F", "falhou").otherwise("ok").alias("details_state"),
        (F.col("o_custkey") % 8).cast("int").alias("details_attempts"),
    )
    received = t.lineitem.select(
        (F.col("l_partkey") * 9).alias("id"),
        F.col("l_orderkey").alias("origin"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("page"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "A", F.col("l_shipdate").cast("timestamp")).alias("updated_at"),
        F.concat("l_linestatus", F.col("l_quantity").cast("string")).alias("object"),
    )
    return current, received


ORDER = ["origin", "line", "page", "price"]


def merged_tenders(t: Tables) -> DataFrame:
    return M.merge_tenders(*merge_tables(t), ORDER)


@query(
    with_sql(BATCH)
    + f"""SELECT id, epoch_us(updated_at) AS updated_us, object, details_state, CAST(details_attempts AS BIGINT) AS details_attempts, inserted FROM merged"""
)
def change_aware_merge(t: Tables) -> DataFrame:
    at = F.coalesce(F.unix_micros("updated_at"), F.unix_micros(F.lit("1900-01-01 00:00:00").cast("timestamp")))
    return merged_tenders(t).select(
        "id", at.alias("updated_us"), "object", "details_state", F.col("details_attempts").cast("long").alias("details_attempts"), "inserted"
    )


@query(
    with_sql(BATCH)
    + """SELECT (SELECT count(DISTINCT page) FROM received) AS pages, (SELECT count(*) FROM merged WHERE inserted) AS new,
           (SELECT count(*) FROM received) - (SELECT count(*) FROM merged WHERE inserted) AS updated"""
)
def sweep_counts(t: Tables) -> DataFrame:
    return R.sweep_counts(merge_tables(t)[1], merged_tenders(t))


# Item lists re-read: the tenders of the customers of one segment, numbers shifted by one.
@query(
    with_sql(A.ITEMS, A.ITEMS_LAST)
    + """, touched AS (SELECT o_orderkey AS tender_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
       SELECT tender_id, number, supplier, part FROM items_last WHERE tender_id NOT IN (SELECT tender_id FROM touched)
       UNION ALL
       SELECT tender_id, number, r.supplier, r.part FROM (
         SELECT tender_id, number // 2 AS number, max({'listed_at': listed_at, 'supplier': supplier, 'part': part, 'd': description, 'q': quantity}) AS r
         FROM items WHERE tender_id IN (SELECT tender_id FROM touched) AND unit = 'F' GROUP BY tender_id, number // 2)"""
)
def replaced_items(t: Tables) -> DataFrame:
    touched = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .where(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("o_orderkey").alias("tender_id"))
    )
    listed = (
        A.items(t).where(F.col("unit") == "F").join(touched, "tender_id", "left_semi")
        .withColumn("number", F.floor(F.col("number") / 2).cast("int"))
    )
    return M.replace_items(A.last_items(t), listed, touched, ["listed_at", "supplier", "part"]).select("tender_id", "number", "supplier", "part")


# Document lists re-read for the tenders that are open orders: slots of cheap events vanish, the
# address of errors changes, views are new at the next tender.
LISTED = """old_files AS (SELECT *, 'u' || seq AS url FROM files),
touched AS (SELECT o_orderkey AS tender_id FROM orders WHERE o_orderstatus = 'O'),
listed AS (
  SELECT tender_id, seq, upper(title) AS title, type_id, CASE WHEN type_id = 16 THEN 'v2' ELSE 'u' || seq END AS url
  FROM files WHERE attempts <> 0 AND tender_id IN (SELECT tender_id FROM touched)
  UNION ALL
  SELECT tender_id + 1, seq, 'NOVO', type_id, 'n' || seq FROM files WHERE type_id = 4 AND tender_id + 1 IN (SELECT tender_id FROM touched))"""


def document_lists(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    old = files(t).withColumn("type", F.lit("")).withColumn("url", F.concat(F.lit("u"), F.col("seq").cast("string")))
    touched = t.orders.where(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("tender_id"))
    stay = old.where(F.col("attempts") != 0).select(
        "tender_id", "seq", F.upper("title").alias("title"), "type_id", "type",
        F.when(F.col("type_id") == 16, F.lit("v2")).otherwise(F.col("url")).alias("url"),
    )
    new = old.where(F.col("type_id") == 4).select(
        (F.col("tender_id") + 1).alias("tender_id"), "seq", F.lit("NOVO").alias("title"), "type_id", "type",
        F.concat(F.lit("n"), F.col("seq").cast("string")).alias("url"),
    )
    return old, stay.unionByName(new), touched


@query(
    with_sql(FILES, LISTED)
    + """SELECT tender_id, seq, title, url, status, CAST(attempts AS BIGINT) AS attempts FROM old_files WHERE tender_id NOT IN (SELECT tender_id FROM touched)
         UNION ALL
         SELECT l.tender_id, l.seq, l.title, l.url,
           CASE WHEN o.seq IS NULL OR o.url <> l.url THEN 'pendente' ELSE o.status END,
           CASE WHEN o.seq IS NULL OR o.url <> l.url THEN 0 ELSE o.attempts END
         FROM listed l LEFT JOIN old_files o ON o.tender_id = l.tender_id AND o.seq = l.seq"""
)
def reconciled_documents(t: Tables) -> DataFrame:
    old, listed, touched = document_lists(t)
    return M.reconcile_documents(old, listed, touched).select(
        "tender_id", "seq", "title", "url", "status", F.col("attempts").cast("long").alias("attempts")
    )


# Labelled documents are read again whole, into pages of half the size; Spanish documents are gone.
@query(
    with_sql(A.DOCUMENT_PAGES)
    + ", "
    + re.sub(r"\b(doc_\w+)", r"half_\1", A.document_pages_sql(1500)).replace("half_doc_id", "doc_id")
    + """SELECT document_id, CAST(number AS BIGINT) AS number, p.text FROM doc_pages p JOIN documents d ON d.doc_id = document_id
         WHERE d.lang <> 'es' AND document_id NOT IN (SELECT doc_id FROM labels)
         UNION ALL
         SELECT document_id, CAST(number AS BIGINT), p.text FROM half_doc_pages p JOIN documents d ON d.doc_id = document_id
         WHERE d.lang <> 'es' AND document_id IN (SELECT doc_id FROM labels)"""
)
def replaced_pages(t: Tables) -> DataFrame:
    again = t.documents.join(t.labels, "doc_id", "left_semi").select(F.col("doc_id").alias("document_id"), "text")
    read = paginate(again, "text", 1500).select(
        "document_id", "number", F.lit(None).cast("string").alias("source_file"), F.col("number").alias("page_in_file"), "text"
    )
    left = A.documents(t).where(F.col("type_id") != 16)
    return M.replace_pages(A.document_pages(t), read, left).select("document_id", F.col("number").cast("long").alias("number"), "text")


@query(
    with_sql(A.TRIAGE, A.ANALYSES)
    + """, fresh AS (SELECT profile_id, tender_id, 'novo' AS recommendation FROM triage WHERE reason <> 'A'),
       readable AS (SELECT event_id AS tender_id FROM events),
       accepted AS (SELECT * FROM fresh WHERE tender_id IN (SELECT tender_id FROM readable))
       SELECT profile_id, tender_id, recommendation FROM analyses a
       WHERE NOT EXISTS (SELECT 1 FROM accepted f WHERE f.profile_id = a.profile_id AND f.tender_id = a.tender_id)
       UNION ALL SELECT * FROM accepted"""
)
def replaced_analyses(t: Tables) -> DataFrame:
    """New analyses for pairs with and without an old one; some tenders have no readable pages."""
    old = A.analyses(t).select("profile_id", "tender_id", "recommendation")
    fresh = A.triage(t).where(F.col("reason") != "A").select("profile_id", "tender_id", F.lit("novo").alias("recommendation"))
    pages = t.events.select(F.col("event_id").alias("tender_id"))
    return M.replace_analyses(old, fresh, pages)


OUTCOMES = """outcomes AS (
  SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'falhou' WHEN '3-MEDIUM' THEN 'nao_suportado' END AS outcome,
         repeat('erro ', 1 + o_custkey % 300) AS message FROM orders WHERE o_orderpriority < '4')"""


@query(
    with_sql(A.TENDERS, OUTCOMES)
    + """SELECT t.id, coalesce(o.outcome, t.details_state) AS state,
           CAST(t.details_attempts + CASE WHEN o.outcome = 'falhou' THEN 1 ELSE 0 END AS BIGINT) AS attempts,
           CAST(t.details_attempts + CASE WHEN o.id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS reads,
           CASE WHEN o.id IS NULL THEN 'antes' WHEN o.outcome = 'ok' THEN '' ELSE substring(o.message, 1, 1000) END AS error
         FROM tenders t LEFT JOIN outcomes o ON o.id = t.id"""
)
def recorded_outcomes(t: Tables) -> DataFrame:
    queue = A.tenders(t).select("id", "details_state", "details_attempts", F.lit("antes").alias("details_error"), F.col("details_attempts").alias("reads"))
    p = F.col("o_orderpriority")
    outcomes = t.orders.where(p < "4").select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1-URGENT", "ok").when(p == "2-HIGH", "falhou").when(p == "3-MEDIUM", "nao_suportado").alias("outcome"),
        F.expr("repeat('erro ', cast(1 + o_custkey % 300 as int))").alias("message"),
    )
    once = M.record_outcomes(queue, outcomes, "id", "details_state", "details_attempts", "details_error")
    reads = M.record_outcomes(queue, outcomes, "id", "details_state", "reads", "details_error", every_read_counts=True)
    return once.drop("reads").join(reads.select("id", "reads"), "id").select(
        "id", F.col("details_state").alias("state"), F.col("details_attempts").cast("long").alias("attempts"),
        F.col("reads").cast("long").alias("reads"), F.coalesce("details_error", F.lit("")).alias("error"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascaded_deletes(t: Tables) -> DataFrame:
    """Lines of orders that were removed go with them."""
    left = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.cascade_delete(t.lineitem, left, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'full' AS held, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'empty', r_regionkey, r_name FROM region")
def seeded_tables(t: Tables) -> DataFrame:
    """Seed rows for a table that has rows are not added; for one that never got a row they are."""
    table = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    seed = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    bare = t.spark.createDataFrame([], table.schema)
    return K.seed_if_empty(table, seed).select(F.lit("full").alias("held"), "id", "name").unionByName(
        K.seed_if_empty(bare, seed).select(F.lit("empty").alias("held"), "id", "name")
    )
