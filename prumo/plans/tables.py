"""The model's tables as views of the given tables, in Spark and, for the checks, in SQL.

The derived columns only give every operator something of each kind to work on: missing
values, deadlines, states, types. No rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.operators.paging import number_pages, paginate
from prumo.plans.registry import Tables

NOW = "2001-06-01 00:00:00"


def with_sql(*parts: str) -> str:
    """A WITH clause from named views, in order."""
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def tenders(t: Tables) -> DataFrame:
    """Orders with their customer, state and the product of their first line."""
    first = t.lineitem.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("p_partkey")
    )
    objects = first.join(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey")
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(objects, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("c_name").alias("org"),
            F.col("n_name").alias("state"),
            F.col("c_mktsegment").alias("city"),
            F.coalesce("p_name", F.lit("")).alias("object"),
            F.col("p_type").alias("extra_info"),
            F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("string").cast("decimal(18,2)")).alias(
                "estimated_value"
            ),
            F.when(
                F.col("o_orderkey") % 7 != 0, (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).cast("timestamp")
            ).alias("closes_at"),
            F.col("o_orderdate").cast("timestamp").alias("updated_at"),
            F.col("o_orderpriority").alias("modality"),
            details_state("o_orderstatus").alias("details_state"),
            (F.col("o_custkey") % 8).cast("int").alias("details_attempts"),
        )
    )


def details_state(c: str):
    return F.when(F.col(c) == "P", "pendente").when(F.col(c) == "F", "falhou").otherwise("ok")


TENDERS = """tenders AS (
  SELECT o_orderkey AS id, c_name AS org, n_name AS state, c_mktsegment AS city,
         coalesce(p_name, '') AS object, p_type AS extra_info,
         CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) END AS estimated_value,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 10 DAYS END AS closes_at,
         o_orderdate AS updated_at, o_orderpriority AS modality,
         CASE o_orderstatus WHEN 'P' THEN 'pendente' WHEN 'F' THEN 'falhou' ELSE 'ok' END AS details_state,
         o_custkey % 8 AS details_attempts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey}).p AS first_part
             FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = first_part)"""


def profiles(t: Tables) -> DataFrame:
    """One profile per supplier: it deals in the product, the material and the type of its own
    part number, in its own nation (every third: everywhere), within a range of values."""
    part = t.part.select("p_partkey", "p_name", "p_type")
    key = F.col("s_suppkey")
    return (
        t.supplier.join(part, key == F.col("p_partkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("Fornece "), F.col("p_name"), F.lit(".")).alias("description"),
            F.array("p_name", F.element_at(F.split("p_name", " "), -1), F.lit(" "), F.lower("p_type")).alias("keywords"),
            F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name")).alias("states"),
            F.when(key % 4 != 0, F.lit(20000).cast("decimal(18,2)")).alias("min_value"),
            F.when(key % 5 != 0, F.lit(400000).cast("decimal(18,2)")).alias("max_value"),
            F.array(F.concat(F.lit("Certidão "), F.col("p_type")), F.lit("Contrato social")).alias("documents"),
        )
    )


PROFILES = """profiles AS (
  SELECT s_suppkey AS id, s_name AS name, 'Fornece ' || p_name || '.' AS description,
         [p_name, string_split(p_name, ' ')[-1], ' ', lower(p_type)] AS keywords,
         CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE [n_name] END AS states,
         CASE WHEN s_suppkey % 4 <> 0 THEN CAST(20000 AS DECIMAL(18,2)) END AS min_value,
         CASE WHEN s_suppkey % 5 <> 0 THEN CAST(400000 AS DECIMAL(18,2)) END AS max_value,
         ['Certidão ' || p_type, 'Contrato social'] AS documents
  FROM supplier JOIN part ON s_suppkey = p_partkey JOIN nation ON s_nationkey = n_nationkey)"""


def triage(t: Tables) -> DataFrame:
    """Judgements of suppliers (profiles) on orders (tenders): the highest quantity decides."""
    best = F.max(F.struct("l_quantity", "l_linestatus", "l_returnflag"))
    return (
        t.lineitem.groupBy(F.col("l_suppkey").alias("profile_id"), F.col("l_orderkey").alias("tender_id"))
        .agg(best.alias("b"))
        .select(
            "profile_id",
            "tender_id",
            (F.col("b.l_quantity") * 2).cast("int").alias("score"),
            (F.col("b.l_quantity") * 2 >= 60).alias("relevant"),
            F.col("b.l_returnflag").alias("reason"),
            F.col("b.l_linestatus").alias("model"),
        )
    )


TRIAGE = """triage AS (
  SELECT profile_id, tender_id, CAST(b.q * 2 AS INTEGER) AS score, b.q * 2 >= 60 AS relevant,
         b.f AS reason, b.s AS model
  FROM (SELECT l_suppkey AS profile_id, l_orderkey AS tender_id,
               max({'q': l_quantity, 's': l_linestatus, 'f': l_returnflag}) AS b
        FROM lineitem GROUP BY l_suppkey, l_orderkey))"""


def analyses(t: Tables) -> DataFrame:
    """Analyses exist for the judgements whose reason is 'R'."""
    return (
        triage(t)
        .where(F.col("reason") == "R")
        .select(
            "profile_id",
            "tender_id",
            F.when(F.col("score") >= 90, "participar").when(F.col("score") >= 60, "avaliar").otherwise("nao_participar").alias(
                "recommendation"
            ),
            (F.col("score") % 9).cast("int").alias("citations_total"),
            F.floor((F.col("score") % 9) / 2).cast("int").alias("citations_verified"),
        )
    )


ANALYSES = """analyses AS (
  SELECT profile_id, tender_id,
         CASE WHEN score >= 90 THEN 'participar' WHEN score >= 60 THEN 'avaliar' ELSE 'nao_participar' END AS recommendation,
         score % 9 AS citations_total, (score % 9) // 2 AS citations_verified
  FROM triage WHERE reason = 'R')"""


def items(t: Tables) -> DataFrame:
    """Lines as items of their order; the key (order, line number) repeats in the data."""
    return t.lineitem.join(t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("tender_id"),
        F.col("l_linenumber").alias("number"),
        F.concat("p_brand", F.lit("  "), "p_name").alias("description"),
        F.col("l_quantity").cast("string").cast("decimal(18,4)").alias("quantity"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_extendedprice").cast("string").cast("decimal(18,2)").alias("total_value"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("l_returnflag")).alias("benefit"),
        F.col("l_shipdate").cast("timestamp").alias("listed_at"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").alias("part"),
        F.col("p_retailprice").cast("string").cast("decimal(18,4)").alias("unit_value"),
    )


ITEMS = """items AS (
  SELECT l_orderkey AS tender_id, l_linenumber AS number, p_brand || '  ' || p_name AS description,
         CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(18,4)) AS quantity, l_linestatus AS unit,
         CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18,2)) AS total_value,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS benefit,
         l_shipdate AS listed_at, l_suppkey AS supplier, l_partkey AS part,
         CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(18,4)) AS unit_value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# Items with one row per key: the last listed wins, other columns break ties.
ITEMS_LAST = """items_last AS (
  SELECT tender_id, number, r.* FROM (
    SELECT tender_id, number, max({'listed_at': listed_at, 'supplier': supplier, 'part': part,
             'description': description, 'quantity': quantity, 'unit': unit,
             'total_value': total_value, 'benefit': benefit, 'unit_value': unit_value}) AS r
    FROM items GROUP BY tender_id, number))"""


def last_items(t: Tables) -> DataFrame:
    from prumo.operators.grouping import keep_last

    return keep_last(items(t), ["tender_id", "number"], ["listed_at", "supplier", "part"])


def documents(t: Tables) -> DataFrame:
    """Documents of a tender (their source), typed by language: Spanish ones are of a kind
    nobody reads."""
    lang = F.col("lang")
    return t.documents.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("tender_id"),
        F.col("doc_id").alias("seq"),
        F.when(lang == "en", 2).when(lang == "fr", 4).when(lang == "de", 6).otherwise(16).alias("type_id"),
        F.when(lang == "en", "Edital").when(lang == "fr", "Termo de Referência").when(lang == "de", "Projeto Básico").alias(
            "type"
        ),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("int").alias("total_pages"),
    )


DOCUMENT_VIEW = """document_view AS (
  SELECT doc_id AS document_id, source AS tender_id, doc_id AS seq,
         CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 4 WHEN 'de' THEN 6 ELSE 16 END AS type_id,
         CASE lang WHEN 'en' THEN 'Edital' WHEN 'fr' THEN 'Termo de Referência' WHEN 'de' THEN 'Projeto Básico' END AS type,
         'doc ' || doc_id AS title, 'ok' AS status
  FROM documents)"""


def document_pages(t: Tables) -> DataFrame:
    """Pages are stored, as the model keeps them; later steps read them more than once."""
    return t.store("pages", lambda: chunked(t), "zstd")


def chunked(t: Tables) -> DataFrame:
    return paginate(t.documents.select(F.col("doc_id").alias("document_id"), "text"), "text").select(
        "document_id",
        "number",
        F.lit(None).cast("string").alias("source_file"),
        F.col("number").alias("page_in_file"),
        "text",
    )


def document_pages_sql(size: int) -> str:
    """Greedy chunks of `size` characters, one line at a time."""
    return DOCUMENT_PAGES.replace("> 3000", f"> {size}")


DOCUMENT_PAGES = """doc_lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line FROM (
    SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(line, '[ \\t\\xA0]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  WHERE line <> ''),
doc_fold(doc_id, i, page, chars) AS (
  SELECT doc_id, CAST(1 AS BIGINT), 1, length(line) FROM doc_lines WHERE i = 1
  UNION ALL
  SELECT f.doc_id, l.i,
         CASE WHEN f.chars + length(l.line) > 3000 THEN f.page + 1 ELSE f.page END,
         CASE WHEN f.chars + length(l.line) > 3000 THEN length(l.line) ELSE f.chars + 1 + length(l.line) END
  FROM doc_fold f JOIN doc_lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
doc_pages AS (
  SELECT l.doc_id AS document_id, f.page AS number, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM doc_lines l JOIN doc_fold f ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY l.doc_id, f.page)"""


def global_pages(t: Tables) -> DataFrame:
    return number_pages(documents(t), document_pages(t))


GLOBAL_PAGES = """global_pages AS (
  SELECT d.tender_id, d.document_id, d.type_id, d.seq, d.type || ': ' || d.title AS document, p.number, p.text,
         row_number() OVER (PARTITION BY d.tender_id ORDER BY d.type_id, d.seq, p.number) AS page
  FROM document_view d JOIN doc_pages p ON d.document_id = p.document_id
  WHERE d.type_id IN (2, 4, 6) AND d.status = 'ok')"""

PAGE_VIEWS = (DOCUMENT_VIEW, DOCUMENT_PAGES, GLOBAL_PAGES)


def sql_norm(x: str) -> str:
    """The comparison form of a text. The given texts hold no character that its first step
    (compatibility normal form) would change."""
    x = f"lower(translate({x}, '“”‘’–—ºª', '\"\"''''--oa'))"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_fragments(normalized: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({normalized}, '\\.{{3,}}|…|\\[\\s*\\.{{0,3}}\\s*\\]'),"
        " lambda p: trim(p, ' .;,:\"''')), lambda p: length(p) >= 12)"
    )
