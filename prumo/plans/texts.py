"""Queries for text, number, date and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.functions import display as D
from prumo.functions import text as X
from prumo.functions import values as V
from prumo.plans.registry import Tables, query
from prumo.plans.tables import sql_fragments, sql_norm


@query(
    """SELECT event_id, CASE event_type
         WHEN 'click' THEN epoch_us(date_trunc('second', ts))
         WHEN 'view' THEN epoch_us(date_trunc('second', ts)) - 2 * 3600000000
         WHEN 'error' THEN -1
         ELSE epoch_us(date_trunc('second', ts)) + 3 * 3600000000 END AS at_us
       FROM events"""
)
def localize_timestamps(t: Tables) -> DataFrame:
    """Portal time texts: with Z, with an offset, empty, and plain Brasília time (UTC-3 in 2024)."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(plain, F.lit("Z")))
        .when(kind == "view", F.concat(plain, F.lit("+02:00")))
        .when(kind == "error", F.lit(""))
        .otherwise(plain)
    )
    return t.events.select(
        "event_id", F.coalesce(F.unix_micros(V.localize(text)), F.lit(-1).cast("long")).alias("at_us")
    )


@query(
    """SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
       FROM orders"""
)
def exact_decimals(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (V.exact_decimal("o_totalprice") * 100).cast("long").alias("cents"))


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         text, '[ \\t\\xA0]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS clean
       FROM documents"""
)
def clean_page_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_text("text").alias("clean"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'doc' WHEN 3 THEN 'rar' WHEN 4 THEN '7z' ELSE lang END AS format
       FROM documents"""
)
def detect_formats(t: Tables) -> DataFrame:
    """Signatures in front of the bytes of five in six files; where there is none the name's suffix decides."""
    from prumo.sources.files import with_format

    kinds = ["pdf", "zip", "doc", "rar", "7z"]
    sign = F
    for i, kind in enumerate(kinds):
        sign = sign.when(F.col("doc_id") % 6 == i, F.lit(X.SIGNATURES[kind]))
    files = t.documents.select(
        "doc_id",
        F.concat(F.coalesce(sign, F.lit(b"")), F.encode("text", "UTF-8")).alias("content"),
        F.concat("source", F.lit(".v1."), F.upper("lang")).alias("name"),
    )
    return with_format(files).select("doc_id", "format")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def digest_and_size(t: Tables) -> DataFrame:
    content = F.encode("text", "UTF-8")
    return t.documents.select(
        "doc_id", X.digest(content).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes")
    )


@query("SELECT doc_id, source || ' ' || lang || '.pdf' AS file_name FROM documents")
def disposition_names(t: Tables) -> DataFrame:
    header = F.concat(F.lit('attachment; filename="'), "source", F.lit(" "), "lang", F.lit('.pdf"; size='), F.length("text").cast("string"))
    return t.documents.select("doc_id", X.disposition_name(header).alias("file_name"))


@query(f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def normalize_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_text("text").alias("norm"))


@query(
    """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(
         strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS question
       FROM conversations"""
)
def normalize_questions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.normalize_question("text").alias("question"))


@query(
    f"""SELECT item_id, i, piece FROM (
         SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
           SELECT item_id, {sql_fragments(sql_norm("replace(text, '. ', ' ... ')"))} AS p FROM benchmark))"""
)
def quote_fragments(t: Tables) -> DataFrame:
    """Sentences joined with ellipses come apart again, short ones are dropped."""
    return t.benchmark.select(
        "item_id", F.posexplode(X.fragments(F.replace("text", F.lit(". "), F.lit(" ... ")))).alias("i", "piece")
    ).select("item_id", (F.col("i") + 1).cast("long").alias("i"), "piece")


@query(
    """SELECT doc_id, CAST(len(n) AS BIGINT) AS count, array_to_string(list_sort(n), '|') AS numbers,
              CAST(len(list_filter(n, lambda x: NOT list_contains(regexp_extract_all(b, '\\d+(?:[.,]\\d+)*'), x))) = 0 AS BOOLEAN) AS in_second_half
       FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*')) AS n,
                    substring(text, CAST(length(text) // 2 AS BIGINT) + 1) AS b FROM documents)"""
)
def numbers_in_text(t: Tables) -> DataFrame:
    half = F.substr("text", (F.floor(F.length("text") / 2) + 1).cast("int"))
    n = X.numbers("text")
    return t.documents.select(
        "doc_id",
        F.size(n).cast("long").alias("count"),
        F.array_join(F.sort_array(n), "|").alias("numbers"),
        X.numbers_subset("text", half).alias("in_second_half"),
    )


@query(
    """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_brand || ' item ' || p_size), '\\d+|\\D+'),
         lambda x: CASE WHEN regexp_matches(x, '^\\d')
           THEN lpad(CAST(length(CAST(CAST(x AS BIGINT) AS VARCHAR)) AS VARCHAR), 4, '0') || ':' || CAST(x AS BIGINT) ELSE x END), '|') AS sort_key
       FROM part"""
)
def natural_sort_keys(t: Tables) -> DataFrame:
    name = F.concat("p_brand", F.lit(" item "), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(X.natural_key(name), "|").alias("sort_key"))


@query(
    """SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_type
         ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, CAST(regexp_extract(p_brand, '\\d+') AS INT), p_partkey) AS place
       FROM part"""
)
def reading_order_of_files(t: Tables) -> DataFrame:
    """Files of a group: the notice first ('Anexo … edital' is not one), then by number in the name."""
    from prumo.operators.grouping import number_rows

    name = F.concat(
        F.when(F.col("p_size") % 2 == 0, F.lit("Edital ")).otherwise(F.lit("Anexo do edital ")),
        F.col("p_brand"),
        F.lit(" "),
        F.col("p_partkey").cast("string"),
        F.lit(".pdf"),
    )
    files = t.part.select("p_partkey", "p_brand", "p_type", name.alias("name"))
    numbered = number_rows(
        files, ["p_type"], X.reading_order("name"), "place",
    )
    return numbered.select("p_partkey", "p_brand", "place")


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, CASE WHEN length({_FLAT}) > 700 THEN substring({_FLAT}, 1, 700) || '…' ELSE {_FLAT} END AS gist,
              substring({_FLAT}, 1, 160) AS line
        FROM documents"""
)
def collapse_and_cut(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", X.collapse_cut("text", 700, "…").alias("gist"), X.collapse_cut("text", 160).alias("line")
    )


_BRL = "translate(format('{:,.2f}', v), ',.', '.,')"


@query(
    f"""SELECT o_orderkey, CASE WHEN v = 0 THEN 'não informado' WHEN v < 0 THEN '-R$ ' || ltrim({_BRL}, '-') ELSE 'R$ ' || {_BRL} END AS prompt_value,
              CASE WHEN v < 0 THEN '-R$ ' || ltrim({_BRL}, '-') ELSE 'R$ ' || {_BRL} END AS shown_value
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS v FROM orders)"""
)
def money_in_reais(t: Tables) -> DataFrame:
    v = F.when(F.col("o_orderstatus") == "P", F.lit("0")).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select(
        "o_orderkey", D.format_brl(v).alias("prompt_value"), D.display_brl(v).alias("shown_value")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '—' ELSE strftime(ts - INTERVAL 3 HOURS, '%d/%m às %H:%M') END AS shown
       FROM events"""
)
def local_date_labels(t: Tables) -> DataFrame:
    at = F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))
    return t.events.select("event_id", D.format_when(at).alias("shown"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name WHEN c_acctbal < 0 THEN c_mktsegment
              ELSE c_mktsegment || '/' || n_name END AS place
       FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def place_labels(t: Tables) -> DataFrame:
    city = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment"))
    state = F.when((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") != "BUILDING"), F.lit(None)).otherwise(F.col("n_name"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", D.format_place(city, state).alias("place")
    )


@query("SELECT p_partkey, upper(substring(p_name, 1, 1)) || substring(p_name, 2) AS shown FROM part")
def sentence_case_objects(t: Tables) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("\n"))
    return t.part.select("p_partkey", D.sentence_case(spaced).alias("shown"))


@query(
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower('DE ' || p_name || ' DA ' || p_type), ' '),
         lambda w, i: CASE WHEN i > 1 AND w IN ('de','da','do','das','dos','e') THEN w
           ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ') AS shown FROM part"""
)
def proper_names(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", D.proper_name(F.concat(F.lit("DE "), "p_name", F.lit(" DA "), "p_type")).alias("shown")
    )


@query(
    """SELECT p_partkey, 'Edital: ' || array_to_string(list_transform(string_split(replace(lower(p_brand), '#', ' ') || ' ' || lower(p_type), ' '),
         lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS shown FROM part"""
)
def document_titles(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit("Edital: "), F.col("p_partkey").cast("string"), F.lit("---"),
        F.upper(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("-"), F.upper("p_type"), F.lit(".PDF"),
    )
    return t.part.select("p_partkey", D.document_title(raw).alias("shown"))


@query(
    "SELECT doc_id, CASE WHEN lang = 'es' THEN source ELSE lang || ': ' || source END AS label FROM documents"
)
def document_labels(t: Tables) -> DataFrame:
    kind = F.when(F.col("lang") != "es", F.col("lang"))
    return t.documents.select("doc_id", D.document_label(kind, "source").alias("label"))


