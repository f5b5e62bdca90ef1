"""Queries for sources and sinks. The files are written by Spark from the given tables first."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.plans import tables as A
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql
from prumo.session import fresh_path
from prumo.sources import files as X
from prumo.sources import portal as P
from prumo.sources import sinks as K
from prumo.streaming import sweep as W

PER_PAGE = 50
FILES_PER_TASK = 200


def portal_records(t: Tables) -> DataFrame:
    """Orders as the portal would publish them, with some of its gaps."""
    status = F.col("o_orderstatus")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    noon = F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")  # clocks change at midnight
    later = F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.struct(
            F.concat(F.lit("000-1-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("numeroControlePNCP"),
            F.struct(F.lit("000").alias("cnpj"), F.when(status != "P", F.col("c_name")).alias("razaoSocial")).alias("orgaoEntidade"),
            F.struct(F.col("c_mktsegment").alias("municipioNome"), F.lit("PR").alias("ufSigla")).alias("unidadeOrgao"),
            F.year("o_orderdate").alias("anoCompra"),
            F.col("o_orderkey").cast("int").alias("sequencialCompra"),
            F.lit(6).alias("modalidadeId"),
            F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\n")).alias("objetoCompra"),
            F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("valorTotalEstimado"),
            F.when(status == "F", F.lit(True)).alias("srp"),
            F.when(status == "O", F.lit("")).otherwise(iso(noon)).alias("dataPublicacaoPncp"),
            iso(noon).alias("dataInclusao"),
            iso(noon).alias("dataAtualizacaoGlobal"),
            F.when(F.col("o_orderkey") % 7 != 0, F.concat(iso(later), F.lit("Z"))).alias("dataEncerramentoProposta"),
            F.lit("x").alias("campoDesconhecido"),
        ).alias("record"),
    )


def envelopes(t: Tables) -> DataFrame:
    """Search pages of fifty records each, one envelope per line."""
    page = F.floor(F.col("o_orderkey") / PER_PAGE).cast("int")
    return (
        portal_records(t)
        .groupBy(page.alias("numeroPagina"))
        .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "record"))).alias("rows"))
        .select(
            F.col("rows.record").alias("data"),
            F.lit(1).alias("totalPaginas"),
            F.size("rows").alias("totalRegistros"),
            (F.col("numeroPagina") + 1).alias("numeroPagina"),
        )
    )


PORTAL = """SELECT '000-1-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, CAST(o_orderkey AS BIGINT) AS seq,
  CASE WHEN o_orderstatus <> 'P' THEN c_name ELSE '' END AS org, c_mktsegment AS city, o_orderpriority AS object,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) * 100 AS BIGINT) ELSE -1 END AS cents,
  o_orderstatus = 'F' AS price_register, epoch_us(o_orderdate + INTERVAL 12 HOURS) AS published_local_us,
  CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate + INTERVAL 10 DAYS) ELSE -1 END AS closes_us
FROM orders JOIN customer ON o_custkey = c_custkey"""


def shown_tenders(parsed: DataFrame) -> DataFrame:
    none = F.lit(-1).cast("long")
    return parsed.select(
        "id", F.col("seq").cast("long").alias("seq"), "org", "city", "object",
        F.coalesce((F.col("estimated_value") * 100).cast("long"), none).alias("cents"), "price_register",
        F.unix_micros(F.from_utc_timestamp("published_at", "America/Sao_Paulo")).alias("published_local_us"),
        F.coalesce(F.unix_micros("closes_at"), none).alias("closes_us"),
    )


@query(PORTAL)
def scanned_tenders(t: Tables) -> DataFrame:
    """Envelopes written as JSON, scanned and parsed."""
    path = fresh_path(t.spark, "envelopes")
    envelopes(t).write.json(path)
    return shown_tenders(P.parse_tenders(P.scan_tenders(t.spark, path, multi_line=False)))


@query(
    """SELECT l_orderkey AS tender_id, l_linenumber AS number, CAST(CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(18,4)) * 10000 AS BIGINT) AS quantity_e4,
         CAST(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, p_name AS description, l_returnflag AS kind
       FROM lineitem JOIN part ON p_partkey = l_partkey"""
)
def scanned_items(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "items")
    t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("numeroItem"),
        F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("descricao"), F.col("l_returnflag").alias("materialOuServico"),
        F.col("l_quantity").alias("quantidade"), F.col("l_extendedprice").alias("valorTotal"),
    ).write.json(path)
    keys = T.StructType([T.StructField("tender_id", T.LongType())])
    parsed = P.parse_items(P.scan_items(t.spark, path, keys, multi_line=False))
    return parsed.select(
        "tender_id", "number", (F.col("quantity") * 10000).cast("long").alias("quantity_e4"),
        (F.col("total_value") * 100).cast("long").alias("cents"), "description", "kind",
    )


@query(
    """SELECT event_id AS tender_id, user_id AS seq, substring(repeat(event_type || ' ', 130), 1, 500) AS title,
         CASE WHEN event_type = 'view' THEN 'https://b/' || event_id ELSE 'https://a/' || event_id END AS url
       FROM events WHERE event_type <> 'error'"""
)
def scanned_document_lists(t: Tables) -> DataFrame:
    """Files out of force are dropped; those that do not say stay. Titles are cut, empty URLs fall back."""
    path = fresh_path(t.spark, "lists")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    t.events.select(
        F.col("event_id").alias("tender_id"), F.col("user_id").cast("int").alias("sequencialDocumento"), F.lit(2).alias("tipoDocumentoId"),
        F.lit("Edital").alias("tipoDocumentoNome"), F.concat(F.lit(" "), F.repeat(F.concat(kind, F.lit(" ")), F.lit(130))).alias("titulo"),
        F.when(kind == "view", F.lit("")).otherwise(F.concat(F.lit("https://a/"), n)).alias("url"),
        F.concat(F.lit("https://b/"), n).alias("uri"),
        F.when(kind == "error", F.lit(False)).when(kind == "click", F.lit(True)).alias("statusAtivo"),
    ).write.json(path)
    keys = T.StructType([T.StructField("tender_id", T.LongType())])
    parsed = P.parse_documents(P.scan_document_list(t.spark, path, keys, multi_line=False))
    return parsed.select("tender_id", F.col("seq").cast("long").alias("seq"), "title", "url")


NO_NAME = "__HIVE_DEFAULT_PARTITION__"
UNSAFE = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_texts(rows: DataFrame, path: str) -> None:
    """Texts of `rows(file, text)`, whose files are whole and in one piece within their tasks, as lines of `file=….txt` in a folder
    per task. Hadoop's local file system starts two processes for every file that it makes; here a file costs its bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = pafs.FileSystem.from_uri(path)
        folder = f"{root}/part-{task.partitionId():05d}"
        system.create_dir(folder)
        # A file under way has another name, as an attempt that ends early may leave it.
        under_way = f"{folder}/{task.taskAttemptId()}.part"
        file, out, made = None, None, 0

        def end() -> None:
            out.close()
            system.move(under_way, f"{folder}/file={file}.txt")

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", name) if name else NO_NAME
                if name != file:
                    if out:
                        end()
                    file, out, made = name, system.open_output_stream(under_way), made + 1
                out.write((text or "").encode() + b"\n")
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["files"])

    rows.select("file", "text").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


@query(
    """SELECT file, bytes, CASE WHEN bytes > 100000 THEN 'arquivo grande: 0 MB' ELSE '' END AS error, CASE WHEN bytes > 100000 THEN '' ELSE digest END AS digest
       FROM (SELECT source || '-' || doc_id // 20 AS file, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest
             FROM documents GROUP BY ALL)"""
)
def scanned_binaries(t: Tables) -> DataFrame:
    """Document texts as files, one per twenty document numbers of a source, scanned as bytes with a small limit: the bytes
    of the small ones are read, those of the large ones are not."""
    path = fresh_path(t.spark, "binaries")
    file = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 20).cast("string"))
    rows = t.documents.select("doc_id", "text", file.alias("file"))
    # Files cost more than their bytes, so tasks are counted by files, of which Spark would give a reading task only 32.
    tasks = max(1, -(-rows.select("file").distinct().count() // FILES_PER_TASK))
    write_texts(rows.repartition(tasks, "file").sortWithinPartitions("file", "doc_id"), path)
    found = X.scan_binaries(t.spark, path, 100_000, glob="*.txt").coalesce(tasks)
    return found.select(
        F.regexp_extract("path", r"file=([^/]+)\.txt$", 1).alias("file"), F.col("size_bytes").alias("bytes"),
        F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("digest"),
    )


@F.pandas_udf(T.BinaryType())
def packed(texts: pd.Series, names: pd.Series) -> pd.Series:
    """Texts as word-processor files inside an archive, next to junk."""

    def pack(text: str, name: str) -> bytes:
        lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
        head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"{head}{lines}</w:body></w:document>")
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("__MACOSX/._x.docx", b"junk")
            z.writestr("planta.dwg", b"AC1032")
            z.writestr(f"pasta/{name}", inner.getvalue())
        return outer.getvalue()

    return pd.Series([pack(x, n) for x, n in zip(texts, names)])


@query(
    with_sql(A.DOCUMENT_PAGES)
    + """SELECT document_id, number, 'Edital ' || document_id || '.docx' AS source_file, text FROM (
           SELECT document_id, CAST(number AS BIGINT) AS number, text FROM doc_pages)"""
)
def extracted_pages(t: Tables) -> DataFrame:
    """Every document packed as DOCX in an archive and read back page by page."""
    name = F.concat(F.lit("Edital "), F.col("doc_id").cast("string"), F.lit(".docx"))
    binaries = t.documents.select(
        F.col("doc_id").alias("document_id"), F.lit("anexos.pdf").alias("name"), packed("text", name).alias("content")
    )
    pages, _ = X.extract_pages(binaries)
    return pages.select("document_id", F.col("number").cast("long").alias("number"), "source_file", "text")


@query(
    with_sql(A.ITEMS, A.ITEMS_LAST)
    + """, touched AS (SELECT o_orderkey AS tender_id FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT tender_id, number, part FROM items_last WHERE tender_id NOT IN (SELECT tender_id FROM touched)
       UNION ALL SELECT tender_id, number + 10, part FROM items_last WHERE tender_id IN (SELECT tender_id FROM touched) AND unit = 'O'"""
)
def children_replaced_in_place(t: Tables) -> DataFrame:
    """A stored item table whose touched tenders get new items."""
    path = fresh_path(t.spark, "item-table")
    rows = A.last_items(t).select("tender_id", "number", "part", "unit")
    K.write_bucketed(rows, path, ["tender_id"], 16)
    touched = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("tender_id"))
    fresh = rows.join(touched, "tender_id", "left_semi").where(F.col("unit") == "O").withColumn("number", F.col("number") + 10)
    K.replace_in_place(fresh, touched, path, ["tender_id"], 16)
    return t.spark.read.schema(K.with_bucket(rows.schema)).parquet(path).select("tender_id", "number", "part")


@query("SELECT doc_id AS name, quality = 1 AS passed, toxic AS invented FROM labels")
def dated_results(t: Tables) -> DataFrame:
    """Scored cases written as JSON under a day and read back."""
    path = fresh_path(t.spark, "results")
    rows = t.labels.select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("passed"), F.col("toxic").alias("invented"))
    K.write_results(rows, path, "2026-11-12")
    return K.read_results(t.spark, path, rows.schema).select("name", "passed", "invented")


@query(PORTAL)
def swept_tenders(t: Tables) -> DataFrame:
    """Envelopes arriving as files, merged micro-batch by micro-batch into a bucketed table."""
    source, state = fresh_path(t.spark, "arrivals"), fresh_path(t.spark, "sweep")
    envelopes(t).repartition(3).write.json(source)
    W.sweep(t.spark, source, state, multi_line=False, files_per_batch=1)
    current = W.swept(t.spark, state)
    return shown_tenders(current)


@query(
    """SELECT strftime(day, '%Y-%m-%d') AS day, CAST(6 AS BIGINT) AS modality_id, CAST(max(page) AS BIGINT) AS last_page, CAST(max(records) AS BIGINT) AS total_records,
         day < DATE '1998-01-01' - 1 AS closed, count(*) AS new, CAST(0 AS BIGINT) AS updated
       FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey // 50 + 1 AS page, count(*) OVER (PARTITION BY o_orderkey // 50) AS records FROM orders) GROUP BY day"""
)
def sweep_progress(t: Tables) -> DataFrame:
    """How far the days of the swept envelopes were read, and the tenders each brought."""
    source, state = fresh_path(t.spark, "arrivals"), fresh_path(t.spark, "sweep")
    envelopes(t).repartition(3).write.json(source)
    W.sweep(t.spark, source, state, multi_line=False, files_per_batch=1)
    done = W.sweep_progress(t.spark, state, today=F.to_date(F.lit("1998-01-01")))
    return done.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.col(c).cast("long").alias(c) for c in ("modality_id", "last_page", "total_records")],
        "closed", "new", "updated",
    )
