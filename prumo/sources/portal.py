"""The portal's recorded JSON: tenders, items, document lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import MAX_TITLE
from prumo.functions.text import strip
from prumo.functions.values import exact_decimal, localize
from prumo.schemas import PORTAL_FILE, PORTAL_ITEM, PORTAL_TENDER

# Records are read as text first: the raw record is kept whole, and numbers keep their digits.
ENVELOPE = T.StructType(
    [
        T.StructField("data", T.ArrayType(T.StringType())),
        T.StructField("totalPaginas", T.IntegerType()),
        T.StructField("totalRegistros", T.IntegerType()),
        T.StructField("numeroPagina", T.IntegerType()),
    ]
)


def open_envelopes(envelopes: DataFrame) -> DataFrame:
    """(record, page, total_pages, total_records): one row per record of every envelope."""
    return envelopes.select(
        F.explode("data").alias("record"),
        F.col("numeroPagina").alias("page"),
        F.col("totalPaginas").alias("total_pages"),
        F.col("totalRegistros").alias("total_records"),
    )


def scan_tenders(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Search pages of the portal, one envelope per file (or per line)."""
    return open_envelopes(spark.read.schema(ENVELOPE).json(path, multiLine=multi_line))


def scan_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Files that each hold a list of records; all pages of a list together are the list."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def scan_items(spark: SparkSession, path: str, keys: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    return scan_records(spark, path, T.StructType([*(keys or T.StructType()).fields, *PORTAL_ITEM.fields]), multi_line)


def scan_document_list(spark: SparkSession, path: str, keys: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Listed files that are in force; one that does not say is."""
    listed = scan_records(spark, path, T.StructType([*(keys or T.StructType()).fields, *PORTAL_FILE.fields]), multi_line)
    return listed.where(F.coalesce("statusAtivo", F.lit(True)))


def present(c: Column | str) -> Column:
    """A text, or null when it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parse_tenders(records: DataFrame, record: str = "record") -> DataFrame:
    """Raw records to tender columns. Where the portal has a newer and an older name for a date,
    an empty newer one falls back to the older."""
    blank = F.lit("")
    rest = [c for c in records.columns if c != record]
    return records.withColumn("r", F.from_json(record, PORTAL_TENDER)).select(
        F.col("r.numeroControlePNCP").alias("id"),
        F.col("r.orgaoEntidade.cnpj").alias("cnpj"),
        F.col("r.anoCompra").alias("year"),
        F.col("r.sequencialCompra").alias("seq"),
        F.coalesce("r.orgaoEntidade.razaoSocial", blank).alias("org"),
        F.col("r.unidadeOrgao.nomeUnidade").alias("unit"),
        F.col("r.unidadeOrgao.ufSigla").alias("state"),
        F.col("r.unidadeOrgao.municipioNome").alias("city"),
        F.col("r.modalidadeId").alias("modality_id"),
        F.coalesce("r.modalidadeNome", blank).alias("modality"),
        strip(F.coalesce("r.objetoCompra", blank)).alias("object"),
        F.col("r.informacaoComplementar").alias("extra_info"),
        exact_decimal("r.valorTotalEstimado").alias("estimated_value"),
        F.coalesce("r.srp", F.lit(False)).alias("price_register"),
        F.coalesce("r.situacaoCompraNome", blank).alias("status"),
        localize(F.coalesce(present("r.dataPublicacaoPncp"), F.col("r.dataInclusao"))).alias("published_at"),
        localize("r.dataAberturaProposta").alias("opens_at"),
        localize("r.dataEncerramentoProposta").alias("closes_at"),
        localize(F.coalesce(present("r.dataAtualizacaoGlobal"), F.col("r.dataAtualizacao"))).alias("updated_at"),
        F.col("r.linkSistemaOrigem").alias("source_link"),
        F.col(record).alias("raw"),
        *rest,
    )


def parse_items(records: DataFrame) -> DataFrame:
    portal = {f.name for f in PORTAL_ITEM.fields}
    return records.select(
        *[c for c in records.columns if c not in portal],
        F.col("numeroItem").alias("number"),
        strip(F.coalesce("descricao", F.lit(""))).alias("description"),
        F.col("materialOuServico").alias("kind"),
        exact_decimal("quantidade", 4).alias("quantity"),
        F.col("unidadeMedida").alias("unit"),
        exact_decimal("valorUnitarioEstimado", 4).alias("unit_value"),
        exact_decimal("valorTotal").alias("total_value"),
        F.col("tipoBeneficioNome").alias("benefit"),
        F.col("criterioJulgamentoNome").alias("criterion"),
    )


def parse_documents(records: DataFrame) -> DataFrame:
    portal = {f.name for f in PORTAL_FILE.fields}
    return records.select(
        *[c for c in records.columns if c not in portal],
        F.col("sequencialDocumento").alias("seq"),
        F.substring(strip(F.coalesce("titulo", F.lit(""))), 1, MAX_TITLE).alias("title"),
        F.col("tipoDocumentoId").alias("type_id"),
        F.col("tipoDocumentoNome").alias("type"),
        F.coalesce(present("url"), F.col("uri")).alias("url"),
    )
