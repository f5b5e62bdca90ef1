"""Explicit schemas of the tables and of the portal's JSON. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.DoubleType(),
    T.TimestampType(),
)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# --- stored tables ----------------------------------------------------------------------

TENDERS = struct(
    id=S, cnpj=S, year=I, seq=I, org=S, unit=S, state=S, city=S, modality_id=I, modality=S,
    object=S, extra_info=S, estimated_value=T.DecimalType(18, 2), price_register=B, status=S,
    published_at=TS, opens_at=TS, closes_at=TS, updated_at=TS, source_link=S, raw=S,
    details_state=S, details_attempts=I, details_error=S,
)
ITEMS = struct(
    tender_id=S, number=I, description=S, kind=S, quantity=T.DecimalType(18, 4), unit=S,
    unit_value=T.DecimalType(18, 4), total_value=T.DecimalType(18, 2), benefit=S, criterion=S,
)
DOCUMENTS = struct(
    document_id=L, tender_id=S, seq=I, title=S, type_id=I, type=S, url=S, status=S, format=S,
    file_name=S, size_bytes=L, sha256=S, total_pages=I, attempts=I, error=S, downloaded_at=TS,
)
PAGES = struct(document_id=L, number=I, source_file=S, page_in_file=I, text=S)
SWEEPS = struct(
    day=T.DateType(), modality_id=I, last_page=I, total_pages=I, total_records=I, closed=B, updated_at=TS
)
PROFILES = struct(
    id=I, name=S, description=S, keywords=T.ArrayType(S), states=T.ArrayType(S),
    min_value=T.DecimalType(18, 2), max_value=T.DecimalType(18, 2), documents=T.ArrayType(S),
)
TRIAGE = struct(profile_id=I, tender_id=S, score=I, relevant=B, reason=S, model=S)

# --- analysis result --------------------------------------------------------------------

CITATION = struct(page=I, quote=S)
ANALYSIS_RESULT = struct(
    documents_complete=B,
    summary=S,
    sme_exclusive=S,
    sme_citation=CITATION,
    criterion=S,
    deadlines=T.ArrayType(struct(event=S, when=S, citation=CITATION)),
    requirements=T.ArrayType(
        struct(category=S, demand=S, status=S, company_document=S, citation=CITATION)
    ),
    conditions=T.ArrayType(struct(kind=S, description=S, citation=CITATION)),
    risks=T.ArrayType(struct(description=S, severity=S, citation=CITATION)),
    recommendation=S,
    justification=S,
)

# --- portal JSON ------------------------------------------------------------------------
# Money and quantities are read as text so that no digit passes through a double.

PORTAL_TENDER = struct(
    numeroControlePNCP=S,
    orgaoEntidade=struct(cnpj=S, razaoSocial=S),
    unidadeOrgao=struct(ufSigla=S, municipioNome=S, nomeUnidade=S),
    anoCompra=I, sequencialCompra=I, modalidadeId=I, modalidadeNome=S, situacaoCompraNome=S,
    objetoCompra=S, informacaoComplementar=S, linkSistemaOrigem=S, valorTotalEstimado=S, srp=B,
    dataInclusao=S, dataAtualizacao=S, dataPublicacaoPncp=S, dataAtualizacaoGlobal=S,
    dataAberturaProposta=S, dataEncerramentoProposta=S,
)
PORTAL_ITEM = struct(
    numeroItem=I, descricao=S, materialOuServico=S, quantidade=S, unidadeMedida=S,
    valorUnitarioEstimado=S, valorTotal=S, tipoBeneficioNome=S, criterioJulgamentoNome=S,
)
PORTAL_FILE = struct(
    sequencialDocumento=I, tipoDocumentoId=I, tipoDocumentoNome=S, titulo=S, url=S, uri=S, statusAtivo=B
)
