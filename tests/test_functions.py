from pyspark.sql import functions as F

from prumo.functions import display as D
from prumo.functions import text as X
from prumo.functions import values as V
from prumo.functions.stemming import stem_pt


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_clean_text(spark):
    row = one(
        spark,
        a=X.clean_text(F.lit("  Edital\x00 nº  12\n\n\n\n  Anexo \t I ")),
        b=X.clean_text(F.lit("a  b \n c")),
    )
    assert row.a == "Edital nº 12\n\nAnexo I" and row.b == "a b\nc"


def test_natural_order_and_main_file(spark):
    names = ["Anexo 10.pdf", "Anexo 2.pdf", "Edital 024.pdf", "Anexo I ao edital.pdf", "2 ata.pdf", "Anexo 1.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(*X.reading_order("n")).collect()]
    assert got == ["Edital 024.pdf", "2 ata.pdf", "Anexo 1.pdf", "Anexo 2.pdf", "Anexo 10.pdf", "Anexo I ao edital.pdf"]


def test_formats_and_names(spark):
    cases = [
        (b"%PDF-1.4", "edital.doc", "pdf"), (b"PK\x03\x04x", "edital.pdf", "zip"), (b"\xd0\xcf\x11\xe0legacy", "x.pdf", "doc"),
        (b"Rar!\x1a\x07", None, "rar"), (b"7z\xbc\xaf", "a", "7z"), (b"texto", "a/b.TXT", "txt"), (b"", None, "desconhecido"),
        (b"x", ".oculto", "desconhecido"),
    ]
    df = spark.createDataFrame(cases, "c binary, n string, want string")
    assert [r.f for r in df.select(X.detect_format("c", "n").alias("f")).collect()] == [c[2] for c in cases]
    heads = [("attachment; filename=\"Edital 1.pdf\"", "Edital 1.pdf"), ("inline; filename*=UTF-8''a%20b.zip; x", "a%20b.zip"), ("inline", None), ("", None)]
    df = spark.createDataFrame(heads, "h string, want string")
    assert [r.f for r in df.select(X.disposition_name("h").alias("f")).collect()] == [h[1] for h in heads]


def test_normal_forms(spark):
    row = one(
        spark,
        a=X.normalize_text(F.lit("“Ａ” – nº 1ª ﬁm… ÇÃO")),
        q=X.normalize_question(F.lit("  É exclusiva p/ ME/EPP?? ﬁm ")),
        n=X.numbers(F.lit("R$ 1.234,56 e 0,5% e 10 e 10 e 2.")),
    )
    assert row.a == '"a" - no 1a fim... ção'
    assert row.q == "e exclusiva p me epp fim"
    assert sorted(row.n) == ["0,5", "1.234,56", "10", "2"]


def test_values(spark):
    row = one(
        spark,
        plain=V.micros(V.localize(F.lit("2026-10-01T00:01:07"))),
        utc=V.micros(V.localize(F.lit("2026-10-01T03:01:07Z"))),
        none=V.localize(F.lit("")),
        exact=V.exact_decimal(F.lit(0.1), 4).cast("string"),
    )
    assert row.plain == row.utc and row.none is None and row.exact == "0.1000"


def test_display(spark):
    row = one(
        spark,
        a=D.format_brl(F.lit("50000")), b=D.format_brl(F.lit(0)), c=D.format_brl(F.lit(None)), d=D.display_brl(F.lit(0)),
        e=D.display_brl(F.lit(None)), f=D.proper_name(F.lit("MUNICIPIO DE PALHOCA E DA ILHA")), g=D.sentence_case(F.lit(" compra \n de papel")),
        h=D.document_title(F.lit("Edital: 8---EDITAL-DE-PREGAO-N_-021-2026.pdf")), i=D.document_title(F.lit("Edital: .pdf")),
        j=D.document_title(F.lit("Edital: Termo de Referência.docx")), k=D.format_place(F.lit(""), F.lit("PR")),
        l=D.document_label(F.lit(None), F.lit("x")), m=D.format_when(F.lit("2026-10-01 03:01:07").cast("timestamp")),
        n=D.document_title(F.lit("Anexo")),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == ("R$ 50.000,00", "não informado", "não informado", "R$ 0,00", "—")
    assert row.f == "Municipio de Palhoca e da Ilha" and row.g == "Compra de papel"
    assert row.h == "Edital: Edital de Pregao N 021 2026" and row.i == "Edital"
    assert row.j == "Edital: Termo de Referência" and row.k == "PR" and row.l == "x" and row.m == "01/10 às 00:01" and row.n == "Anexo"


def test_portuguese_stems_meet():
    for a, b in [("canetas", "caneta"), ("atestados", "atestado"), ("escritório", "escritórios"), ("licitações", "licitação"),
                 ("fornecimento", "fornecimentos"), ("rapidamente", "rapidamente")]:
        assert stem_pt(a) == stem_pt(b)
    assert stem_pt("caneta") != stem_pt("caderno")
    # published examples
    for word, stem in {
        "boa": "boa", "boas": "boas", "bôas": "bôas", "boate": "boat", "boates": "boat", "boatos": "boat", "bobagem": "bobag",
        "bobagens": "bobagens", "boca": "boc", "bocas": "boc", "bochechas": "bochech", "quilométricas": "quilométr", "quilômetros": "quilômetr",
        "quis": "quis", "quiser": "quis", "quisesse": "quis",
    }.items():
        assert stem_pt(word) == stem, (word, stem_pt(word))
