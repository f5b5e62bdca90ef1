"""Merges, boards, evaluation and reply checks on small tables."""

from pyspark.sql import functions as F

from prumo.operators import boards as B
from prumo.operators import merge as M
from prumo.operators import reports as R
from prumo.operators import scoring as L
from prumo.operators.paging import number_pages, read_pages
from prumo.operators.prompts import analysis_parts


def test_change_aware_merge(spark):
    schema = "id string, cnpj string, object string, updated_at string, details_state string, details_attempts int"
    current = spark.createDataFrame(
        [("a", "1", "x", "t1", "ok", 2), ("b", "1", "x", "t1", "falhou", 3), ("c", "1", "x", None, "ok", 1), ("d", "1", "x", None, "ok", 1)], schema
    )
    batch = spark.createDataFrame(
        [("a", "9", "y", "t1", 1), ("b", "9", "old", "t0", 1), ("b", "9", "new", "t2", 2), ("c", "9", "y", None, 1), ("e", "9", "z", "t1", 1)],
        "id string, cnpj string, object string, updated_at string, seq_no int",
    )
    out = M.merge_tenders(current, batch, ["seq_no"])
    got = {r.id: (r.cnpj, r.object, r.details_state, r.details_attempts, r.inserted) for r in out.collect()}
    assert got == {
        "a": ("1", "y", "ok", 2, False), "b": ("1", "new", "pendente", 0, False), "c": ("1", "y", "ok", 1, False),
        "d": ("1", "x", "ok", 1, False), "e": ("9", "z", "pendente", 0, True),
    }
    counts = R.sweep_counts(batch.withColumn("page", F.lit(1)), out).first()
    assert (counts.pages, counts.new, counts.updated) == (1, 1, 4)


def test_document_lists(spark):
    cols = "tender_id string, seq int, title string, type_id int, type string, url string"
    old = spark.createDataFrame(
        [("A", 1, "t", 2, "E", "u1", "ok", 1), ("A", 2, "t", 2, "E", "u2", "ok", 1), ("A", 3, "t", 2, "E", "u3", "falhou", 4),
         ("B", 1, "t", 2, "E", "u", "ok", 1), ("C", 1, "t", 2, "E", "u", "ok", 1)], cols + ", status string, attempts int")
    listed = spark.createDataFrame([("A", 1, "novo", 2, "E", "u1"), ("A", 2, "t", 2, "E", "outra"), ("A", 4, "t", 2, "E", "u4")], cols)
    touched = spark.createDataFrame([("A",), ("B",)], "tender_id string")  # B's list came back empty, C could not be read
    got = {(r.tender_id, r.seq, r.title, r.status, r.attempts) for r in M.reconcile_documents(old, listed, touched).collect()}
    assert got == {("A", 1, "novo", "ok", 1), ("A", 2, "t", "pendente", 0), ("A", 4, "t", "pendente", 0), ("C", 1, "t", "ok", 1)}


def test_outcomes_and_cascades(spark):
    queue = spark.createDataFrame([(1, "pendente", 0, None), (2, "falhou", 1, "e"), (3, "pendente", 0, "x"), (4, "ok", 0, None)],
                                  "id int, s string, a int, e string")
    told = spark.createDataFrame([(1, "ok", None), (2, "falhou", "y" * 2000), (3, "nao_suportado", "scan")], "id int, outcome string, message string")
    got = {r.id: (r.s, r.a, len(r.e or "")) for r in M.record_outcomes(queue, told, "id", "s", "a", "e").collect()}
    assert got == {1: ("ok", 0, 0), 2: ("falhou", 2, 1000), 3: ("nao_suportado", 0, 4), 4: ("ok", 0, 0)}
    got = {r.id: r.a for r in M.record_outcomes(queue, told, "id", "s", "a", "e", every_read_counts=True).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 0}


def test_reading_round(spark):
    from prumo.schemas import DOCUMENTS

    blank = dict.fromkeys(DOCUMENTS.fieldNames())
    row = lambda i, **kw: tuple({**blank, "document_id": i, "status": "pendente", "attempts": 0, **kw}.values())
    docs = spark.createDataFrame([row(1), row(2, sha256="old", total_pages=7), row(3, sha256="old", attempts=2), row(4, status="ok")], DOCUMENTS)
    reads = spark.createDataFrame(
        [(1, "a.pdf", "pdf", 10, "s1", "ok", None, 3), (2, "b", "doc", 5, "s2", "nao_suportado", "formato doc", None),
         (3, None, None, None, None, "falhou", "503", None)],
        "document_id long, file_name string, format string, size_bytes long, sha256 string, outcome string, message string, total_pages int")
    now = F.lit("2026-10-05 12:00:00").cast("timestamp")
    got = {r.document_id: r for r in M.record_reads(docs, reads, now).collect()}
    assert (got[1].status, got[1].attempts, got[1].sha256, got[1].total_pages) == ("ok", 1, "s1", 3) and got[1].downloaded_at is not None
    assert (got[2].status, got[2].format, got[2].error, got[2].total_pages, got[2].downloaded_at) == ("nao_suportado", "doc", "formato doc", 7, None)
    assert (got[3].status, got[3].attempts, got[3].sha256, got[3].error) == ("falhou", 3, "old", "503")
    assert (got[4].status, got[4].attempts) == ("ok", 0)


def test_analyses_need_readable_pages(spark):
    old = spark.createDataFrame([(1, "A", "x"), (1, "B", "x")], "profile_id int, tender_id string, recommendation string")
    fresh = spark.createDataFrame([(1, "A", "y"), (1, "B", "y"), (2, "A", "y")], old.schema)
    pages = spark.createDataFrame([("A", 1)], "tender_id string, page int")
    got = {tuple(r) for r in M.replace_analyses(old, fresh, pages).collect()}
    assert got == {(1, "A", "y"), (2, "A", "y"), (1, "B", "x")}


def test_board_and_cache(spark):
    triage = spark.createDataFrame([(1, "a", 70, True), (1, "b", 90, True), (1, "c", 5, False)], "profile_id int, tender_id string, score int, relevant boolean")
    analyses = spark.createDataFrame([(1, "a", "avaliar", 4, 3)], "profile_id int, tender_id string, recommendation string, citations_total int, citations_verified int")
    tenders = spark.createDataFrame([(x, x) for x in "abc"], "id string, object string")
    board = B.triage_board(triage, analyses, tenders).orderBy(*B.board_order())
    assert [(r.tender_id, r.recommendation) for r in board.collect()] == [("a", "avaliar"), ("b", None)]
    assert B.triage_board(triage, analyses, tenders, include_all=True).count() == 3
    assert [r.tender_id for r in B.to_analyse(triage, analyses, 3).collect()] == ["b"]
    assert [r.tender_id for r in B.to_analyse(triage, analyses, 1, redo=True).collect()] == ["b"]
    stored = spark.createDataFrame([(1, "T", "q", False, "old"), (2, "T", "q", False, "new"), (3, "T", "q", True, "hist")],
                                   "id int, tender_id string, normalized string, with_history boolean, answer string")
    asked = spark.createDataFrame([(10, "T", "q", False), (11, "T", "q", True), (12, "U", "q", False)],
                                  "request int, tender_id string, normalized string, with_history boolean")
    assert [(r.request, r.answer) for r in B.cached_answers(asked, stored).collect()] == [(10, "new")]


def scenario(spark):
    documents = spark.createDataFrame(
        [(1, "T", 2, 2, "Edital", "Edital", "ok"), (2, "T", 3, 4, "Termo", "TR", "ok"), (3, "T", 1, 16, "Parecer", "P", "ok"),
         (4, "T", 4, 2, "Edital", "Quebrado", "falhou"), (5, "T", 1, 2, "Edital", "Primeiro", "ok")],
        "document_id int, tender_id string, seq int, type_id int, type string, title string, status string")
    pages = spark.createDataFrame([(d, n, "a.pdf" if d == 2 else None, n, f"texto {d}.{n}") for d in (1, 2, 3, 4, 5) for n in (1, 2)],
                                  "document_id int, number int, source_file string, page_in_file int, text string")
    return number_pages(documents, pages)


def test_global_numbers_and_reading(spark):
    pages = scenario(spark)
    got = [(r.page, r.document_id, r.number) for r in pages.orderBy("page").collect()]
    assert got == [(1, 5, 1), (2, 5, 2), (3, 1, 1), (4, 1, 2), (5, 2, 1), (6, 2, 2)]
    refs = spark.createDataFrame([("T", 1), ("T", 99), ("U", 1)], "tender_id string, page long")
    rows = {(r.tender_id, r.page): (r.text, r.error) for r in read_pages(refs, pages).collect()}
    assert rows[("T", 1)] == ("texto 5.1", None) and "vão de 1 a 6" in rows[("T", 99)][1] and "de 1 a 0" in rows[("U", 1)][1]


def test_prompt_parts_in_order(spark):
    profiles = spark.createDataFrame([(1, "Vende papel.", ["CNPJ", "FGTS"])], "id int, description string, documents array<string>")
    tenders = spark.createDataFrame([("T", "Org", "Cidade", "PR", "Compra \n de papel")], "id string, org string, city string, state string, object string")
    items = spark.createDataFrame([("T", n, f"Papel {n}", None if n == 2 else n * 1.0, "UN", "ME" if n == 1 else None) for n in range(1, 43)],
                                  "tender_id string, number int, description string, quantity double, unit string, benefit string")
    items = items.withColumn("quantity", F.col("quantity").cast("decimal(18,4)"))
    pairs = spark.createDataFrame([(1, "T")], "profile_id int, tender_id string")
    parts = analysis_parts(pairs, profiles, tenders, items, scenario(spark)).orderBy("section", "at").collect()
    text = "\n".join(p.text for p in parts)
    assert text.startswith(
        "EMPRESA\nVende papel.\nDocumentos que a empresa já possui:\n- CNPJ\n- FGTS\n\nLICITAÇÃO (dados do PNCP)\n"
        "Órgão: Org (Cidade/PR)\nObjeto: Compra de papel\nItens (42 no total):\n- 1. Papel 1 (1.0000 UN) [ME]\n- 2. Papel 2 (? UN)\n")
    assert "\n- ... e mais 2 itens\n\nDOCUMENTOS\n\n===== Edital: Primeiro =====\n[p. 1]\ntexto 5.1\n[p. 2]\n" in text
    assert text.endswith("\n\n===== Termo: TR =====\n[p. 5] (a.pdf, pág. 1)\ntexto 2.1\n[p. 6] (a.pdf, pág. 2)\ntexto 2.2")


def test_scoring_of_answers(spark):
    cases = spark.createDataFrame(
        [("ok", [r"\b12\b|doze", "mes"], [19], False), ("pagina", ["x"], [1], False), ("ausente", [r"n[ãa]o (h[áa]|consta)"], [], True),
         ("inventada", ["x"], [1], False), ("calado", ["x"], [1], False)],
        "name string, patterns array<string>, pages array<int>, absent boolean")
    answers = spark.createDataFrame(
        [("ok", "DOZE meses.", [(19, "corrigida"), (2, "verificada")]), ("pagina", "X", [(2, "verificada")]), ("ausente", "Não consta.", []),
         ("inventada", "x", [(1, "aproximada"), (1, "nao_encontrada")])],
        "name string, answer string, citations array<struct<page:int,status:string>>")
    answers = answers.withColumns({"steps": F.lit(1), "seconds": F.lit(1.0), "model": F.lit("m")})
    scored = R.score_answers(cases, answers)
    got = {r.name: (r.right_answer, r.right_page, r.verified, r.invented, r.passed) for r in scored.collect()}
    assert got == {"ok": (True, True, 2, 0, True), "pagina": (True, False, 1, 0, False), "ausente": (True, True, 0, 0, True),
                   "inventada": (True, True, 1, 1, False)}
    s = R.eval_summary(scored).first()
    assert (s.cases, s.passed, s.verified, s.citations, s.invented) == (4, 2, 4, 5, 1)
    assert [r.name for r in R.inconclusive_cases(cases, answers).collect()] == ["calado"]


def test_analysis_replies_are_checked(spark):
    import json

    cite = dict(page=1, quote="q")
    good = dict(documents_complete=True, summary="s", sme_exclusive="nao", sme_citation=None, criterion="c",
                deadlines=[dict(event="e", when="w", citation=cite)], requirements=[], conditions=[dict(kind="entrega", description="d", citation=cite)],
                risks=[dict(description="d", severity="alta", citation=cite)], recommendation="avaliar", justification="j")
    bad = [
        ({**good, "recommendation": "talvez"}, "recommendation"),
        ({**good, "risks": [dict(description="d", severity="altíssima", citation=cite)]}, "risks"),
        ({**good, "deadlines": [dict(event="e", when="w", citation=dict(page=1))]}, "deadlines"),
        ({k: v for k, v in good.items() if k != "summary"}, "summary"),
    ]
    rows = [(0, json.dumps(good)), (1, json.dumps(good)[:50])] + [(i + 2, json.dumps(b)) for i, (b, _) in enumerate(bad)] + [(9, None)]
    out = {r.id: (r.error, r.data) for r in L.validate_analyses(spark.createDataFrame(rows, "id int, reply string"), "reply").collect()}
    assert out[0][0] is None and out[0][1].risks[0].severity == "alta"
    assert out[1] == ("unreadable", None) and out[9] == ("unreadable", None)
    for i, (_, name) in enumerate(bad):
        assert out[i + 2] == (name, None)


def test_a_scope_deletes_what_it_materialized(spark):
    import os

    from prumo.session import fresh_path, materialize, scratch

    with scratch(spark) as folder:
        assert materialize(spark.range(5).toDF("n"), "five").count() == 5
        assert os.listdir(folder) and fresh_path(spark, "x").startswith(folder)
    assert not os.path.exists(folder) and not fresh_path(spark, "x").startswith(folder)
