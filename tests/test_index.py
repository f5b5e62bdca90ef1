"""The stored index: lookups beside the postings themselves, appended versions, hot words, and the plan."""

import pytest
from pyspark.sql import functions as F

from prumo.operators import search as S
from prumo.operators.index import append_index, look_up, write_index

KEY = ["doc"]


def posted_of(spark, texts):
    return S.index_texts(spark.createDataFrame(texts, "doc int, text string"), "text", KEY)


def rows(df):
    return sorted((r.doc, r.lexeme, r.tf, tuple(r.positions)) for r in df.collect())


@pytest.fixture
def name(spark):
    table = "test_postings"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def words(spark, *given):
    return spark.createDataFrame([(w,) for w in given], "lexeme string")


def test_lookup_and_versions(spark, name):
    texts = [(i, f"de casa número {i} de {'azul' if i % 3 else 'verde'}") for i in range(200)]
    posted = posted_of(spark, texts)
    write_index(posted, name, KEY, buckets=4)
    wanted = words(spark, "de", "azul", "17", "nowhere")
    assert rows(look_up(spark, name, wanted, KEY)) == rows(posted.where(F.col("lexeme").isin("de", "azul", "17")))
    # Some texts are read again, one is gone.
    again = [(i, f"azul e mais azul {i}") for i in range(0, 200, 50)]
    append_index(posted_of(spark, again), name, KEY, 2)
    now = dict(texts) | dict(again)
    now.pop(7)
    current = spark.createDataFrame([(i, 2 if i % 50 == 0 else 1) for i in now], "doc int, version long")
    want = posted_of(spark, list(now.items())).where(F.col("lexeme").isin("de", "azul", "17"))
    assert rows(look_up(spark, name, wanted, KEY, current)) == rows(want)
    assert look_up(spark, name, words(spark), KEY).count() == 0
    phrase = spark.createDataFrame([("casa número 17",)], "phrase string")
    found = S.match_phrase(look_up(spark, name, S.phrase_words(phrase), KEY, current), phrase, KEY)
    assert [tuple(r) for r in found.collect()] == [(17, "casa número 17")]


@pytest.mark.parametrize("language", [S.SIMPLE, S.PORTUGUESE, S.Language("short", frozenset({"de", "casa"}))], ids=lambda x: x.name)
def test_postings_within_the_row(spark, language):
    """Beside the grouping of single words, with repeated and null keys, null and empty texts; words are not rows before they are posted."""
    texts = [(i % 40 or None, None if i % 11 == 0 else "" if i % 7 == 0 else f"A casa de {i}, a casa é de casas {i % 3}") for i in range(120)]
    df = spark.createDataFrame(texts, "doc int, text string")
    got = S.index_texts(df, "text", KEY, language)
    shown = lambda rows: sorted(((r.doc or 0, r.lexeme, r.tf, tuple(r.positions)) for r in rows))
    assert shown(got.collect()) == shown(S.postings(S.analyze(df, "text", KEY, language), KEY).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert S.index_texts(df.limit(0), "text", KEY, language).count() == 0


def test_postings_are_not_shuffled(spark, name):
    write_index(posted_of(spark, [(i, f"de casa {i}") for i in range(300)]), name, KEY, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # also where the words are many
    try:
        plan = look_up(spark, name, words(spark, "de", "casa"), KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("Initial Plan")[-1].splitlines()
    scan = next(n for n, line in enumerate(tree) if "FileScan parquet" in line and name in line)
    join = max(n for n, line in enumerate(tree[:scan]) if "Join" in line)
    assert not any("Exchange" in line for line in tree[join:scan]) and "Bucketed: true" in tree[scan]
    assert "text" not in tree[scan].split("ReadSchema")[1]


def test_a_hot_word_is_spread(spark, name):
    write_index(posted_of(spark, [(i, "de") for i in range(2000)]), name, KEY, buckets=8)
    files = spark.table(name).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 5 and max(r["count"] for r in files) < 1200


def test_changed_documents_are_indexed_anew(spark, tmp_path):
    from prumo.plans.registry import Tables
    from prumo.plans.searching import page_index, posted_words

    def given(text):
        df = spark.createDataFrame([(i, text, lang, "src1", len(text)) for i, lang in enumerate(("de", "en", "es", "fr"))], "doc_id long, text string, lang string, source string, n_chars long")
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return Tables(spark, str(tmp_path))

    t = given("uma casa azul " * 20)
    first = page_index(t)
    assert page_index(Tables(spark, str(tmp_path))) == first
    t = given("outra casa verde com telhado " * 20)
    assert page_index(t) != first
    assert {r.lexeme for r in posted_words(t, words(spark, "verde", "azul")).collect()} == {"verde"}
