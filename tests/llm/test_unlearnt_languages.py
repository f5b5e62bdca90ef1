"""The language stage on texts of a language left out of learning, and on clean texts of one word."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("left_out", ["es", "fr"])
def test_texts_in_no_learnt_language_go(spark, left_out):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # Rows without a language teach nothing, so these are only judged.
    strange = docs.filter(F.col("lang") == left_out).limit(40).withColumn("lang", F.lit(None).cast("string"))
    odd = [(-1, "漢字 仮名 漢字", None, "s", 9), (-2, "the", None, "s", 3), (-3, "und", None, "s", 3), (-4, "the", None, "s", 3)]
    odd += [(-5, "il gatto dorme sul divano della nonna", None, "s", 38)]
    given = docs.filter(F.col("lang") != left_out)
    extra = spark.createDataFrame(odd, docs.schema)
    kept = corpus_pipeline.language(spark, given.unionByName(strange).unionByName(extra), FOLDER).collect()
    mine = {r.doc_id for r in strange.select("doc_id").collect()}
    found = [r.doc_id for r in kept]
    assert len(mine) > 20 and sum(i in mine for i in found) <= 0.05 * len(mine)
    assert {i for i in found if i < 0} == {-2, -3, -4}
    assert sum(i >= 0 and i not in mine for i in found) == given.count()
