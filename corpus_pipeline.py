"""The training-data pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last
returns token ids. Rows keep their values, but a missing language is filled in and a document cut by the mix says its new length.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.llm.bpe import ByteBPE
from prumo.llm.common import row_of, small_batches
from prumo.llm.jaccard import near_duplicates
from prumo.llm.langid import UNKNOWN
from prumo.llm.langid import learn as learn_languages
from prumo.llm.langid import predict
from prumo.llm.mixing import mix, mixed_documents
from prumo.llm.toxicity import learn as learn_toxicity
from prumo.llm.toxicity import score
from prumo.session import materialize, prepare

MOST_TOXIC = 0.3


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, texts without a letter and texts in no learnt language go.

    The model is learnt from the documents with a language whose crc32(doc_id) is no multiple of 5. A null language is filled in.
    """
    docs = small_batches(docs)
    model = learn_languages(docs.filter(_remainder(5) != 0))
    judged = docs.select(row_of(docs).alias("row"), predict(spark, model, F.col("text"), within=True).alias("p"))
    kept = judged.filter((F.col("p.lang") != UNKNOWN) & F.col("p.within"))
    columns = [F.coalesce("row.lang", "p.lang").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below MOST_TOXIC, learnt from the labels that op9 does not hold out.

    Null and empty texts have the score of a text without hits and stay unless nearly all labels are toxic; equal texts go
    or stay together; whole texts are read. Null ids and labels of other documents teach nothing.
    """
    docs = small_batches(docs)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(_remainder(4) != 2)
    model = learn_toxicity(docs, labels)
    judged = docs.select(row_of(docs).alias("row"), score(spark, model, F.col("text")).alias("score"))
    return judged.filter(F.col("score") < MOST_TOXIC).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of smallest id, nulls last.

    Every row is a document of its own, also where its id is null or another row's: of rows with one id, those stay that
    are in groups of their own; of equal ids in one group the row that comes first. Blank and null texts are no copies of one another.
    """
    # The numbers are written with the rows: made again, they could fall on other rows.
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("n"), row_of(docs).alias("row")), "numbered-documents")
    found = near_duplicates(rows.select("n", F.col("row.text").alias("text")), words=5, similarity=Fraction(4, 5), id_col="n")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), "n")
    placed = found.select(F.col("id").alias("n"), "component").join(rows.select("n", order.alias("order")), "n")
    first = placed.groupBy("component").agg(F.min("order").alias("order"))
    kept = rows.join(first.select(F.col("order.n").alias("n")), "n", "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 over 150% of all words: a document taken twice is there twice, and the one at a
    source's budget ends there.

    A null source is one of its own, the last; null, empty and blank texts have no words, so nothing is taken of them. Equal rows
    are documents of their own. A text of any length is cut at a word. No documents give no rows.
    """
    return mixed_documents(mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, digests of the ids and of the bytes they decode to, and whether those are the text.

    A row per row: null and empty texts have no ids, equal rows equal ones, and whole texts are encoded.
    """
    docs = small_batches(docs)
    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip(F.col("text")).alias("b"))
    decoded = coded.select("doc_id", "lang", "source", "text", "b.*")
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        (F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")).alias("intact"),
    )


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("mixture", mixture),
    ("tokens", tokens),
]

# The learnt stages and the links of near duplicates are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what each returns is written and read again by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
