"""Texts handed to an external reader of tender documents, in ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import PROMPT_ITEM_DESCRIPTION, PROMPT_ITEMS
from prumo.functions.text import collapse, collapse_cut
from prumo.operators.boards import document_boundaries, head_and_rest

# Order of the parts of a text: sections, then position inside the section.
COMPANY, TENDER, ITEMS, REST, DOCUMENTS, PAGES = range(6)


def plain_number(c: Column | str) -> Column:
    """A quantity as it is stored, four decimals; nothing or zero is a question mark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == 0), F.lit("?")).otherwise(c.cast("string"))


def analysis_parts(
    pairs: DataFrame, profiles: DataFrame, tenders: DataFrame, items: DataFrame, pages: DataFrame
) -> DataFrame:
    """(profile_id, tender_id, section, at, text): the company per pair, and once per tender, with a null profile, the
    tender, its first items and every page tagged with its global number, one row per part.

    The text for a pair is its own row and the rows of its tender, joined by line breaks in (section, at) order. It is not
    glued together here: a tender may have more pages than one row can hold, and its pages are the same for
    every company. What is missing of a place shows as a question mark.
    """
    pairs = pairs.select("profile_id", "tender_id")
    asked = pairs.select("tender_id").distinct()
    company = profiles.select(
        F.col("id").alias("profile_id"),
        F.array_join(
            F.concat(
                F.array(F.lit("EMPRESA"), F.coalesce("description", F.lit("")), F.lit("Documentos que a empresa já possui:")),
                F.coalesce(F.transform("documents", lambda d: F.concat(F.lit("- "), d)), F.array().cast("array<string>")),
                F.array(F.lit("")),
            ),
            "\n",
        ).alias("company"),
    )
    listed = head_and_rest(items, PROMPT_ITEMS).join(asked, "tender_id", "left_semi")
    totals = listed.groupBy("tender_id").agg(F.max("total").alias("total"), F.max("rest").alias("rest"))

    def known(name: str) -> Column:
        return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("?"))

    tender = (
        tenders.withColumnRenamed("id", "tender_id")
        .join(asked, "tender_id", "left_semi")
        .join(totals, "tender_id", "left")
        .withColumn(
            "tender",
            F.concat(
                F.lit("LICITAÇÃO (dados do PNCP)\nÓrgão: "), known("org"), F.lit(" ("), known("city"), F.lit("/"), known("state"),
                F.lit(")\nObjeto: "), F.coalesce(collapse("object"), F.lit("")),
            ),
        )
    )

    def part(df: DataFrame, section: int, at: Column, text: Column) -> DataFrame:
        whose = F.col("profile_id") if "profile_id" in df.columns else F.lit(None).cast(profiles.schema["id"].dataType)
        return df.select(
            whose.alias("profile_id"), "tender_id", F.lit(section).alias("section"), at.cast("long").alias("at"), text.alias("text")
        )

    zero = F.lit(0)
    own = part(pairs.join(company, "profile_id"), COMPANY, zero, F.col("company"))
    head = part(
        tender, TENDER, zero,
        F.concat_ws(
            "\n", "tender",
            F.when(F.col("total") > 0, F.concat(F.lit("Itens ("), F.col("total").cast("string"), F.lit(" no total):"))),
        ),
    )
    line = F.concat(
        F.lit("- "), F.col("number").cast("string"), F.lit(". "),
        F.coalesce(collapse_cut("description", PROMPT_ITEM_DESCRIPTION), F.lit("")),
        F.lit(" ("), plain_number("quantity"), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(")"),
        F.when(F.coalesce("benefit", F.lit("")) != "", F.concat(F.lit(" ["), F.col("benefit"), F.lit("]"))).otherwise(F.lit("")),
    )
    shown = part(listed, ITEMS, F.col("place"), line)
    more = part(
        totals.where("rest > 0"), REST, zero, F.concat(F.lit("- ... e mais "), F.col("rest").cast("string"), F.lit(" itens"))
    )
    title = part(tender, DOCUMENTS, zero, F.lit("\nDOCUMENTOS"))
    origin = F.when(
        F.coalesce("source_file", F.lit("")) != "",
        F.concat(F.lit(" ("), F.col("source_file"), F.lit(", pág. "), F.col("page_in_file").cast("string"), F.lit(")")),
    ).otherwise(F.lit(""))
    body = F.concat(
        F.when(F.col("starts_document"), F.concat(F.lit("\n===== "), F.col("document"), F.lit(" =====\n"))).otherwise(F.lit("")),
        F.lit("[p. "), F.col("page").cast("string"), F.lit("]"), origin, F.lit("\n"), F.col("text"),
    )
    text = part(document_boundaries(pages.join(asked, "tender_id", "left_semi")), PAGES, F.col("page"), body)
    return own.unionByName(head).unionByName(shown).unionByName(more).unionByName(title).unionByName(text)
