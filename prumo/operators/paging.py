"""From text to numbered pages, and from page references back to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import CHUNK_CHARS, DONE, PAGE_TEXT_LIMIT
from prumo.functions.display import document_label
from prumo.functions.predicates import is_readable_type
from prumo.functions.text import SPACE, reading_order, strip
from prumo.operators.grouping import running_total


def text_blocks(text: Column) -> Column:
    """The cleaned, non-empty lines of a text. White space around a line break, empty lines
    included, goes away with the break, so one pass over the text cleans every line."""
    flat = F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "[ \\t\\u00a0]+", " ")
    joined = strip(F.regexp_replace(flat, f"{SPACE}*\\n{SPACE}*", "\n"))
    return F.filter(F.split(joined, "\n"), lambda b: b != "")


def chunk_blocks(blocks: Column, size: int = CHUNK_CHARS) -> Column:
    """Greedy pages from an array of cleaned text blocks: a block joins the page while the
    page's length plus its own stays within `size`; a longer block stands alone."""
    empty = F.struct(
        F.array().cast("array<string>").alias("pages"), F.lit("").alias("current")
    )

    def step(acc: Column, b: Column) -> Column:
        pages, current = acc["pages"], acc["current"]
        full = (current != "") & (F.length(current) + F.length(b) > size)
        return F.struct(
            F.when(full, F.concat(pages, F.array(current))).otherwise(pages).alias("pages"),
            F.when(full | (current == ""), b).otherwise(F.concat(current, F.lit("\n"), b)).alias("current"),
        )

    return F.aggregate(
        blocks,
        empty,
        step,
        lambda acc: F.when(acc["current"] == "", acc["pages"]).otherwise(
            F.concat(acc["pages"], F.array(acc["current"]))
        ),
    )


def paginate(df: DataFrame, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """One row per page of a text column whose blocks are its lines. A fold inside the row:
    no shuffle."""
    pages = chunk_blocks(text_blocks(F.col(text)), size)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(pages).alias("_pos", "text")).select(
        *rest, (F.col("_pos") + 1).cast("int").alias("number"), "text"
    )


def number_in_document(pages: DataFrame, place: str | None = None) -> DataFrame:
    """Page number over all files of a document: by their given place, or the main file first
    and then natural order of names.

    File totals per document give the offset of each file, so only the file list of a
    document is ordered, in ranges, and never its pages.
    """
    file = place or "source_file"
    order = [F.col(place).asc()] if place else reading_order(F.coalesce("source_file", F.lit("")))
    files = pages.groupBy("document_id", file).agg(F.max("page_in_file").alias("_pages"))
    offsets = running_total(files, ["document_id"], order, F.col("_pages"), "_offset").select(
        F.col("document_id").alias("_doc"), F.col(file).alias("_file"), "_offset"
    )
    return (
        pages.join(offsets, (F.col("document_id") == F.col("_doc")) & F.col(file).eqNullSafe(F.col("_file")))
        .withColumn("number", (F.col("_offset") + F.col("page_in_file")).cast("int"))
        .drop("_doc", "_file", "_offset")
    )


def readable_documents(documents: DataFrame) -> DataFrame:
    return documents.where(is_readable_type("type_id") & (F.col("status") == DONE))


def number_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Global page number per tender over its readable documents: type, sequence, page.

    Pages of a document are numbered from 1 without gaps, so a page only needs to know how many
    pages the documents before its own have. Page texts are not sorted for it; they are shuffled by document only
    where the numbers are too many to broadcast. The documents of a large tender are added up in ranges.
    """
    counts = pages.groupBy("document_id").agg(F.count("*").alias("_pages"))
    docs = readable_documents(documents).select(
        "tender_id", "document_id", "type_id", "seq", document_label("type", "title").alias("document")
    )
    order = [F.col("type_id"), F.col("seq"), F.col("document_id")]
    placed = running_total(
        docs.join(counts, "document_id"),
        ["tender_id"],
        order,
        F.col("_pages"),
        "_before",
    ).drop("_pages")
    return pages.join(placed, "document_id").withColumn("page", F.col("_before") + F.col("number")).drop("_before")


def lookup_pages(refs: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The pages a batch of (document, page number) references points to."""
    titles = documents.select("document_id", F.col("title").alias("document"), "total_pages")
    return (
        refs.select("document_id", "number").distinct().join(pages, ["document_id", "number"]).join(titles, "document_id")
    )


def read_pages(refs: DataFrame, pages: DataFrame, limit: int = PAGE_TEXT_LIMIT) -> DataFrame:
    """Text of globally numbered pages; a number out of range becomes an error row that
    names the valid range."""
    ranges = pages.groupBy("tender_id").agg(F.max("page").alias("last_page"))
    found = pages.select("tender_id", "page", "document", F.substring("text", 1, limit).alias("text"))
    return (
        refs.join(found, ["tender_id", "page"], "left")
        .join(ranges, "tender_id", "left")
        .withColumn(
            "error",
            F.when(
                F.col("text").isNull(),
                F.concat(
                    F.lit("a página "),
                    F.col("page").cast("string"),
                    F.lit(" não existe; as páginas vão de 1 a "),
                    F.coalesce(F.col("last_page"), F.lit(0)).cast("string"),
                ),
            ),
        )
        .drop("last_page")
    )
