"""Change-aware merges. Every merge returns the next snapshot of a table; the caller writes it
to a new path, so no job overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.fixed_values import DONE, FAILED, MAX_ERROR, PENDING, UNSUPPORTED
from prumo.operators.grouping import keep_last

TENDER_IDENTITY = ("id", "cnpj", "year", "seq")


def merge_tenders(current: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Insert or refresh tenders; `inserted` tells which were new.

    The last row per id in the batch counts. Identity columns keep their old value, all others
    take the new one. A changed update time sends the details back to pending with no attempts;
    otherwise their state is kept.
    """
    last = keep_last(batch, ["id"], order)
    old, new = current.alias("old"), last.alias("new")
    existed, came = F.col("old.id").isNotNull(), F.col("new.id").isNotNull()
    changed = came & (~existed | ~F.col("old.updated_at").eqNullSafe(F.col("new.updated_at")))

    def value(c: str) -> Column:
        if c in TENDER_IDENTITY:
            return F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}"))
        return F.when(came, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    detail = {
        "details_state": F.when(changed, F.lit(PENDING)).otherwise(F.col("old.details_state")),
        "details_attempts": F.when(changed, F.lit(0)).otherwise(F.col("old.details_attempts")),
    }
    if "details_error" in current.columns:
        detail["details_error"] = F.col("old.details_error")
    return old.join(new, F.col("old.id") == F.col("new.id"), "full").select(
        *[(detail[c] if c in detail else value(c)).alias(c) for c in current.columns],
        (came & ~existed).alias("inserted"),
    )


def replace_children(current: DataFrame, fresh: DataFrame, touched: DataFrame, parent: list[str]) -> DataFrame:
    """Children of touched parents are replaced by the fresh ones, all others stay."""
    kept = current.join(touched.select(*parent).distinct(), parent, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def replace_items(current: DataFrame, listed: DataFrame, touched: DataFrame, order: list[str]) -> DataFrame:
    """Items of re-read tenders, the last one per number."""
    return replace_children(
        current, keep_last(listed, ["tender_id", "number"], order), touched, ["tender_id"]
    )


def reconcile_documents(current: DataFrame, listed: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents of the tenders whose list was read (`touched`), against what the list says.

    Same slot and same URL: status and attempts stay. Another URL: pending, no attempts. A slot
    gone from the list is deleted; tenders not touched, for instance after a read error, keep
    everything. `listed(tender_id, seq, title, type_id, type, url)`.
    """
    asked = touched.select("tender_id").distinct()
    others = current.join(asked, "tender_id", "left_anti")
    mine = listed.join(asked, "tender_id", "left_semi").alias("new")
    old = current.alias("old")
    joined = mine.join(
        old,
        (F.col("old.tender_id") == F.col("new.tender_id")) & (F.col("old.seq") == F.col("new.seq")),
        "left",
    )
    existed = F.col("old.tender_id").isNotNull()
    replaced = ~existed | ~F.col("old.url").eqNullSafe(F.col("new.url"))

    def value(c: str) -> Column:
        if c in ("tender_id", "seq", "title", "type_id", "type", "url"):
            return F.col(f"new.{c}")
        if c == "status":
            return F.when(replaced, F.lit(PENDING)).otherwise(F.col("old.status"))
        if c == "attempts":
            return F.when(replaced, F.lit(0)).otherwise(F.col("old.attempts"))
        return F.col(f"old.{c}")

    return others.unionByName(joined.select(*[value(c).alias(c) for c in current.columns]))


def replace_pages(current: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of re-read documents replaced; pages of documents that no longer exist removed."""
    return cascade_delete(
        replace_children(current, fresh, fresh, ["document_id"]), documents, ["document_id"]
    )


def replace_analyses(current: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """Analyses per (profile, tender), the new one in place of the old. One about a tender
    without readable pages is refused and the old one stays."""
    readable = fresh.join(pages.select("tender_id").distinct(), "tender_id", "left_semi")
    return replace_children(current, readable, readable, ["profile_id", "tender_id"])


def record_outcomes(queue: DataFrame, outcomes: DataFrame, key: str, state: str, attempts: str, error: str,
                    every_read_counts: bool = False) -> DataFrame:
    """Write what happened to the queue. `outcomes(key, outcome, message)`.

    Failed: one more attempt and the message, cut. Done: no message. Work without an outcome
    is left alone. With `every_read_counts` any outcome costs an attempt, as for documents.
    """
    told = outcomes.select(key, "outcome", "message")
    happened = F.col("outcome").isNotNull()
    counts = happened if every_read_counts else (F.col("outcome") == FAILED)
    message = F.when(F.col("outcome").isin(FAILED, UNSUPPORTED), F.substring("message", 1, MAX_ERROR))
    return (
        queue.join(told, key, "left")
        .withColumn(attempts, F.when(counts, F.col(attempts) + 1).otherwise(F.col(attempts)))
        .withColumn(error, F.when(happened, message).otherwise(F.col(error)))
        .withColumn(state, F.when(happened, F.col("outcome")).otherwise(F.col(state)))
        .select(*queue.columns)
    )


def record_reads(documents: DataFrame, reads: DataFrame, now: Column) -> DataFrame:
    """Documents after a reading round. `reads(document_id, file_name, format, size_bytes, sha256,
    outcome, message, total_pages)`; a read that failed before any byte came has no file facts.

    Every read costs an attempt; facts of the file replace the old ones when there are any; page
    count and time change only when text was read.
    """
    facts = ("file_name", "format", "size_bytes", "sha256")
    new = reads.select(
        "document_id", (F.col("outcome") == DONE).alias("_done"), F.col("total_pages").alias("_pages"),
        *[F.col(c).alias(f"_{c}") for c in facts],
    )
    done = F.coalesce("_done", F.lit(False))
    told = documents.join(new, "document_id", "left").withColumns(
        {c: F.when(F.col("_sha256").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in facts}
        | {
            "total_pages": F.when(done, F.col("_pages")).otherwise(F.col("total_pages")),
            "downloaded_at": F.when(done, now).otherwise(F.col("downloaded_at")),
        }
    )
    return record_outcomes(
        told.select(*documents.columns), reads, "document_id", "status", "attempts", "error", every_read_counts=True
    )


def cascade_delete(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys), keys, "left_semi")

