"""Replies of external models: read against a schema, judged, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import (
    CONDITION_KINDS,
    RECOMMENDATIONS,
    REQUIREMENT_CATEGORIES,
    REQUIREMENT_STATES,
    SEVERITIES,
    SME_EXCLUSIVE,
)
from prumo.schemas import ANALYSIS_RESULT

TRIAGE_REPLY = "evaluations array<struct<n int, score int, reason string>>"


def validate_replies(df: DataFrame, reply: str, schema: T.StructType, rules: dict[str, Column]) -> DataFrame:
    """`data` holds the reply if it parses and meets every rule; else `error` names what failed.

    Rules are conditions over `data`; a rule that comes out null is not met.
    """
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = df.withColumn(
        "data", F.from_json(reply, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    broken = F.col("data").isNull() | F.col(f"data.{corrupt}").isNotNull()
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda name: name.isNotNull(),
    )
    error = F.when(broken, F.lit("unreadable")).otherwise(F.nullif(F.array_join(failed, ","), F.lit("")))
    clean = F.struct(*[F.col(f"data.{f.name}").alias(f.name) for f in schema.fields])
    return parsed.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), clean))


def triage_reply_rules() -> dict[str, Column]:
    """Every entry has its number, a score from 0 to 100 and a reason."""
    entries = F.col("data.evaluations")
    return {
        "evaluations": entries.isNotNull(),
        "n": F.forall(entries, lambda e: e["n"].isNotNull()),
        "score": F.forall(entries, lambda e: F.coalesce(e["score"].between(0, 100), F.lit(False))),
        "reason": F.forall(entries, lambda e: e["reason"].isNotNull()),
    }


def analysis_rules() -> dict[str, Column]:
    """Required fields and allowed values of an analysis; every entry carries a citation."""
    d = F.col("data")

    def one_of(c: Column, values: tuple[str, ...]) -> Column:
        return F.coalesce(c.isin(*values), F.lit(False))

    def cited(c: Column) -> Column:
        return c["page"].isNotNull() & c["quote"].isNotNull()

    rules = {name: d[name].isNotNull() for name in ("documents_complete", "summary", "criterion", "justification")}
    rules["sme_exclusive"] = one_of(d["sme_exclusive"], SME_EXCLUSIVE)
    rules["recommendation"] = one_of(d["recommendation"], RECOMMENDATIONS)
    rules["sme_citation"] = d["sme_citation"].isNull() | cited(d["sme_citation"])
    entry = {
        "deadlines": lambda e: e["event"].isNotNull() & e["when"].isNotNull(),
        "requirements": lambda e: one_of(e["category"], REQUIREMENT_CATEGORIES)
        & one_of(e["status"], REQUIREMENT_STATES)
        & e["demand"].isNotNull(),
        "conditions": lambda e: one_of(e["kind"], CONDITION_KINDS) & e["description"].isNotNull(),
        "risks": lambda e: one_of(e["severity"], SEVERITIES) & e["description"].isNotNull(),
    }
    for section, ok in entry.items():
        rules[section] = F.forall(d[section], _entry_rule(ok, cited))
    return rules


def _entry_rule(ok, cited):
    return lambda e: ok(e) & cited(e["citation"])


def validate_analyses(df: DataFrame, reply: str) -> DataFrame:
    return validate_replies(df, reply, ANALYSIS_RESULT, analysis_rules())


def validate_triage(df: DataFrame, reply: str) -> DataFrame:
    return validate_replies(df, reply, T.StructType.fromDDL(TRIAGE_REPLY), triage_reply_rules())
