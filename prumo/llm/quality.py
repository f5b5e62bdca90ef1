"""Quality by hierarchical empirical Bayes, in DataFrame functions.

A document's own evidence is the sum, over a few signals of its text, of the log ratio with which labelled good and bad documents
show them (signals in steps, counts by grouped aggregation). Sites add what is usual there: the posterior rate of a host is its
documents' expected share of good ones, shrunk toward the rate of all; that of a path within the host is shrunk toward the host's.
How strongly is estimated from how much hosts (and paths within hosts) differ beyond chance, so sparse
sites stay near their parents. A document's own share is taken out of its site before it is judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.llm.common import named
from prumo.session import materialize

STEPS = 12  # steps of a signal
STRONGEST = 7.0  # what one signal can say either way


def signals(text: Column) -> dict[str, Column]:
    """Signals of a text, each a step 0 … STEPS - 1. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))

    def share(pattern: str) -> Column:
        return 1 - F.length(F.regexp_replace(text, pattern, "")) / length

    def step(part: Column) -> Column:
        return F.least(F.lit(STEPS - 1), F.floor(part * STEPS)).cast("int")

    return {
        "capitals": step(share(r"\p{Lu}++") * 2),
        "signs": step(share(r"[^\p{L}\p{N}\s]++") * 3),
        "digits": step(share(r"\p{N}++") * 3),
        # Of w random words about w^0.9 differ; fewer speak of repetition.
        "repetition": step(1 - F.size(F.array_distinct(words)) / F.pow(count, F.lit(0.9)) / 1.6),
        "alternation": step(
            F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"[\p{L}\p{N}]++", "")) == F.length(w))) / count * 2
        ),
        "length": F.least(F.lit(STEPS - 1), F.floor(F.log2(count))).cast("int"),
    }


def _evidence(rows: DataFrame, names: list[str]) -> DataFrame:
    """(signal, step, says): the bounded log ratio of good to bad labelled rows, smoothed. At most names × STEPS rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("step")) for s in names])).alias("s")
    counted = (
        rows.filter("label IS NOT NULL")
        .select("label", pairs)
        .groupBy("s.signal", "s.step")
        .agg(*[F.sum(F.when(F.col("label") == k, 1.0).otherwise(0.0)).alias(c) for k, c in ((1, "good"), (0, "bad"))])
    )
    totals = rows.agg(*[F.count(F.when(F.col("label") == k, 1)).alias(f"n{k}") for k in (0, 1)]).first()
    says = F.log((F.col("good") + 0.5) / (totals["n1"] + 1.0)) - F.log((F.col("bad") + 0.5) / (totals["n0"] + 1.0))
    return counted.select("signal", "step", F.greatest(F.lit(-STRONGEST), F.least(F.lit(STRONGEST), says)).alias("says"))


def _chance(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _strength(sites: DataFrame, rate: Column) -> float:
    """The number of documents a parent's rate is worth: the smaller, the more sites differ beyond chance (by moments)."""
    spread = F.pow(F.col("good") / F.col("docs") - rate, F.lit(2.0))
    chance = rate * (1 - rate)
    row = sites.agg(
        F.sum(F.col("docs") * spread).alias("seen"),
        F.sum(chance).alias("noise"),
        F.sum(F.col("docs") * chance).alias("whole"),
    ).first()
    if not row["whole"]:
        return 1.0
    beyond = max((row["seen"] - row["noise"]) / row["whole"], 1e-4)  # correlation within sites
    return min(max(1 / beyond - 1, 1.0), 1e4)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """(id, evidence, host_rate, path_rate, score) for every row; score is the probability of good quality.

    Labels other than 0 and 1 teach nothing; without labels of both kinds evidence and score rest on even
    odds. A null host or path is a site of its own. A null or empty text has the signals of an empty one. Rows with
    one id are judged each for itself. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(
        named(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), named(host_col).cast("string")), F.lit("")).alias("host"),
        F.coalesce(F.concat(F.lit("="), named(path_col).cast("string")), F.lit("")).alias("path"),
        *[c.alias(s) for s, c in signals(named(text_col)).items()],
    )
    names = texts.columns[3:]
    texts = materialize(texts, "quality-signals")
    given = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label"))
    given = given.filter("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    taught = materialize(texts.join(given, "id"), "quality-taught")
    counts = taught.agg(F.avg("label").alias("rate"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    known = counts["low"] == 0 and counts["high"] == 1
    rate = min(max(counts["rate"], 0.01), 0.99) if known else 0.5
    prior = F.log(F.lit(rate / (1 - rate)))
    if known:
        said = {(r["signal"], r["step"]): r["says"] for r in _evidence(taught, names).collect()}
        parts = [
            reduce(
                lambda out, k: F.when(F.col(s) == k, F.lit(said.get((s, k), 0.0))).otherwise(out), range(STEPS + 1), F.lit(0.0)
            )
            for s in names
        ]
        evidence = reduce(lambda a, b: a + b, parts)
    else:
        evidence = F.lit(0.0)
    rows = texts.select("id", "host", "path", evidence.alias("evidence")).withColumn(
        "own", _chance(F.col("evidence") + prior)
    )
    site = [F.count("*").cast("double").alias("docs"), F.sum("own").alias("good")]
    paths = materialize(rows.groupBy("host", "path").agg(*site), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("docs").alias("docs"), F.sum("good").alias("good"))
    whole = hosts.agg((F.sum("good") / F.sum("docs")).alias("rate")).first()["rate"]
    if whole is None:
        whole = rate
    host_worth = _strength(hosts, F.lit(whole))
    hosts = hosts.select("host", F.col("docs").alias("host_docs"), F.col("good").alias("host_good"))
    beside = paths.join(hosts, "host")
    path_worth = _strength(beside, (F.col("host_good") + host_worth * whole) / (F.col("host_docs") + host_worth))
    judged = rows.join(beside, ["host", "path"])
    host_rate = (F.col("host_good") - F.col("own") + host_worth * whole) / (F.col("host_docs") - 1 + host_worth)
    path_rate = (F.col("good") - F.col("own") + path_worth * F.col("host_rate")) / (F.col("docs") - 1 + path_worth)
    usual = F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return (
        judged.withColumn("host_rate", host_rate)
        .withColumn("path_rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_rate)))
        .select("id", "evidence", "host_rate", "path_rate", _chance(F.col("evidence") + usual).alias("score"))
    )
