"""Mixing beside a plain version of the same rule."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from prumo.llm.common import numbered_ranges
from prumo.llm.mixing import mix, mixed_documents
from prumo.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} by dealing and capping again and again, and the taken words per row in key order."""
    sizes, groups = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        n = len(WORDS.findall(text or ""))
        sizes[source] += n
        groups[source].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i, n))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, full, targets = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            targets |= {s: level * weight[s] for s in free}
            break
        for s in over:
            targets[s] = most * sizes[s]
            full.add(s)
            left -= targets[s]
    taken = defaultdict(list)
    for s, members in groups.items():
        budget = int(targets[s] + 0.5)
        place = 0
        for _, i, n in sorted(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0, m[2])):
            epochs = budget // sizes[s] if sizes[s] else 0
            rest = budget - epochs * sizes[s]
            taken[i].append(epochs * n + max(0, min(n, rest - place)))
            place += n
    return targets, taken


def table(spark, rows):
    schema = "doc_id long, text string, source string, size string, key string, n_chars long"
    return spark.createDataFrame([(*r, "x", "y", len(r[1] or "")) for r in rows], schema)


ROWS = (
    [(i, "w " * (i % 13) + "end", f"s{i % 7}") for i in range(300)]
    + [(1000 + i, " \tone\ntwo  three ", None) for i in range(5)]
    + [(2000, None, "s1"), (2001, "", "s2"), (2002, " \n", "empty"), (None, "a b", "s3"), (7, "again and again", "s0")]
    + [(3000, "big " * 5000, "s4")] * 2
)


def test_against_plain_rule(spark):
    targets, taken = plain(ROWS)
    rows = mix(table(spark, ROWS)).collect()
    assert len(rows) == len(ROWS)
    found = defaultdict(list)
    for r in rows:
        found[r.id].append(r.taken)
        assert r.target == pytest.approx(targets[r.row.source])
        assert r.taken <= 2 * r["size"]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in taken.items()}
    for source, target in targets.items():
        assert sum(r.taken for r in rows if r.row.source == source) == int(target + 0.5)


def test_rows_of_the_mix(spark):
    mixed = mix(table(spark, ROWS))
    out = mixed_documents(mixed)
    assert out.columns == table(spark, ROWS).columns
    words = sum(len(WORDS.findall(r.text)) for r in out.collect())
    assert words == mixed.agg(F.sum("taken")).first()[0]
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_empty_table_and_empty_texts(spark):
    assert mix(table(spark, ROWS).filter("false")).collect() == []
    nothing = mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.id, r["size"], r.taken, r.target) for r in nothing) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    with pytest.raises(ValueError):
        mix(table(spark, ROWS), share=3.0)


@pytest.mark.parametrize("hot", [7, None])
def test_a_third_of_the_rows_on_one_id(spark, hot):
    rows = [(hot if i % 3 == 0 else 10_000 + i, "word " * (1 + i % 4) + str(i), "s1" if i % 2 else "s2") for i in range(900)]
    found = mix(table(spark, rows)).collect()
    assert sorted(r.row.text for r in found) == sorted(t for _, t, _ in rows)
    for source in ("s1", "s2"):
        mine = [r for r in found if r.row.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5)
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)


def test_numbered_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    rows = numbered_ranges(df, ["k"], ["v"]).collect()
    assert all(r.place == r.k and r.v_before == 2 * r.k for r in rows)


def test_query_beside_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op8_mixed_sources"](spark, folder)
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.sql(ORACLES["op8_mixed_sources"]).fetchall())
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
