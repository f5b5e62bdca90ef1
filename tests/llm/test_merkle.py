"""Merkle manifest: a plain tree beside it, tampering, and the cases at the edge."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from prumo.llm import merkle
from prumo.llm.merkle import folded, manifest, siblings_of

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, rank string, `held.x` int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][i : i + 8])) for i in range(0, len(rows[-1]), 8)])
    return rows


def beside(rows, at):
    """(before, after) from the bottom up."""
    out = []
    for row in rows[:-1]:
        start = at // 8 * 8
        out.append(("".join(row[start:at]), "".join(row[at + 1 : start + 8])))
        at //= 8
    return out


def plain(rows):
    """(lang, doc_id, leaf) → (subroot, root, path), equal ones listed."""
    trees = {}
    for lang in {r[2] for r in rows}:
        mine = sorted(((r[0], leaf_of(r)) for r in rows if r[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = mine, levels([leaf for _, leaf in mine])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    crown = levels([trees[lang][1][-1][0] for lang in order])
    out = []
    for lang, (mine, tree) in trees.items():
        above = beside(crown, order.index(lang))
        for at, (doc_id, leaf) in enumerate(mine):
            out.append((lang, doc_id, leaf, tree[-1][0], crown[-1][0], beside(tree, at) + above))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)
    found = manifest(df, FIELDS, "lang", "doc_id").select("grp", "key", "leaf", "subroot", "root", "path").collect()
    return [(r.grp, r.key, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found]


def keyed(rows):
    return sorted(rows, key=repr)


def test_trees_of_many_sizes(spark, monkeypatch):
    """Groups of 1 to 4,200 rows, one of which holds most; more passes than one, and single nodes at the right edge."""
    sizes = {None: 9, "": 1, "a": 8, "b": 65, "c": 513, "é": 4200, "z": 64}
    rows = [(i, f"s{i % 3}", lang, i, f"text {i}") for lang, n in sizes.items() for i in range(n)]
    random.Random(5).shuffle(rows)
    want = keyed(plain(rows))
    assert keyed(run(spark, rows)) == want
    monkeypatch.setattr(merkle, "DIGITS", 1)  # blocks of eight: many passes
    assert keyed(run(spark, rows)) == want


def test_many_groups(spark):
    rows = [(i, None, f"g{i % 700}", None, None) for i in range(1500)]
    assert keyed(run(spark, rows)) == keyed(plain(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "a", 3, "abc")] * 20 + [(5, "s", "a", 3, "abd"), (5, "s", "a", 3, "")]
    rows += [(None, "s", "a", 1, "é" * 100_000), (6, "-", "a", None, None), (6, None, "a", None, None)]
    assert keyed(run(spark, rows)) == keyed(plain(rows))


def test_a_single_row_is_its_own_root_and_no_row_has_none(spark):
    ((_, _, leaf, subroot, root, path),) = run(spark, [(1, "s", "a", 3, "abc")])
    assert leaf == subroot == root == leaf_of((1, "s", "a", 3, "abc")) and path == []
    assert run(spark, []) == []


def test_fold_and_siblings(spark):
    path = [("ab", ""), ("", "c"), ("", "")]
    df = spark.createDataFrame([("x", path), ("x", [])], "leaf string, path array<struct<before:string,after:string>>")
    got = df.select(folded(F.col("leaf"), F.col("path")), siblings_of(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(h(h(h("abx") + "c")), "abc"), ("x", "")]


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_finds_what_was_tampered_with(spark, scale):
    from prumo.llm.queries import QUERIES

    folder = f"/root/testdata/{scale}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_merkle_manifest"](spark, folder).collect()
    assert len(rows) == len(texts) and len({r.root for r in rows}) == 1
    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified == (not hit)


def test_plan_has_no_cartesian_product(spark):
    df = spark.createDataFrame([(i, "s", "a", 1, "t", 1, "x", 1) for i in range(600)], SCHEMA)
    plan = manifest(df, FIELDS, "lang", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan
