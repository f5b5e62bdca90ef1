"""Both searches beside brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prumo.llm import blockjoin, mtree
from prumo.llm.queries import QUERIES
from prumo.llm.vectors import BLOCK, tiles, usable

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [1.0, None]), (902, [NAN, 1.0]), (903, [INF, 1.0]), (None, [1.0, 1.0]), (904, [])]


def table(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding {kind}, row int, score string")


def plain(rows, k, score, asked):
    width = max(len(v) for _, v in rows)
    full = [(i, list(v) + [0.0] * (width - len(v))) for i, v in rows]
    out = []
    for a, (q, v) in enumerate(full):
        if asked(q):
            others = [(-score(v, w), i) for b, (i, w) in enumerate(full) if b != a]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(others)[:k])]
    return sorted(out)


def vectors(seed, n, dim, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = [(i, (centres[i % clusters] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows + [(i, rows[i][1]) for i in range(5)] + [(2000 + i, rows[3][1]) for i in range(30)] + [(3000, [0.5])]


@pytest.mark.parametrize("size", [64, 4096])
def test_both_against_brute_force(spark, monkeypatch, size):
    for module in (blockjoin, mtree):
        monkeypatch.setattr(module, "BLOCK_ROWS", size)
        monkeypatch.setattr(module, "QUERY_ROWS", 16)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rows = vectors(1, 400, 12, 6)
    df, asked = table(spark, rows + ODD + [(905, [0.0] * 12)]), F.col("vec_id") % 5 == 0

    def in_order(v, w):
        total = 0.0
        for a, b in zip(v, w):
            total += a * b
        return total

    found = blockjoin.nearest(df, asked, k=7).collect()
    assert sorted(map(tuple, found)) == plain(rows, 7, in_order, lambda i: i % 5 == 0)

    def whole(v, w):
        return sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(v, w))

    found = mtree.top_k(df, asked, k=7).collect()
    rows = rows + [(904, []), (905, [0.0] * 12)]
    assert sorted(map(tuple, found)) == plain(rows, 7, whole, lambda i: i % 5 == 0)


def test_pages_cover_their_rows():
    points = mtree.lifted(np.random.default_rng(2).normal(size=(3000, 6)))
    tree = mtree.build(points)
    seen = []

    def below(page, routing):
        out = []
        for e in range(tree.first[page], tree.first[page + 1]):
            rows = below(tree.leads[e], tree.point[e]) if tree.leads[e] >= 0 else [tree.point[e]]
            if tree.leads[e] < 0:
                seen.append(int(tree.point[e]))
            gaps = np.linalg.norm(points[rows] - points[tree.point[e]], axis=1)
            assert gaps.max() <= tree.radius[e] + 1e-9
            if routing is not None:
                assert abs(np.linalg.norm(points[tree.point[e]] - points[routing]) - tree.to_parent[e]) < 1e-9
            out += rows
        return out

    below(0, None)
    assert sorted(seen) == list(range(3000))
    assert np.diff(tree.first).max() <= mtree.PAGE


def test_search_skips_pages():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 50
    points = mtree.lifted(np.rint(np.repeat(centres, 300, axis=0) + rng.normal(size=(6000, 8))))
    asked, tree = points[17, :-1], mtree.build(points)
    worked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            worked.append(len(out) if isinstance(at, tuple) else 0)
            return out

    entries = points[tree.point].view(Counted)
    _, rows = mtree.search(tree, entries, asked[None, :], 10, np.array([17]), np.array([-np.inf]))
    scores = points[:, :-1] @ asked
    scores[17] = -np.inf
    assert set(np.argsort(-scores, kind="stable")[:10]) <= set(rows.tolist())
    assert sum(worked) < 6000 / 2


def test_equal_rows_and_few_rows(spark):
    df = table(spark, [(i, [1.0, 2.0]) for i in range(700)])
    found = mtree.top_k(df, F.col("vec_id") == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 20480), (2, 2, 20480), (3, 3, 20480)]
    few = table(spark, [(0, [1.0]), (1, [3.0])])
    assert [tuple(r) for r in blockjoin.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 3.0)]
    assert mtree.top_k(few.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("search", [blockjoin.nearest, mtree.top_k])
def test_empty_tables(spark, search):
    df = table(spark, ODD[:4], "array<float>")
    assert search(df, F.col("vec_id") % 1 == 0).collect() == []
    assert search(df.filter("false"), F.col("vec_id") % 1 == 0).collect() == []
    assert df.filter(usable(F.col("embedding"))).count() == 0


@pytest.mark.parametrize("name", ["op2_mtree_top_k", "op7_int8_block_join"])
def test_queries_return_twenty_each(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 25 * 20 and {r["rank"] for r in rows} == set(range(1, 21))


def test_tiles_are_read_not_broadcast(spark):
    """Query blocks times blocks of rows are more than the driver holds: no broadcast, no copy of a query block per block."""
    queries, blocks = (spark.createDataFrame([(n, b"i", b"r", b"m") for n in range(k)], BLOCK) for k in (2, 3))
    paired = tiles(queries, blocks)
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert sorted((r.q_block, r.block) for r in paired.collect()) == [(q, b) for q in range(2) for b in range(3)]
