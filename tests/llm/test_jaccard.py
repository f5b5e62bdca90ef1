"""The n-gram join beside all pairs."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest

from prumo.llm import jaccard
from prumo.llm.queries import QUERIES


def plain_set(text, words):
    found = text.encode().lower().split() if text else []
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def plain(rows, words, similarity):
    """{id: (n, component)} by comparing every pair that shares an n-gram."""
    sets = defaultdict(set)
    for i, text in rows:
        if i is not None:
            sets[i].add(plain_set(text, words))
    parent = {i: i for i in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    flat = [(i, s) for i, group in sets.items() for s in group if s]
    lists = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for gram in s:
            lists[gram].append(k)
    common = defaultdict(int)
    for members in lists.values():
        for x, a in enumerate(members):
            for b in members[x + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if c >= similarity * (len(flat[a][1]) + len(flat[b][1]) - c):
            x, y = top(flat[a][0]), top(flat[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def rows_with_groups(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(words(rng.randint(1, 60))) for _ in range(150)]
    passage = words(40)
    texts += [" ".join(words(30) + passage + words(rng.randint(0, 20))) for _ in range(60)]
    for size, edits in ((120, 4), (30, 3), (6, 2)):  # near copies with 0 … edits changed words
        base = words(90)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    chain = words(80)
    for _ in range(12):  # each a little further from the first
        chain = list(chain)
        chain[rng.randrange(80)] = f"y{rng.random()}"
        texts.append(" ".join(chain))
    texts += ["One two", "one  TWO", "one", "", None, " \n", "É a", "é a"] + [texts[0]] * 40
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize(
    "words,similarity,frequent", [(3, Fraction(9, 10), 4), (5, Fraction(4, 5), 4), (5, Fraction(4, 5), 64), (1, Fraction(1, 2), 64)]
)
def test_against_all_pairs(spark, monkeypatch, words, similarity, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = rows_with_groups(words)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, gram string")
    found = {r.id: r for r in jaccard.near_duplicates(df.repartition(5), words=words, similarity=similarity).collect()}
    assert {i: r.component for i, r in found.items()} == plain(rows, words, similarity)
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(plain_set(t, words)) for i, t in rows}


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (None, None), (7, "z z z z z z")]
    rows += [(7, "q r s t u v"), (3, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.id or 0, r.component or 0) for r in jaccard.near_duplicates(df).collect())
    assert found == [(0, 0), (0, 4), (3, 3), (4, 4), (4, 4), (7, 3), (7, 3), (9, 4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).collect() == []


def test_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "t1 t2 t3 t4 t5 t6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op10_ngram_jaccard"](spark, folder).collect()
    assert {r.doc_id: r.component_id for r in found} == plain(rows, 3, Fraction(9, 10))


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    found = {r.node: r.component for r in jaccard.components(df).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_the_filter_follows_the_count(spark, monkeypatch):
    assert [jaccard.filter_bits(n) for n in (0, 1, 10_000)] == [1 << 15, 1 << 15, 1 << 18]
    assert jaccard.filter_bits(8 << 20) == jaccard.MOST_BITS and jaccard.filter_bits((8 << 20) + 1) == 0
    texts = spark.createDataFrame([(i, f"a b c {i}") for i in range(3000)], "id long, text string")
    ids = spark.createDataFrame([(i * 10,) for i in range(300)], "id long")
    some = {r.id for r in jaccard.whole_sets(texts, ids, 2).collect()}
    assert set(range(0, 3000, 10)) <= some and len(some) < 600
    monkeypatch.setattr(jaccard, "MOST_BITS", 1 << 10)
    assert {r.id for r in jaccard.whole_sets(texts, ids, 2).collect()} == set(range(0, 3000, 10))


def test_near_copies_under_null_ids_leave_one_row(spark):
    """In the pipeline's stage every row is a document of its own."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(120)]  # two of the copies share 107 or more of 125 shingles
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (3, 60, 117)]
    rows = [(None, t) for t in near] + [(1, "something else that stands alone here"), (1, "another text that has the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1]
