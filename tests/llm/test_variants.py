"""Spelling variants beside all pairs of words, and the tries beside sets of prefixes."""

import random
from itertools import combinations

import pytest

from prumo.llm.variants import shared_prefix, spelling_variants, trie


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    beside = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(beside[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items()}


def run(spark, counts, **more):
    df = spark.createDataFrame([(w, n, 1, "x") for w, n in counts.items()], "word string, n long, id int, letters string")
    out = spelling_variants(df, **more)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = out.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture
def ranges(spark):
    """Small tables in many ranges all the same."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs(spark, ranges, seed):
    dice = random.Random(seed)
    words = {"".join(dice.choice("abé") for _ in range(dice.randint(0, 7))) for _ in range(500)}
    counts = {w: dice.choice([1, 2, 3, 20, 30, 400, 5000]) for w in words}
    assert run(spark, counts) == plain(counts)


def test_runs_of_one_letter_and_ties(spark):
    counts = {"aaaa": 3, "aaa": 30, "aa": 300, "a": 300, "": 1, "b": 300, "baaa": 30, "aaab": 30, "ab": 2}
    assert run(spark, counts) == plain(counts)
    assert run(spark, counts, ratio=2) == plain(counts, 2)


def test_chains_are_followed_to_their_last(spark):
    word = "abcdefghijklmnop"
    counts = {word[: 8 + k]: 10**k for k in range(8)}
    got = run(spark, counts)
    assert got == plain(counts) and got["abcdefgh"][1] == word[:15]


def test_very_long_words_and_a_hot_form(spark):
    long_ = "ab" * 20_000
    counts = {long_: 50, long_[:-1]: 5, long_ + "b": 2, "popular": 10_000}
    counts |= {"popular"[:i] + c + "popular"[i:]: 2 for i in range(8) for c in "qwxyz"}
    got = run(spark, counts)
    assert got[long_[:-1]][:2] == (long_, long_) and got[long_][3] == 2
    assert sum(v[1] == "popular" for v in got.values()) == 41 and got["popular"][3] == 40


def test_repeated_null_and_no_words(spark):
    df = spark.createDataFrame([("abc", 2), ("abc", 3), (None, 9), ("abd", 50)], "word string, n long")
    got = {r.word: (r.form, r.n, r.n_near) for r in spelling_variants(df).collect()}
    assert got == {"abc": ("abd", 5, 1), "abd": (None, 50, 1)}
    assert spelling_variants(df.filter("false")).collect() == []


def test_nodes_stand_for_prefixes(spark, ranges):
    """Words that share long beginnings, over many ranges: one number per prefix, one prefix per number."""
    dice = random.Random(7)
    words = {"aaaaaaaa" + "".join(dice.choice("ab") for _ in range(dice.randint(0, 12))) for _ in range(400)}
    rows = trie(spark.createDataFrame([(w,) for w in words], "letters string"), "test-trie").collect()
    assert [r.letters for r in sorted(rows, key=lambda r: r.place)] == sorted(words)
    number = {}
    for r in rows:
        assert len(r.nodes) == len(r.letters) + 1
        for k, node in enumerate(r.nodes):
            assert number.setdefault(r.letters[:k], node) == node
    assert len(set(number.values())) == len(number)


def test_shared_prefix():
    assert [shared_prefix(*p) for p in (("", "a"), ("ab", "abc"), ("abd", "abc"), ("é", "e"))] == [0, 2, 2, 0]


def test_query_on_a_fixture(spark, tmp_path):
    """Counting and lost letters, against a plain count."""
    import re
    import zlib
    from collections import Counter

    from prumo.llm.queries import QUERIES

    dice = random.Random(11)
    stock = ["Ünïcode", "Straßenbahn", "ÉLÉPHANT", "elephant", "elephants", "telephone", "Telephone", "x" * 9, "short", "a×b÷cdefgh"]
    docs = [(i, " ".join(dice.choices(stock, k=60)) + "\n1elephant2") for i in range(80)]
    docs += [(None, "telephone telephone"), (81, None), (82, ""), (83, "telephone " * 30_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for doc_id, text in docs:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run_)
            hit = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: hit % len(low)] + low[hit % len(low) + 1 :] if hit % 31 == 0 else low] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain(counts)
