"""Each stage beside what it must do to its own input."""

import base64
import hashlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from prumo.llm.queries import QUERIES
from prumo.session import materialize, prepare
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_mixing import plain as plain_mix

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), name))
    return [df.collect() for df in out]


def test_columns_and_order(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixture", "tokens"]
    for rows in kept[1:-1]:
        assert rows[0].__fields__ == kept[0][0].__fields__


def test_language_and_toxicity_filter(spark, kept):
    given = {tuple(r) for r in kept[0]}
    assert {tuple(r) for r in kept[1]} <= given and len(kept[1]) == len(kept[0])  # all are prose in a known language
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = {r.doc_id for r in kept[1]} - {r.doc_id for r in kept[2]}
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.04 * sum(v == 0 for v in toxic.values())
    assert sum(toxic.get(i) == 1 for i in gone) >= 0.7 * sum(v == 1 for v in toxic.values())


def test_one_of_each_group(kept):
    groups = plain_groups([(r.doc_id, r.text) for r in kept[2]], 5, Fraction(4, 5))
    assert Counter(r.doc_id for r in kept[3]) == Counter({c: 1 for c in set(groups.values())})


def test_mixture(kept):
    _, taken = plain_mix([(r.doc_id, r.text, r.source) for r in kept[3]])
    words = Counter()
    for r in kept[4]:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: sum(t) for i, t in taken.items() if sum(t)})


def test_tokens(kept):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = Counter((r.doc_id, tuple(r.ids)) for r in kept[5])
    assert found == Counter((r.doc_id, tuple(other.encode_ordinary(r.text))) for r in kept[4])
    assert all(r.intact and r.n_tokens == len(r.ids) for r in kept[5])
    text = {r.doc_id: r.text for r in kept[4]}
    some = kept[5][0]
    if sum(r.doc_id == some.doc_id for r in kept[4]) == 1:
        assert some.decoded_sha256 == hashlib.sha256(text[some.doc_id].encode()).hexdigest()


def test_odd_rows_and_extra_columns(spark, tmp_path):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", None, 0, "b"), (3, "x y z", None, "s", 5, "c")]
    rows += [(None, "the and of the", "en", "s", 14, "d")] * 3 + [(4, "the and of the", "en", "s", 14, "e")] * 2
    rows += [(10 + i, f"the and of word{i} the", "en", "s", 21, "f") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.filter("false"), str(tmp_path))
        assert empty.count() == 0
        if name != "tokens":
            assert empty.columns == docs.columns
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        assert out.count() > 0
    near = corpus_pipeline.near_duplicate_groups(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in near if r.doc_id in (1, 2, 3, 4, None)) == Counter([1, 2, 3, 4])


def test_rows_without_or_with_one_id_are_documents(spark):
    one, two = (" ".join(f"{a}{i}" for i in range(40)) for a in "vw")
    rows = [(None, one), (None, one + " more"), (None, two), (7, two + " more"), (7, "something else altogether here now"), (7, one + " again")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_groups(spark, docs, FOLDER).collect()]
    assert sorted(kept) == sorted([rows[3], rows[4], rows[5]])


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
