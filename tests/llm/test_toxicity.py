"""Toxicity that is there only through misspelt terms, beside clean texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prumo.llm import toxicity
from prumo.llm.common import small_batches
from prumo.llm.queries import remainder

FOLDER = "/root/testdata/sf0.01"


def scores(model, texts):
    found = toxicity.Reader(model).features(texts) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-found))


@pytest.fixture(scope="module")
def learnt(spark):
    docs = small_batches(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    clean = docs.join(labels.filter((F.col("toxic") == 0) & (remainder(4) == 2)), "doc_id").collect()
    return toxicity.learn(docs, labels.filter(remainder(4) != 2)), [r.text for r in clean]


def test_misspelt_only_texts_are_toxic(learnt):
    model, clean = learnt
    assert (scores(model, clean) < 0.3).mean() > 0.97
    clean = [t for t, s in zip(clean, scores(model, clean)) if s < 0.3]
    for word in ("idiott", "idoit", "idi0t", "scmu", "scun", "trassh", "worthles"):
        slipped = [" ".join(t.split()[:20] + [word] + t.split()[20:]) for t in clean]
        assert (scores(model, slipped) >= 0.3).all(), word


def test_slips_and_swaps_of_clear_terms():
    lexicon = toxicity.Lexicon({"scum": 4.0, "moron": 3.0, "weak": 1.0}, {}, {"scum": 3.0, "moron": 2.0}, swaps=True)
    assert [lexicon.match(w) for w in ("scum", "scmu", "cum", "omron", "moorn", "weka", "wea")] == [
        (4.0, 0.0), (0.0, 3.0), (0.0, 3.0), (0.0, 2.0), (0.0, 2.0), (0.0, 0.0), (0.0, 0.0)
    ]
    assert lexicon.match("mcus") == (0.0, 0.0) and lexicon.near("sucm") == ["scum"]
    model = toxicity.Model({"moron": 3.0}, {}, slips={"moron": 2.0}, clean=frozenset(["boron"]))
    own, slip = toxicity.Reader(model).features(["a boron rod", "a voron rod"])
    assert own.sum() == 0 and slip[1] > 0


@pytest.mark.parametrize(
    ("text", "apart"),
    [
        ('a 5" screen, you idiot', False),
        ('she left "this open and went on to say that you idiot ' + "x " * 30 + "you idiot", False),
        ('"hello" you idiot "bye"', False),
        ('hello " hi " you idiot " bye "', False),
        ("I don't like you, idiot, it's bad", False),
        ('You are an "idiot"', False),
        ("the president said taxes rise. What an idiot", False),
        ('she wrote "you idiot here" again', True),
        ("she wrote 'you idiot' again", True),
        ("sie rief „Idiot“ und ging", True),
        ("« idiot » lui a dit le chef", True),
        ("the word idiot is an insult", True),
        ("he was called an idiot by them", True),
    ],
)
def test_quotation_and_mention_by_the_window(text, apart):
    found = toxicity.Reader(toxicity.Model({"idiot": 3.0}, {})).features([text])[0]
    assert (found[0] == 0, found[2] > 0) == (apart, apart)


def test_one_open_mark_does_not_excuse_what_follows(learnt):
    model, _ = learnt
    assert (scores(model, ['a 5" screen. ' + "on and on " * 30 + "you idiot", "you idiot"]) >= 0.3).all()
    assert (scores(model, ["the word 'idiot' is an insult", "the word idiot is an insult"]) < 0.3).all()


def test_words_around_are_learnt_from_labels(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=14))
    rows = [(i, f"{fill()} {fill()}", 0) for i in range(900)]
    rows += [(1000 + i, f"{fill()} badword {fill()}", 1) for i in range(120)]
    rows += [(2000 + i, f"{fill()} zork badword {fill()}", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(model.terms) == {"badword"} and model.context["zork"] < -1
    assert set(model.context) - set(toxicity.prior_context()) == {"zork"}
    plain, told = scores(model, ["w1 w2 badword w3", "w1 zork badword w3"])
    assert plain > 0.5 and told < 0.3
