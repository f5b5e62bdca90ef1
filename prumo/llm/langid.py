"""Language by words first, character n-grams for words never seen.

A model holds, per language, the log frequency of the commonest words and of the commonest character
n-grams of words (marked at both ends). A known word speaks by its frequency; for any other the longest n for
which one of its n-grams is known does. Each word gives every language the logarithm of its part in the
word's likelihood; a text is the sum over its words.

That only compares the languages learnt. Whether a text is in the one it is given is judged against what unknown
text gets, however many languages there are: by the average log frequency of its three-letter runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.llm.common import Remembered, named, once_per_worker, sampled, sums_per_list
from prumo.session import materialize

UNKNOWN = "und"
LONGEST = 5
SMOOTHING = 0.5
LEAST = -6.0  # what one word can say against a language
BACKED = 3  # letters of the runs that tell a language from unknown text
STRAY = 0.4  # how far towards unknown text a text of the language may lie
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Log frequencies: `rows[gram]` is the line of `table` with a column per language. Words stand as they are,
    n-grams with their n before them."""

    languages: list[str]
    rows: dict[str, int]
    table: np.ndarray
    # Per language: the usual log frequency of a run of its texts, its spread, that of an unknown run, and of an unknown word.
    usual: np.ndarray


def learn(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1000,
    kept: int = 20_000,
) -> Model:
    """Count words and n-grams of a sample of about `per_language` texts of each language.

    Rows with a null text or language teach nothing. For words and for each n the `kept` most frequent are
    kept, equal counts by code point, so the model is bounded by kept·(1 + LONGEST) rows and may go to the driver.
    No rows at all give a model without languages.
    """
    labelled = docs.select(
        named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    words = (
        sampled(labelled, "lang", "id", per_language)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    words = materialize(words, "language-words")
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    places = F.sequence(F.lit(1), F.length(marked) - F.col("size") + 1)
    grams = (
        words.select("lang", "word", "n", F.explode(F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])).alias("size"))
        .filter(F.length(marked) >= F.col("size"))
        .select("lang", "n", "size", F.explode(F.transform(places, lambda i: F.substring(marked, i, F.col("size")))).alias("gram"))
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialize(
        words.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(grams),
        "language-counts",
    )
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    languages = sorted(totals["lang"].unique())
    best = pd.concat(
        [
            counts.filter(F.col("size") == k)
            .groupBy("size", "gram")
            .agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
            .orderBy(F.col("all").desc(), "gram")
            .limit(kept)
            .toPandas()
            for k in range(LONGEST + 1)
        ]
    )
    table = np.array([[by.get(lang, 0) for lang in languages] for by in best["by"]], dtype=np.float64)
    table = table.reshape(len(best), len(languages))
    usual = np.zeros((4, len(languages)))
    for k in range(LONGEST + 1):
        here = (best["size"] == k).to_numpy()
        part = totals[totals["size"] == k].set_index("lang")["n"]
        whole = np.array([part.get(lang, 0) for lang in languages], dtype=np.float64)
        unknown = np.log(SMOOTHING / (whole + SMOOTHING * max(1, here.sum())))
        if k == 0:
            usual[3] = unknown
        if k == BACKED:
            usual[:3] = _usual(table[here], whole, unknown)
        table[here] = np.log((table[here] + SMOOTHING) / (whole + SMOOTHING * max(1, here.sum())))
    names = [gram if k == 0 else f"{k}{gram}" for k, gram in zip(best["size"], best["gram"])]
    return Model(languages, dict(zip(names, range(len(names)))), table.astype(np.float32), usual)


def _usual(counts: np.ndarray, whole: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Mean and spread of the log frequency of a language's runs, each use judged without itself, and that of an unknown
    run. Runs that were not kept are unknown."""
    others = unknown + np.log((np.maximum(counts - 1, 0) + SMOOTHING) / SMOOTHING)
    lost, uses = whole - counts.sum(axis=0), np.maximum(whole, 1)
    mean = ((counts * others).sum(axis=0) + lost * unknown) / uses
    spread = np.sqrt(((counts * (others - mean) ** 2).sum(axis=0) + lost * (unknown - mean) ** 2) / uses)
    return np.array([mean, spread, unknown])


def run_keys(letters: list[np.ndarray]) -> np.ndarray:
    """One number for each run of BACKED letters, given as their first ones, second ones, …"""
    keys = np.zeros_like(letters[0])
    for column in letters:
        keys = keys << 21 | column
    return keys


class Judge:
    """Applies a model to texts; where `within` is asked for, judges them against unknown text, too."""

    def __init__(self, model: Model, within: bool = False):
        self.model, self.within = model, within
        self.words = Remembered(self.say_all)
        runs = {g[1:]: row for g, row in model.rows.items() if g[0] == str(BACKED)} if within else {}
        letters = np.frombuffer("".join(runs).encode("utf-32-le"), dtype="<u4").astype(np.int64).reshape(len(runs), BACKED)
        keys, rows = run_keys(list(letters.T)), np.fromiter(runs.values(), dtype=np.int64, count=len(runs))
        order = np.argsort(keys)
        self.run_keys, self.run_rows = keys[order], rows[order]

    def grams(self, word: str) -> list[int]:
        """The lines of the model that speak for a word: its own, or those of its longest known n-grams."""
        rows = self.model.rows
        if word in rows:
            return [rows[word]]
        marked = f"^{word}$"
        for size in range(LONGEST, 0, -1):
            found = [rows[g] for i in range(len(marked) - size + 1) if (g := f"{size}{marked[i : i + size]}") in rows]
            if found:
                return found
        return []

    def backing(self, words: list[str]) -> np.ndarray:
        """For each word the log frequencies of its runs in each language, summed, and how many they are. In a language that
        knows the word they are no less than usual."""
        usual, _, unknown, unknown_word = self.model.usual
        letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        first = np.ones(len(letters), dtype=bool)  # where a run begins that ends in the same word
        for back in range(1, BACKED):
            first[np.cumsum(sizes) - back] = False
        at = np.flatnonzero(first)
        keys = run_keys([letters[at + k] for k in range(BACKED)])
        place = np.minimum(np.searchsorted(self.run_keys, keys), max(0, len(self.run_keys) - 1))
        found = self.run_keys[place] == keys if len(self.run_keys) else np.zeros(len(keys), dtype=bool)
        said = np.broadcast_to(unknown, (len(keys), len(unknown))).copy()
        said[found] = self.model.table[self.run_rows[place[found]]]
        runs = sizes - BACKED + 1
        total = sums_per_list(said, runs)
        own = np.fromiter((self.model.rows.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = (own >= 0)[:, None] & (self.model.table[own] > unknown_word + 1e-3) if len(self.model.table) else False
        total = np.where(known, np.maximum(total, runs[:, None] * usual), total)
        return np.c_[total, runs]

    def say_all(self, chunks: list[str]) -> np.ndarray:
        """What the words of each chunk between white space say for each language, where asked for the log frequencies of their
        runs in each and their number, and how many words they are."""
        lines, per_word, per_chunk, everything = [], [], [], []
        for chunk in chunks:
            words = [chunk.lower()] if chunk.isalpha() else LETTERS.findall(chunk.lower())
            per_chunk.append(len(words))
            everything.extend(words)
            for word in words:
                found = self.grams(word)
                per_word.append(len(found))
                lines.extend(found)
        width = len(self.model.languages)
        seen = sums_per_list(self.model.table[np.array(lines, dtype=np.int64)], per_word)
        seen /= np.maximum(np.array(per_word, dtype=np.int64), 1)[:, None]
        if width:
            seen -= seen.max(axis=1, keepdims=True, initial=-1e9)
            seen -= np.log(np.exp(seen).sum(axis=1, keepdims=True))
        said = np.where(np.array(per_word, dtype=np.int64)[:, None] > 0, np.maximum(seen, LEAST), 0.0)
        out = sums_per_list(said, per_chunk)
        backed = sums_per_list(self.backing(everything), per_chunk) if self.within else np.zeros((len(chunks), 0))
        return np.c_[out, backed, per_chunk].astype(np.float32)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the text is in that language rather than in none learnt."""
        chunks = [text.split() if text else [] for text in texts]
        width = len(self.model.languages)
        said = sums_per_list(self.words.of(chunks), list(map(len, chunks)))
        count, score, within = said[:, -1], np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        names = [UNKNOWN] * len(texts)
        if width:
            # Words of one text are no independent witnesses: their sum counts as that of the root of their number.
            weighed = said[:, :width] / np.sqrt(np.maximum(count, 1))[:, None]
            parts = np.exp(weighed - weighed.max(axis=1, keepdims=True))
            best = parts.argmax(axis=1)
            score = np.where(count > 0, 1 / parts.sum(axis=1), 0.0)
            names = [self.model.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, count)]
        if width and self.within:
            # The fewer its runs, the further a text may lie from what is usual.
            runs = np.maximum(said[:, -2], 1)
            usual, spread, unknown, _ = self.model.usual[:, best]
            least = usual - STRAY * (usual - unknown) - spread / np.sqrt(runs)
            within = (count > 0) & (said[np.arange(len(texts)), width + best] / runs >= least)
        return names, score, within


def predict(spark: SparkSession, model: Model, text: Column, within: bool = False) -> Column:
    """struct<lang, score> of a text by its words alone; asked for, a third field `within` tells whether it is in that language at all.

    A null text, or one without a letter, is `und` with score 0 and not within; so is every text if the model has no
    languages. Equal scores go to the first language by code point. Texts of any length are read whole.
    """
    shared, tag = spark.sparkContext.broadcast(model), uuid4().hex
    fields = ["lang", "score", "within"][: 3 if within else 2]

    @F.arrow_udf("struct<lang: string, score: double" + (", within: boolean>" if within else ">"))
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = once_per_worker(tag, lambda: Judge(shared.value, within))
        for texts in batches:
            names, score, inside = judge.judge(texts.to_pylist())
            columns = [pa.array(names, pa.string()), pa.array(score), pa.array(inside)]
            yield pa.StructArray.from_arrays(columns[: len(fields)], fields)

    # Not to be worked out again for a filter on its result.
    return predicted.asNondeterministic()(text)
