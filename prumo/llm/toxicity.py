"""Toxicity by a learnt lexicon, matched with slips, and scored by the words around.

The lexicon (terms, and stems that begin many terms) is learnt from labelled texts and kept as a trie. A
word is run through the Levenshtein automaton of distance 1 intersected with that trie: a state is the
set of (trie node, edits so far) the automaton can be in, and moves between states are worked out on first use. So a misspelt term
is found in one pass over its letters, without listing variants. Two adjacent letters swapped are one edit.

A misspelt term counts as a fixed part of what the term counts, and only near terms that speak clearly. The part shrinks
with the term's shortness and with how often unknown words one edit away stand in clean texts; a spelling that itself
stands there is no slip. The odds of a window's hits add up.

A hit counts in the window of words around it, and apart from abuse where it is quoted or spoken about. It is quoted if
in its window the nearest mark before it opens and the nearest one after it closes, for double and for single marks alone;
one unpaired mark does nothing. It is spoken about if the words of its sentence in its window speak of words (saying,
naming, reporting) rather than to somebody. What those words are starts from a short list and moves with the labels: near
the uses of one and the same term, which words stand more often in toxic texts than in clean ones, and which less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.llm.common import Remembered, named, once_per_worker, sampled, sums_per_list
from prumo.session import materialize

WINDOW = 12  # words to either side of a hit that count with it
SHORTEST = 5  # letters from which a term may be misspelt where nothing was learnt about slips
SHORT, FULL = 4, 6  # letters from which a learnt term may be misspelt, and from which that takes nothing from its worth
SLIPS = 0.05  # the part of a term's uses that is thought misspelt
CLEAR = 0.75  # of the clearest term's weight: from there on misspelt terms count
DISCOUNT = 0.9  # what a slip counts of the same evidence spelt right
WORDS = regex.compile(r"\p{L}[\p{L}\p{N}]*")
MARKS = [regex.compile(r"[\"“”„‟«»]"), regex.compile(r"['‘’‚‛‹›]")]  # double and single
OPENS, CLOSES, LONE = 1, 2, 3  # what a mark does; a lone one the one or the other in turn
ENDS = regex.compile(r"[.!?…][\p{Pe}\p{Pf}\p{Pi}\"'*]*$")
# Words spoken to somebody count for abuse, words of saying, naming and reporting against it.
ADDRESS = """you your yours yourself you're you'll youre du dich dir dein deine deiner deinem deinen ihr euch euer eure
tu toi te ton ta tes vous votre vos tú ti eres tus usted ustedes vosotros""".split()
SAYING = """word words term terms insult insults slur slurs said says saying called calling named wrote
written quote quoted quotes quotation reported report reports shouted phrase expression means meaning
wort wörter begriff beleidigung sagte sagt sagen gesagt nannte nennt genannt schrieb schreibt geschrieben zitat zitiert bedeutet
mot mots terme insulte dit disait appelé appelle nommé écrit écrivait cité citation signifie
palabra palabras término insulto dijo dice llamó llama llamado escribió escribe cita significa""".split()
SAID = -0.5  # from this sum of the words around down, a hit is spoken about
HELD = 4.0  # uses that the short list's worth stands for
STEMS = range(4, 9)  # letters of a stem
FEATURES = 4


class Lexicon:
    """A trie of terms and stems, walked by the automaton.

    `slips` are the terms that may be misspelt and what they then weigh; by default all of SHORTEST or more letters, at
    their own weight. With `swaps` two adjacent letters in the other order are one edit, not two.
    """

    def __init__(
        self, terms: dict[str, float], stems: dict[str, float], slips: dict[str, float] | None = None, swaps: bool = False
    ):
        self.next: list[dict[str, int]] = [{}]
        if slips is None:
            slips = {t: w for t, w in terms.items() if len(t) >= SHORTEST}
        found = {kind: [self.add(word) for word in words] for kind, words in (("t", terms), ("m", stems), ("s", slips))}
        self.term, self.stem, self.slip = ([0.0] * len(self.next) for _ in range(3))
        for into, kind, words in ((self.term, "t", terms), (self.stem, "m", stems), (self.slip, "s", slips)):
            for node, weight in zip(found[kind], words.values()):
                into[node] = weight
        self.words = dict(zip(found["s"], slips))
        # Edits are only followed to where a term ends that may be misspelt.
        self.leads = [weight > 0 for weight in self.slip]
        for node in range(len(self.next) - 1, -1, -1):  # children come after their parents
            self.leads[node] |= any(self.leads[child] for child in self.next[node].values())
        self.swaps = swaps
        self.start = self.closure({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}

    def add(self, word: str) -> int:
        node = 0
        for letter in word:
            if letter not in self.next[node]:
                self.next[node][letter] = len(self.next)
                self.next.append({})
            node = self.next[node][letter]
        return node

    def closure(self, states: set[tuple]) -> frozenset:
        """Adds the states reached by leaving out one letter of a term."""
        skipped = {(child, 1) for node, edits in states if edits == 0 for child in self.next[node].values() if self.leads[child]}
        return frozenset(states | skipped)

    def move(self, state: frozenset, letter: str) -> frozenset:
        """Edits are 0, 1, or the letter that is still to come of a swapped pair."""
        found = self.moves.get((state, letter))
        if found is None:
            then = set()
            for node, edits in state:
                if isinstance(edits, str):
                    if letter == edits:
                        then.add((node, 1))
                    continue
                child = self.next[node].get(letter)
                if child is not None and (edits == 0 or self.leads[child]):
                    then.add((child, edits))
                if edits == 0 and self.leads[node]:  # another letter in its place, or one too many
                    then.update((child, 1) for child in self.next[node].values() if self.leads[child])
                    then.add((node, 1))
                    if self.swaps:
                        for first, child in self.next[node].items():
                            after = self.next[child].get(letter)
                            if first != letter and after is not None and self.leads[after]:
                                then.add((after, first))
            found = self.closure(then)
            if len(self.moves) > 50_000:
                self.moves.clear()
            self.moves[state, letter] = found
        return found

    def match(self, word: str) -> tuple[float, float]:
        """The weight of the best term or stem met exactly, and of the best term met with one slip."""
        state, stem = self.start, 0.0
        for letter in word:
            state = self.move(state, letter)
            if not state:
                return stem, 0.0
            stem = max([stem, *(self.stem[node] for node, edits in state if edits == 0)])
        exact = max([stem, *(self.term[node] for node, edits in state if edits == 0)])
        slip = max([0.0, *(self.slip[node] for node, edits in state if edits == 1)])
        return exact, 0.0 if exact else slip

    def near(self, word: str) -> list[str]:
        """The terms that may be misspelt and are met with one slip."""
        state = self.start
        for letter in word:
            state = self.move(state, letter)
            if not state:
                return []
        return sorted({self.words[node] for node, edits in state if edits == 1 and node in self.words})


def prior_context() -> dict[str, float]:
    return {**dict.fromkeys(ADDRESS, 1.0), **dict.fromkeys(SAYING, -1.0)}


def marks(chunk: str, kind: int) -> tuple[int, int]:
    """What the first and the last quotation mark of a kind do in a chunk between white space; 0 if there is none."""
    done = []
    for found in MARKS[kind].finditer(chunk):
        before, after = chunk[: found.start()], chunk[found.end() :]
        if before[-1:].isalnum() and after[:1].isalnum():
            continue  # an apostrophe
        if any(map(str.isalnum, before)) and not after[:1].isalnum():
            done.append(CLOSES)
        elif any(map(str.isalnum, after)):
            done.append(OPENS)
        else:
            done.append(LONE)
    return (done[0], done[-1]) if done else (0, 0)


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0
    slips: dict[str, float] | None = None  # weights of misspelt terms
    clean: frozenset[str] = frozenset()  # spellings near terms that are words of clean texts
    context: dict[str, float] = field(default_factory=lambda: prior_context())  # words near a hit: for abuse, or against it


class Reader:
    """The features of texts: evidence of the worst window in plain speech and in quotation, misspelt hits apart."""

    def __init__(self, model: Model):
        self.lexicon = Lexicon(model.terms, model.stems, model.slips, swaps=True)
        self.clean, self.context = model.clean, model.context
        self.words = Remembered(self.look_all)

    def look(self, chunk: str) -> tuple[float, float]:
        """Exact and misspelt evidence (odds) of a chunk between white space."""
        exact = slip = 0.0
        lowered = chunk.lower()
        found = WORDS.findall(lowered)
        bare = lowered.strip(".,;:!?()[]{}'\"“”„«»‘’‚‹›…-")
        if len(found) != 1 or found[0] != bare:
            found.append(bare)  # a sign in place of a letter
        for word in found:
            a, b = self.lexicon.match(word)
            exact, slip = exact + np.expm1(a), slip + (0.0 if word in self.clean else np.expm1(b))
        return exact, 0.0 if exact else slip

    def look_all(self, chunks: list[str]) -> np.ndarray:
        return np.array([self.look(c) for c in chunks], dtype=np.float32).reshape(len(chunks), 2)

    def beside(self, chunks: list[str], hits: np.ndarray) -> np.ndarray:
        """Of the chunks within WINDOW of a hit: their quotation marks, what their words say of the hits around, and whether they
        end a sentence. The rest of a text is not looked at for this."""
        out = np.zeros((len(chunks), 3))
        edge = np.zeros(len(chunks) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(0, hits - WINDOW), 1)
        np.add.at(edge, np.minimum(len(chunks), hits + WINDOW + 1), -1)
        for n in np.flatnonzero(np.cumsum(edge[:-1])).tolist():
            chunk = chunks[n]
            signs, ends = 0, False
            if not chunk.isalnum():
                for kind in (0, 1):
                    first, last = marks(chunk, kind)
                    signs += (first + 4 * last) << (4 * kind)
                ends = ENDS.search(chunk) is not None
            out[n] = signs, sum(self.context.get(word, 0.0) for word in WORDS.findall(chunk.lower())), ends
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        chunks = [text.split() if text else [] for text in texts]
        sizes = np.array(list(map(len, chunks)), dtype=np.int64)
        out = np.zeros((len(texts), FEATURES))
        looked = self.words.of(chunks)
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(sums_per_list((looked.sum(axis=1) > 0)[:, None], sizes)[:, 0]):
            mine = looked[starts[i] : starts[i] + sizes[i]].astype(np.float64)
            hits = np.flatnonzero(mine.sum(axis=1))
            out[i] = self.worst(mine, hits, self.said(self.beside(chunks[i], hits), hits))
        return out

    @staticmethod
    def worst(looked: np.ndarray, hits: np.ndarray, said: np.ndarray) -> np.ndarray:
        """The largest odds in a window, for exact and misspelt hits in plain speech and in quotation or mention."""
        out = np.zeros(FEATURES)
        for kind in (0, 1):
            for apart in (0, 1):
                weight = np.where(said == bool(apart), looked[hits, kind], 0.0)
                sums = np.concatenate([[0.0], np.cumsum(weight)])
                ends = np.searchsorted(hits, hits + 2 * WINDOW, side="right")
                out[2 * apart + kind] = np.log1p(max(0.0, (sums[ends] - sums[:-1]).max()))
        return out

    @staticmethod
    def said(beside: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Which hits are quoted or spoken about, by what stands in the window of each."""
        signs = beside[:, 0].astype(np.int64)
        around = np.concatenate([[0.0], np.cumsum(beside[:, 1])])
        stops = np.flatnonzero(beside[:, 2])
        marked = [np.flatnonzero(signs >> (4 * kind) & 15) for kind in (0, 1)]
        out = np.zeros(len(hits), dtype=bool)
        for n, at in enumerate(hits.tolist()):
            low, high = max(0, at - WINDOW), min(len(beside), at + WINDOW + 1)
            # The hit's sentence within the window.
            stop = np.searchsorted(stops, at)
            begin = max(low, int(stops[stop - 1]) + 1) if stop else low
            end = min(high, int(stops[stop]) + 1) if stop < len(stops) else high
            near = around[end] - around[begin] - beside[at, 1]
            for kind in (0, 1):
                inside = quotation(marked[kind], signs >> (4 * kind) & 15, low, high, at) if len(marked[kind]) else None
                if inside:
                    # What is said inside a quotation is not said to whom one reads; what is said around it may be.
                    first, last = max(begin, inside[0]), min(end, inside[1] + 1)
                    outside = around[end] - around[begin] - (around[max(first, last)] - around[first])
                    out[n] |= outside < -SAID
                    near = min(near, outside)
            out[n] |= near <= SAID
        return out


def quotation(marked: np.ndarray, signs: np.ndarray, low: int, high: int, at: int) -> tuple[int, int] | None:
    """The places of the marks around place `at` in low..high, if the nearest before opens and the nearest after closes.

    `signs` holds, per place, what its first mark does plus four times what its last one does.
    """
    before = marked[np.searchsorted(marked, low) : np.searchsorted(marked, at)]
    own, opened = int(signs[at]), None
    if own and OPENS in (own & 3, own >> 2):
        opened = at
    elif own and own & 3 == CLOSES == own >> 2 or not own:
        if len(before):
            last = int(signs[before[-1]]) >> 2
            lone = sum(int(signs[i]) >> 2 == LONE for i in before)
            opened = int(before[-1]) if last == OPENS or (last == LONE and lone % 2) else None
    if opened is None:
        return None
    if own and CLOSES in (own & 3, own >> 2):
        return opened, at
    after = marked[np.searchsorted(marked, at, side="right") : np.searchsorted(marked, high)]
    return (opened, int(after[0])) if len(after) and int(signs[after[0]]) & 3 in (CLOSES, LONE) else None


def _clearly(totals: dict[int, int]) -> Column:
    """A lower bound of a word's log odds ratio, so that a word met by chance a few times does not count."""
    rate = F.log((F.col("bad") + 0.5) / (totals[1] + 1)) - F.log((F.col("good") + 0.5) / (totals[0] + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    return rate - 2 * error


def _lexicon(words: DataFrame, totals: dict[int, int], support: int, most: int, odds: float) -> dict[str, float]:
    """Words of (word, bad, good) whose smoothed odds of standing in a toxic text speak for it: the `most` clearest."""
    rows = (
        words.filter(F.col("bad") >= support)
        .select("word", _clearly(totals).alias("weight"))
        .filter(F.col("weight") > odds)
        .orderBy(F.col("weight").desc(), "word")
        .limit(most)
        .collect()
    )
    return {r["word"]: float(r["weight"]) for r in rows}


def _slips(
    words: DataFrame, terms: dict[str, float], totals: dict[int, int], most: int
) -> tuple[dict[str, float], frozenset[str]]:
    """What misspelt terms weigh, and the spellings near them that are words of clean texts: the `most` commonest."""
    least = CLEAR * max(terms.values(), default=0.0)
    clear = {t: w for t, w in terms.items() if len(t) >= SHORT and w >= least}
    if not clear:
        return {}, frozenset()
    shared, tag = words.sparkSession.sparkContext.broadcast(clear), uuid4().hex

    @F.arrow_udf("array<string>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = once_per_worker(tag, lambda: Lexicon({}, {}, shared.value, swaps=True))
        for batch in batches:
            yield pa.array([lexicon.near(word) for word in batch.to_pylist()], pa.list_(pa.string()))

    met = words.filter("good > 0").select("word", "bad", "good", near.asNondeterministic()("word").alias("terms"))
    met = materialize(met.filter((F.size("terms") > 0) & ~F.col("word").isin(list(terms))), "toxicity-near")
    # Spellings met again are known; those met once say how often another one comes along.
    once = met.filter("good = 1").select(F.explode("terms").alias("term"))
    crowd = once.groupBy("term").agg(F.count("*").alias("n"))
    crowd = {r["term"]: r["n"] for r in crowd.collect()}
    uses = {r["word"]: r["bad"] for r in words.filter(F.col("word").isin(list(clear))).select("word", "bad").collect()}
    slips = {}
    for term, weight in clear.items():
        meant, chance = SLIPS * uses[term] / (totals[1] + 1), (crowd.get(term, 0) + 0.5) / (totals[0] + 1)
        part = min(1.0, len(term) / FULL) * meant / (meant + chance)
        slips[term] = float(np.log1p(part * np.expm1(weight)))
    # A spelling of clean texts is a word of its own, unless it speaks for toxic ones itself.
    own = met.filter(_clearly(totals) <= 1.0)
    own = own.orderBy(F.col("good").desc(), "word").limit(most).select("word").collect()
    return slips, frozenset(r["word"] for r in own)


def _context(texts: DataFrame, terms: dict[str, float], most: int) -> dict[str, float]:
    """What words within WINDOW of a term speak for: above zero for abuse, below for saying.

    Uses of each term are compared with other uses of the same term only (Peto's odds ratio over terms), so neither the
    terms themselves nor a language rich in them teaches anything. Copies of a window count once. Of the short
    list every word moves; of all other words the `most` that differ clearly are taken.
    """
    held = prior_context()
    if not terms:
        return held
    found = texts.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{N}]*"), 0).alias("w"))
    places = F.filter(
        F.transform("w", lambda word, i: F.struct(word.alias("term"), i.alias("at"))), lambda p: p["term"].isin(list(terms))
    )
    begin = F.greatest(F.lit(1), F.col("p.at") + 1 - WINDOW)
    near = F.array_remove(F.array_distinct(F.slice("w", begin, F.col("p.at") + 2 + WINDOW - begin)), F.col("p.term"))
    uses = found.select("toxic", "w", F.explode(places).alias("p"))
    uses = materialize(uses.select("toxic", F.col("p.term").alias("term"), near.alias("near")).distinct(), "toxicity-context")
    rates = uses.groupBy("term").agg(F.avg("toxic").alias("rate"))
    words = (
        uses.join(F.broadcast(rates), "term")
        .filter((F.col("rate") > 0) & (F.col("rate") < 1))
        .select(F.explode("near").alias("word"), (F.col("toxic") - F.col("rate")).alias("more"), "rate")
        .groupBy("word")
        .agg(F.sum("more").alias("more"), F.sum(F.col("rate") * (1 - F.col("rate"))).alias("spread"))
    )
    worth = F.col("more") / (F.col("spread") + HELD)
    clear = F.abs(worth) > 4 / F.sqrt(F.col("spread") + HELD)
    listed = F.col("word").isin(list(held))
    rows = words.filter(clear | listed).orderBy(listed.desc(), F.abs(worth).desc(), "word").limit(most + len(held)).collect()
    return held | {r["word"]: float((r["more"] + HELD * held.get(r["word"], 0.0)) / (r["spread"] + HELD)) for r in rows}


def _uses(texts: DataFrame) -> DataFrame:
    """How often each word is used in toxic (bad) and clean (good) texts, counting a use between the same two
    neighbours once: copies of one text say no more than the text."""
    found = texts.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{N}]*"), 0).alias("w"))
    uses = F.transform(
        "w",
        lambda word, i: F.struct(word.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("between")),
    )
    return (
        found.select("toxic", F.explode(uses).alias("u"))
        .select("toxic", "u.word", "u.between")
        .distinct()
        .groupBy("word")
        .agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("bad"), F.count(F.when(F.col("toxic") == 0, 1)).alias("good"))
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 3000,
    support: int = 4,
    most: int = 2000,
    odds: float = 1.5,
) -> Model:
    """Learn lexicon and weights from a sample of about `per_class` labelled texts of each class.

    Labels other than 0 and 1 and null texts teach nothing; equal labels of one id count once. The sample is drawn by
    rows, of labels and of their texts, so one id on any number of rows neither leaves it empty nor fills it beyond its bound. The
    lexicon holds at most `most` terms and `most` stems, so the model is bounded. If either class is
    missing, the lexicon is empty and every text gets the share of class 1 as its score.
    """
    labels = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("toxic"))
    labels = labels.filter("toxic IN (0, 1) AND id IS NOT NULL")
    seen = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        share = seen.get(1, 0) / max(1, sum(seen.values()))
        return Model({}, {}, bias=30.0 if share else -30.0)
    chosen = sampled(labels, "toxic", "id", per_class).select("id", "toxic").distinct()
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).filter("text IS NOT NULL")
    # The sample is bounded by per_class, so its ids may go everywhere; texts of one id are sampled once more.
    texts = materialize(texts.join(F.broadcast(chosen), "id"), "toxicity-labelled")
    texts = materialize(sampled(texts, "toxic", "id", per_class).select("id", "text", "toxic"), "toxicity-sample")
    words = materialize(_uses(texts), "toxicity-words")
    total = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    totals = {1: total["bad"] or 0, 0: total["good"] or 0}
    terms = _lexicon(words, totals, support, most, odds)
    # A stem stands for its endings, of which it needs several.
    lengths = F.sequence(F.lit(min(STEMS)), F.least(F.lit(max(STEMS)), F.length("word") - 1))
    begins = words.filter(F.length("word") > min(STEMS)).select(
        F.explode(F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "bad", "good"
    )
    endings = (
        begins.groupBy("stem")
        .agg(F.count(F.when(F.col("bad") > 0, 1)).alias("endings"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("endings") >= support)
        .withColumnRenamed("stem", "word")
    )
    stems = _lexicon(endings, totals, 2 * support, most, odds + 1.0)
    # A longer stem says no more than the shorter one it begins with.
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(min(STEMS), len(s)))}
    slips, clean = _slips(words, terms, totals, most)
    model = Model(terms, stems, slips=slips, clean=clean, context=_context(texts, terms, most))
    found = texts.select("toxic", read(texts.sparkSession, model, F.col("text")).alias("f")).collect()
    _fit(model, np.array([r["f"] for r in found]).reshape(-1, FEATURES), np.array([r["toxic"] for r in found]), seen)
    return model


def _fit(model: Model, features: np.ndarray, toxic: np.ndarray, seen: dict[int, int]) -> None:
    """Logistic regression by Newton steps, weights held to zero or above and shrunk; the bias is set back to the
    classes' shares among all labels. A slip has no weight of its own: labelled slips are too few to learn one."""
    ones = np.c_[features[:, 0::2] + DISCOUNT * features[:, 1::2], np.ones(len(features))]
    # What the sample never shows (a quotation) starts at a modest worth and moves with evidence.
    prior, pull = np.array([0.8, 0.35, 0.0]), np.array([1.0, 1.0, 1e-3])
    weight = np.zeros(len(prior))
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(ones @ weight, -30, 30)))
        slope = ones.T @ (toxic - chance) - pull * (weight - prior)
        curve = (ones * (chance * (1 - chance))[:, None]).T @ ones + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        weight = weight + step / max(1.0, np.abs(step).max())
        weight[:-1] = np.maximum(weight[:-1], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    kept = {k: max(1, int((toxic == k).sum())) for k in (0, 1)}
    plain, quoted = weight[:-1].tolist()
    model.weights = [plain, DISCOUNT * plain, quoted, DISCOUNT * quoted]
    model.bias = float(weight[-1] + np.log(seen[1] / kept[1]) - np.log(seen[0] / kept[0]))


def read(spark: SparkSession, model: Model, text: Column) -> Column:
    """array<double> of a text's features: the worst window's evidence (plain exact, plain misspelt, quoted or spoken about exact, quoted or spoken about
    misspelt). A null or empty text has zeros."""
    shared, tag = spark.sparkContext.broadcast(model), uuid4().hex

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = once_per_worker(tag, lambda: Reader(shared.value))
        for texts in batches:
            found = reader.features(texts.to_pylist())
            ends = np.arange(0, found.size + 1, FEATURES, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    # Not to be worked out again for a filter on its result.
    return features.asNondeterministic()(text)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The probability (0 to 1) that a text is toxic, by its words alone.

    A null or empty text, like any without a hit, gets the bias alone: a score near the rate of toxic texts
    without hits. Equal texts get equal scores. Texts are read whole.
    """
    found = read(spark, model, text)
    total = F.aggregate(
        F.arrays_zip(found.alias("f"), F.array(*[F.lit(w) for w in model.weights]).alias("w")),
        F.lit(model.bias),
        lambda all_, one: all_ + one["f"] * one["w"],
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
