"""Full-text search over postings: phrases, words, rank, snippets, page search.

Query words are few and postings are many, so every lookup starts from the rarest word
of a phrase or word set; more frequent words are only checked against what that found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import ITEM_DESCRIPTION, ITEM_LIMIT, SEARCH_LIMIT, STOPWORDS_PT
from prumo.functions.stemming import stem_pt
from prumo.functions.text import as_col, collapse, collapse_cut
from prumo.operators.grouping import top_per_key
from prumo.session import materialize

TOKEN = r"[\p{L}\p{N}]+"
# Parts per billion given to the j-th occurrence of a word: 1/j², cut to whole numbers so
# that sums do not depend on their order. It reaches zero after MAX_COUNTED occurrences.
RANK_UNIT, MAX_COUNTED = 10**9, 31623
REMEMBERED = 300_000


@dataclass(frozen=True)
class Language:
    name: str
    stopwords: frozenset[str] = field(default_factory=frozenset)
    stems: bool = False


SIMPLE = Language("simple")
PORTUGUESE = Language("portuguese", STOPWORDS_PT, True)


def stemmer(language: Language):
    """Arrow UDF on token arrays: stopwords become null, the rest their stem. A task remembers the words it has met
    (up to REMEMBERED of them), so the stemming itself runs about once per word and task."""
    stop = language.stopwords

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, str | None] = {}

        def one(word: str) -> str | None:
            if word not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[word] = None if word in stop else stem_pt(word)
            return seen[word]

        for tokens in batches:
            yield tokens.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return stems


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(TOKEN), F.lit(0))


def kept(words: Column, language: Language = SIMPLE) -> Column:
    """An array of tokens as lexemes; stopwords keep their place as null."""
    if language.stems:
        return stemmer(language)(words)
    if language.stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(language.stopwords)])
        return F.transform(words, lambda w: F.when(~F.array_contains(stop, w), w))
    return words


def lexemes(text: Column | str, language: Language = SIMPLE) -> Column:
    """Array of lexemes in text order; stopwords keep their place as null."""
    return kept(tokens(text), language)


def analyze(df: DataFrame, text: Column | str, keys: list[str], language: Language = SIMPLE) -> DataFrame:
    """(keys, lexeme, pos): positions are counted before stopwords are dropped."""
    return (
        df.select(*keys, F.posexplode(lexemes(text, language)).alias("pos", "lexeme"))
        .where(F.col("lexeme").isNotNull())
        .select(*keys, "lexeme", (F.col("pos") + 1).alias("pos"))
    )


def postings(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lexeme, tf, positions): a row is as long as one text, never as long as a word's
    list of texts."""
    return terms.groupBy(*keys, "lexeme").agg(
        F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


POSTED = 1000  # texts whose words a task sorts at a time


_POSTING = T.StructType(
    [T.StructField("lexeme", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
)


@F.arrow_udf(T.ArrayType(_POSTING))
def posted_of(words: pa.Array, sizes: pa.Array) -> pa.Array:
    """The postings of each row's lexemes (null ones aside); `sizes` says how many of them each text of the row has."""

    def post(words: pa.Array, sizes: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()
        each = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each) + 1
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        said = flat.is_valid().to_numpy(zero_copy_only=False)
        code = pc.fill_null(flat.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[said]
        # One number for (row, lexeme, position): sorted, it has the positions of a lexeme of a row side by side.
        many, far = max(1, len(flat.dictionary)), int(place.max(initial=0)) + 1
        order = np.sort((row[said] * many + code) * far + place[said])
        pair = order // far
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = np.append(first, len(pair)).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array((order % far).astype(np.int32)))
        own = pair[first]
        of_row = np.searchsorted(own // many, np.arange(len(words) + 1)).astype(np.int32)
        columns = [flat.dictionary.take(pa.array(own % many)), pa.array(np.diff(ends)), positions]
        return pa.ListArray.from_arrays(pa.array(of_row), pa.StructArray.from_arrays(columns, ["lexeme", "tf", "positions"]))

    parts = [post(words.slice(at, POSTED), sizes.slice(at, POSTED)) for at in range(0, len(words), POSTED)]
    return pa.concat_arrays(parts) if parts else post(words, sizes)


def index_texts(
    df: DataFrame, text: Column | str, keys: list[str], language: Language = SIMPLE, words: DataFrame | None = None
) -> DataFrame:
    """Postings of a text column. The texts are shuffled by their key once; those of one key are then posted together, within
    their row: their words, many times as large, are neither shuffled nor sorted as rows.

    With `words(lexeme)`, for a lookup without a stored index, only those words are posted: no text is shuffled, and
    of the words only the wanted ones.
    """
    texts = df.select(*keys, as_col(text).alias("_text"))
    if words is None:
        whole = texts.repartition(*keys).groupBy(*keys).agg(F.collect_list("_text").alias("_texts"))
        split = whole.select(*keys, F.transform("_texts", lambda t: tokens(t)).alias("_tokens"))
        sizes = F.transform("_tokens", lambda w: F.size(w))
        posted = posted_of.asNondeterministic()(kept(F.flatten("_tokens"), language), sizes)
        return split.select(*keys, posted.alias("_posted")).select(*keys, F.inline("_posted"))
    terms = analyze(texts, "_text", keys, language)
    return postings(terms.join(words.select("lexeme").distinct(), "lexeme", "left_semi"), keys)


def phrase_words(phrases: DataFrame, language: Language = SIMPLE) -> DataFrame:
    """(lexeme) of `phrases(phrase)`."""
    return analyze(phrases.select("phrase").distinct(), "phrase", ["phrase"], language).select("lexeme")


def frequencies(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lexeme, texts): in how many texts the wanted lexemes occur."""
    counts = posted.groupBy("lexeme").agg(F.count("*").alias("texts"))  # added up before anything is shuffled
    return counts.join(wanted.select("lexeme").distinct(), "lexeme", "left_semi")


def match_phrase(
    posted: DataFrame, phrases: DataFrame, keys: list[str], language: Language = SIMPLE
) -> DataFrame:
    """(keys, phrase) where the words of a phrase stand at the phrase's own distances.

    `phrases(phrase)`; a phrase without lexemes matches nothing.
    """
    terms = analyze(phrases.select("phrase").distinct(), "phrase", ["phrase"], language)
    counted = terms.join(frequencies(posted, terms), "lexeme", "left")
    plans = counted.groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "pos", "lexeme")).alias("anchor"),
        F.sort_array(F.collect_list(F.struct("pos", "lexeme"))).alias("words"),
    )
    anchor = F.col("anchor")
    plans = plans.where(anchor["texts"] > 0).select(
        "phrase",
        anchor["lexeme"].alias("lexeme"),
        F.transform(
            F.filter("words", lambda w: w["pos"] != anchor["pos"]),
            lambda w: F.struct((w["pos"] - anchor["pos"]).alias("shift"), w["lexeme"].alias("lexeme")),
        ).alias("others"),
    )
    plans = materialize(plans, "phrases")
    starts = posted.join(plans, "lexeme").select(*keys, "phrase", "others", F.explode("positions").alias("at"))
    alone = starts.where(F.size("others") == 0).select(*keys, "phrase")
    need = starts.where(F.size("others") > 0).select(
        *keys, "phrase", "at", F.size("others").alias("n"), F.explode("others").alias("other")
    ).select(*keys, "phrase", "at", "n", F.col("other.lexeme").alias("lexeme"), (F.col("at") + F.col("other.shift")).alias("want"))
    met = (
        need.join(
            posted.join(terms.select("lexeme").distinct(), "lexeme", "left_semi").select(*keys, "lexeme", "positions"),
            [*keys, "lexeme"],
        )
        .where(F.array_contains("positions", F.col("want")))
        .groupBy(*keys, "phrase", "at", "n")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") == F.col("n"))
        .select(*keys, "phrase")
    )
    return alone.unionByName(met).distinct()


def match_any(posted: DataFrame, keywords: DataFrame, keys: list[str], language: Language = SIMPLE) -> DataFrame:
    """(keys, profile_id): any phrase of a profile. `keywords(profile_id, phrase)`; blank
    phrases are skipped and a profile without phrases matches nothing."""
    spoken = keywords.where(F.trim("phrase") != "").distinct()
    hits = match_phrase(posted, spoken, keys, language)
    return hits.join(spoken, "phrase").select(*keys, "profile_id").distinct()


def query_words(queries: DataFrame, column: str, language: Language) -> DataFrame:
    """(query_id, lexeme) of a text or word-array column."""
    text = F.concat_ws(" ", F.col(column))
    return analyze(queries.select("query_id", text.alias("_t")), "_t", ["query_id"], language).select(
        "query_id", "lexeme"
    ).distinct()


def match_words(posted: DataFrame, queries: DataFrame, keys: list[str], language: Language = SIMPLE) -> DataFrame:
    """(keys, query_id) for `queries(query_id, all_of, any_of, none_of)`: every word of the first,
    one of the second (if any is given), none of the third."""
    every = query_words(queries, "all_of", language)
    some = query_words(queries, "any_of", language)
    never = query_words(queries, "none_of", language)
    slim = posted.select(*keys, "lexeme")

    counted = every.join(frequencies(posted, every), "lexeme", "left")
    rarest = counted.groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "lexeme"))["lexeme"].alias("lexeme"),
        F.count("*").alias("n"),
    )
    first = slim.join(rarest, "lexeme").select(*keys, "query_id", "n", F.col("lexeme").alias("rare"))
    rest = (
        first.where(F.col("n") > 1)
        .join(every, "query_id")
        .where(F.col("lexeme") != F.col("rare"))
        .join(slim, [*keys, "lexeme"])
        .groupBy(*keys, "query_id", "n")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") == F.col("n") - 1)
    )
    all_hits = first.where(F.col("n") == 1).select(*keys, "query_id").unionByName(rest.select(*keys, "query_id"))
    any_hits = slim.join(some, "lexeme").select(*keys, "query_id").distinct()

    both = queries.select("query_id").join(some.select("query_id").distinct(), "query_id", "left_semi")
    asked_all = every.select("query_id").distinct()
    hits = (
        all_hits.join(both, "query_id", "left_anti")
        .unionByName(all_hits.join(any_hits, [*keys, "query_id"], "left_semi"))
        .unionByName(any_hits.join(asked_all, "query_id", "left_anti"))
    )
    barred = slim.join(never, "lexeme").select(*keys, "query_id")
    return hits.join(barred, [*keys, "query_id"], "left_anti")


def weight(tf: Column | str) -> Column:
    counts = F.sequence(F.lit(1), F.least(as_col(tf), F.lit(MAX_COUNTED)))
    return F.aggregate(
        counts,
        F.lit(0).cast("long"),
        lambda total, j: total + F.floor(F.lit(RANK_UNIT) / (j.cast("long") * j)).cast("long"),
    )


def rank(posted: DataFrame, words: DataFrame, keys: list[str], by: str = "query_id") -> DataFrame:
    """(keys, by, rank, met, n): frequency rank of every text that has any of a query's words.

    The mean over the query's n lexemes of Σ 1/j² for j up to the word's count in the text,
    in billionths. It orders results; its values follow no other engine's.
    """
    sizes = words.groupBy(by).agg(F.count("*").alias("n"))
    return (
        posted.join(words, "lexeme")
        .groupBy(*keys, by)
        .agg(F.sum(weight("tf")).alias("_w"), F.count("*").alias("met"))
        .join(sizes, by)
        .withColumn("rank", F.floor(F.col("_w") / F.col("n")).cast("long"))
        .drop("_w")
    )


def search_pages(
    posted: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, language: Language = SIMPLE
) -> DataFrame:
    """Best k pages per query within the query's tender: pages with all words and phrases first, then by rank.

    `posted(tender_id, page, lexeme, tf, positions)`, `queries(query_id, tender_id, words)`. Two more array columns may be given:
    `phrases`, whose words count as words and which must stand in the page for it to have all; and `none_of`, words
    that keep a page out.
    """
    words = query_words(queries, "words", language)
    if "phrases" in queries.columns:
        words = words.unionByName(query_words(queries, "phrases", language)).distinct()
    scoped = words.join(queries.select("query_id", "tender_id"), "query_id")
    sizes = words.groupBy("query_id").agg(F.count("*").alias("n"))
    scored = (
        posted.join(scoped, ["tender_id", "lexeme"])
        .groupBy("query_id", "tender_id", "page")
        .agg(F.sum(weight("tf")).alias("_w"), F.count("*").alias("met"))
        .join(sizes, "query_id")
        .select(
            "query_id",
            "tender_id",
            "page",
            (F.col("met") == F.col("n")).alias("has_all"),
            F.floor(F.col("_w") / F.col("n")).cast("long").alias("rank"),
        )
    )
    if "phrases" in queries.columns:
        asked = queries.select("query_id", "tender_id", F.explode(F.array_distinct("phrases")).alias("phrase"))
        spoken = match_phrase(posted, asked, ["tender_id", "page"], language)
        said = asked.join(spoken, ["tender_id", "phrase"]).groupBy("query_id", "page").agg(F.count("*").alias("said"))
        wanted = queries.select("query_id", F.size(F.array_distinct(F.coalesce("phrases", F.array().cast("array<string>")))).alias("wanted"))
        scored = scored.join(said, ["query_id", "page"], "left").join(wanted, "query_id")
        scored = scored.withColumn("has_all", F.col("has_all") & (F.coalesce("said", F.lit(0)) == F.col("wanted"))).drop("said", "wanted")
    if "none_of" in queries.columns:
        never = query_words(queries, "none_of", language).join(queries.select("query_id", "tender_id"), "query_id")
        barred = posted.join(never, ["tender_id", "lexeme"]).select("query_id", "page")
        scored = scored.join(barred, ["query_id", "page"], "left_anti")
    return top_per_key(
        scored, ["query_id"], [F.col("has_all").desc(), F.col("rank").desc(), F.col("page").asc()], k, "place"
    )


def with_headline(
    pages: DataFrame,
    text: str,
    words: str,
    name: str = "snippet",
    language: Language = SIMPLE,
    width: int = 24,
    lead: int = 4,
    fragments: int = 2,
) -> DataFrame:
    """Up to two windows of a page around the words of a query, the words marked «so».

    A window starts `lead` words before a hit; the one with most hits wins, then the best
    one that does not overlap it; windows are shown in text order. `words` are lexemes.
    """
    split = pages.withColumn("_shown", F.split(collapse(text), " "))
    cores = F.transform("_shown", lambda w: F.regexp_extract(F.lower(w), TOKEN, 0))
    split = split.withColumn("_cores", stemmer(language)(cores) if language.stems else cores)
    flags = F.transform("_cores", lambda c: F.coalesce(F.array_contains(as_col(words), c), F.lit(False)))
    hits = F.filter(F.transform("_flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    split = split.withColumn("_flags", flags).withColumn("_hits", hits)
    return split.withColumn(name, _headline(width, lead, fragments)).drop("_shown", "_cores", "_flags", "_hits")


def _headline(width: int, lead: int, fragments: int) -> Column:
    """From the columns `_shown` (words), `_flags` (which are hits) and `_hits` (where).

    A window holds no more hits than words, and begins `lead` words before one, so its hits are among the next few after
    those: each window looks at a slice of the hits, however many a page has.
    """
    shown, flags, hits = F.col("_shown"), F.col("_flags"), F.col("_hits")
    begin = lambda i: F.greatest(F.get(hits, i) - lead, F.lit(0))

    def window(i: Column) -> Column:
        near = F.slice(hits, F.greatest(i - lead, F.lit(0)) + 1, F.lit(width + lead))
        inside = F.size(F.filter(near, lambda h: (h >= begin(i)) & (h < begin(i) + width)))
        # Windows that begin alike (at the first word) are one.
        return F.when((i == 0) | (begin(i) != begin(i - 1)), F.struct((-inside).alias("minus"), begin(i).alias("start")))

    ranked = F.array_sort(F.filter(F.transform(hits, lambda h, i: window(i)), lambda w: w.isNotNull()))
    picked = F.aggregate(
        ranked,
        F.array().cast("array<int>"),
        lambda acc, r: F.when(
            (F.size(acc) < fragments) & ~F.exists(acc, lambda s: F.abs(s - r["start"]) < width),
            F.concat(acc, F.array(r["start"])),
        ).otherwise(acc),
    )
    marked = F.transform(
        F.arrays_zip(shown.alias("w"), flags.alias("f")),
        lambda z: F.when(z["f"], F.concat(F.lit("«"), z["w"], F.lit("»"))).otherwise(z["w"]),
    )
    pieces = F.transform(F.sort_array(picked), lambda s: F.array_join(F.slice(marked, s + 1, F.lit(width)), " "))
    return F.array_join(pieces, " ... ")


def list_items(items: DataFrame, k: int = ITEM_LIMIT) -> DataFrame:
    """The first k items of every tender by number, with plain numbers and short descriptions."""
    first = top_per_key(items, ["tender_id"], [F.col("number").asc()], k, "place")
    return first.select(
        "tender_id",
        "number",
        collapse_cut("description", ITEM_DESCRIPTION).alias("description"),
        F.col("quantity").cast("double").alias("quantity"),
        "unit",
        F.col("unit_value").cast("double").alias("value"),
        "benefit",
    )
