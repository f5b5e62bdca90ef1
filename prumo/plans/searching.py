"""Queries for full-text search."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.functions.text import collapse
from prumo.operators import index as I
from prumo.operators import search as S
from prumo.plans import tables as A
from prumo.plans.registry import Tables, query
from prumo.plans.tables import with_sql
from prumo.session import files_of, materialize, shared_folder

TERMS = """page_terms AS (
  SELECT tender_id, page, unnest(w) AS lexeme, generate_subscripts(w, 1) AS pos
  FROM (SELECT tender_id, page, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM global_pages)),
postings AS (
  SELECT tender_id, page, lexeme, count(*) AS tf, list(pos ORDER BY pos) AS positions
  FROM page_terms GROUP BY tender_id, page, lexeme)"""

PAGE_KEY = ["tender_id", "page"]


def page_postings(t: Tables) -> DataFrame:
    return S.index_texts(A.global_pages(t), "text", PAGE_KEY)


BUCKET_BYTES = 32 << 20  # of documents for each bucket: a task sorts the postings of a bucket in memory

# Indexes of this session: the table of each state of the given documents.
_indexes: dict[tuple, str] = {}


def page_index(t: Tables) -> str:
    """The table of all pages' postings, written when it is first asked for and again when the documents have changed."""
    files = files_of(t.spark, f"{t.folder}/documents.parquet")
    state = (t.spark.sparkContext.applicationId, *files)
    if state not in _indexes:
        name = f"page_postings_{uuid4().hex}"
        buckets = max(I.BUCKETS, sum(length for _, length, _ in files) // BUCKET_BYTES)
        I.write_index(page_postings(t), name, PAGE_KEY, buckets=buckets, path=f"{shared_folder(t.spark)}/{name}")
        _indexes[state] = name
    return _indexes[state]


def posted_words(t: Tables, words: DataFrame) -> DataFrame:
    """The stored postings of some words; no text is read."""
    return materialize(I.look_up(t.spark, page_index(t), words, PAGE_KEY), "postings")


@query(with_sql(*A.PAGE_VIEWS, TERMS) + "SELECT tender_id, page, lexeme, CAST(pos AS BIGINT) AS pos FROM page_terms")
def page_lexemes(t: Tables) -> DataFrame:
    return S.analyze(A.global_pages(t), "text", PAGE_KEY).withColumn("pos", F.col("pos").cast("long"))


@query(
    with_sql(*A.PAGE_VIEWS, TERMS)
    + "SELECT tender_id, page, lexeme, tf, array_to_string(positions, ',') AS positions FROM postings"
)
def page_postings_table(t: Tables) -> DataFrame:
    """Postings written as a table laid out by word, then read back."""
    from prumo.session import fresh_path

    path = fresh_path(t.spark, "page-postings")
    posted = page_postings(t)
    posted.repartitionByRange("lexeme", *PAGE_KEY).sortWithinPartitions("lexeme", *PAGE_KEY).write.parquet(path)
    back = t.spark.read.schema(posted.schema).parquet(path)
    return back.select(
        *PAGE_KEY, "lexeme", F.col("tf").cast("long").alias("tf"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
    )


# Phrases: the second to fourth word of every benchmark text.
PHRASES = """bench_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT array_to_string(w[2:4], ' ') AS phrase FROM bench_words)"""


def word_slice(start: int, n: int):
    return F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN), F.lit(0)), start, n), " ")


@query(
    with_sql(*A.PAGE_VIEWS, PHRASES)
    + """SELECT p.tender_id, p.page, f.phrase FROM (
           SELECT tender_id, page, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS words FROM global_pages) p
         JOIN phrases f ON contains(p.words, ' ' || f.phrase || ' ')"""
)
def phrase_matches(t: Tables) -> DataFrame:
    phrases = t.benchmark.select(word_slice(2, 3).alias("phrase"))
    posted = posted_words(t, S.phrase_words(phrases))
    return S.match_phrase(posted, phrases, PAGE_KEY)


@query(
    with_sql(*A.PAGE_VIEWS, PHRASES)
    + """SELECT DISTINCT p.tender_id, p.page, f.profile_id FROM (
           SELECT tender_id, page, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS words FROM global_pages) p
         JOIN (SELECT item_id AS profile_id, unnest([array_to_string(w[1:2], ' '), array_to_string(w[3:5], ' ')]) AS phrase FROM bench_words) f
           ON contains(p.words, ' ' || f.phrase || ' ')"""
)
def any_phrase_matches(t: Tables) -> DataFrame:
    """Two phrases and a blank one per profile."""
    keywords = t.benchmark.select(
        F.col("item_id").alias("profile_id"), F.explode(F.array(word_slice(1, 2), word_slice(3, 3), F.lit("  "))).alias("phrase")
    )
    posted = posted_words(t, S.phrase_words(keywords))
    return S.match_any(posted, keywords, PAGE_KEY)


# Word queries from the benchmark texts: their first two words, any of the next two, not the fifth.
@query(
    with_sql(*A.PAGE_VIEWS, TERMS, PHRASES)
    + """SELECT p.tender_id, p.page, q.item_id AS query_id
         FROM (SELECT tender_id, page, list(DISTINCT lexeme) AS words FROM page_terms GROUP BY tender_id, page) p
         JOIN bench_words q ON list_contains(p.words, q.w[1]) AND list_contains(p.words, q.w[2])
           AND (list_contains(p.words, q.w[3]) OR list_contains(p.words, q.w[4])) AND NOT list_contains(p.words, q.w[5])"""
)
def word_matches(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN), F.lit(0))
    asked = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.slice(words, 1, 2).alias("all_of"), F.slice(words, 3, 2).alias("any_of"),
        F.slice(words, 5, 1).alias("none_of"),
    )
    posted = posted_words(t, asked.select(F.explode(F.concat("all_of", "any_of", "none_of")).alias("lexeme")))
    return S.match_words(posted, asked, PAGE_KEY)


WEIGHTS = """weights(tf, w) AS (
  SELECT CAST(1 AS BIGINT), CAST(1000000000 AS BIGINT)
  UNION ALL SELECT tf + 1, w + 1000000000 // ((tf + 1) * (tf + 1)) FROM weights
  WHERE tf < (SELECT max(tf) FROM postings)),
queries AS (
  SELECT item_id AS query_id, 'src' || item_id % 20 AS tender_id, list_distinct(w[1:3]) AS words FROM bench_words),
query_terms AS (SELECT query_id, tender_id, len(words) AS n, unnest(words) AS lexeme FROM queries)"""


def word_queries(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN), F.lit(0))
    return t.benchmark.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tender_id"),
        F.slice(words, 1, 3).alias("words"),
    )


@query(
    with_sql(*A.PAGE_VIEWS, TERMS, PHRASES, WEIGHTS)
    + """SELECT p.tender_id, p.page, q.query_id, CAST(sum(w.w) // any_value(q.n) AS BIGINT) AS rank, count(*) AS met
         FROM postings p JOIN query_terms q ON q.lexeme = p.lexeme JOIN weights w ON w.tf = p.tf
         GROUP BY p.tender_id, p.page, q.query_id"""
)
def frequency_rank(t: Tables) -> DataFrame:
    words = S.query_words(word_queries(t), "words", S.SIMPLE)
    posted = posted_words(t, words)
    return S.rank(posted, words, PAGE_KEY).select(*PAGE_KEY, "query_id", "rank", "met")


SEARCH = """hits AS (
  SELECT q.query_id, p.tender_id, p.page, count(*) = any_value(q.n) AS has_all, CAST(sum(w.w) // any_value(q.n) AS BIGINT) AS rank
  FROM postings p JOIN query_terms q ON q.lexeme = p.lexeme AND q.tender_id = p.tender_id JOIN weights w ON w.tf = p.tf
  GROUP BY q.query_id, p.tender_id, p.page),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY has_all DESC, rank DESC, page) AS place FROM hits
  QUALIFY place <= 6)"""


def page_search(t: Tables) -> DataFrame:
    asked = word_queries(t)
    posted = posted_words(t, S.query_words(asked, "words", S.SIMPLE))
    return S.search_pages(posted, asked)


@query(with_sql(*A.PAGE_VIEWS, TERMS, PHRASES, WEIGHTS, SEARCH) + "SELECT query_id, tender_id, page, has_all, rank, place FROM found")
def search_pages(t: Tables) -> DataFrame:
    return page_search(t).withColumn("place", F.col("place").cast("long"))


@query(
    with_sql(*A.PAGE_VIEWS, TERMS, PHRASES, WEIGHTS.replace("w[1:3]", "w[1:4]"), SEARCH.split("found AS")[0].rstrip().rstrip(","))
    + """, page_words AS (SELECT tender_id, page, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS pw FROM global_pages),
  fitting AS (
    SELECT h.query_id, h.tender_id, h.page, h.rank,
           h.has_all AND contains(' ' || array_to_string(p.pw, ' ') || ' ', ' ' || array_to_string(b.w[2:4], ' ') || ' ') AS has_all
    FROM hits h JOIN page_words p ON p.tender_id = h.tender_id AND p.page = h.page JOIN bench_words b ON b.item_id = h.query_id
    WHERE NOT coalesce(list_contains(p.pw, b.w[7]), false))
SELECT query_id, tender_id, page, has_all, rank, row_number() OVER (PARTITION BY query_id ORDER BY has_all DESC, rank DESC, page) AS place
FROM fitting QUALIFY place <= 6"""
)
def search_pages_with_phrases(t: Tables) -> DataFrame:
    """A word, a phrase of three and a word that must not stand in the page."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN), F.lit(0))
    asked = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tender_id"),
        F.slice(words, 1, 1).alias("words"), F.array(word_slice(2, 3)).alias("phrases"), F.slice(words, 7, 1).alias("none_of"),
    )
    wanted = asked.select(F.explode(F.concat("words", F.split(F.get("phrases", F.lit(0)), " "), "none_of")).alias("lexeme"))
    posted = posted_words(t, wanted)
    return S.search_pages(posted, asked).withColumn("place", F.col("place").cast("long"))


@query(
    with_sql(*A.PAGE_VIEWS, TERMS, PHRASES, WEIGHTS, SEARCH)
    + """, shown AS (
  SELECT f.query_id, f.page, string_split(trim(regexp_replace(p.text, '\\s+', ' ', 'g')), ' ') AS w, q.words
  FROM found f JOIN global_pages p ON p.tender_id = f.tender_id AND p.page = f.page JOIN queries q ON q.query_id = f.query_id),
marked AS (
  SELECT query_id, page, w, list_transform(w, lambda x: list_contains(words, regexp_extract(lower(x), '[\\p{L}\\p{N}]+'))) AS f FROM shown),
hit_at AS (SELECT query_id, page, i FROM (SELECT query_id, page, unnest(f) AS hit, generate_subscripts(f, 1) - 1 AS i FROM marked) WHERE hit),
starts AS (SELECT DISTINCT query_id, page, greatest(i - 4, 0) AS s FROM hit_at),
dense AS (
  SELECT s.query_id, s.page, s.s, count(*) AS c FROM starts s JOIN hit_at h
    ON h.query_id = s.query_id AND h.page = s.page AND h.i >= s.s AND h.i < s.s + 24 GROUP BY ALL),
first_window AS (SELECT query_id, page, arg_min(s, (-c, s)) AS s FROM dense GROUP BY query_id, page),
second_window AS (
  SELECT d.query_id, d.page, arg_min(d.s, (-d.c, d.s)) AS s FROM dense d JOIN first_window a
    ON a.query_id = d.query_id AND a.page = d.page WHERE abs(d.s - a.s) >= 24 GROUP BY d.query_id, d.page),
windows AS (SELECT * FROM first_window UNION ALL SELECT * FROM second_window)
SELECT m.query_id, m.page, string_agg(array_to_string(list_transform(
         list_zip(m.w[x.s + 1 : x.s + 24], m.f[x.s + 1 : x.s + 24]), lambda z: CASE WHEN z[2] THEN '«' || z[1] || '»' ELSE z[1] END), ' '),
         ' ... ' ORDER BY x.s) AS snippet
FROM marked m JOIN windows x ON x.query_id = m.query_id AND x.page = m.page GROUP BY m.query_id, m.page"""
)
def search_snippets(t: Tables) -> DataFrame:
    """Marked windows around the query's words on the pages that search returns."""
    found = page_search(t).join(A.global_pages(t).select(*PAGE_KEY, "text"), PAGE_KEY)
    asked = word_queries(t).select("query_id", "words")
    return S.with_headline(found.join(asked, "query_id"), "text", "words").select("query_id", "page", "snippet")


@query(
    with_sql(A.ITEMS, A.ITEMS_LAST)
    + """SELECT tender_id, number, substring(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 200) AS description,
           CAST(quantity AS DOUBLE) AS quantity, unit, CAST(unit_value AS DOUBLE) AS value, coalesce(benefit, '') AS benefit FROM (
           SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY number) AS k FROM items_last) WHERE k <= 80"""
)
def tender_items(t: Tables) -> DataFrame:
    return S.list_items(A.last_items(t)).withColumn("benefit", F.coalesce("benefit", F.lit("")))


@query(
    "SELECT doc_id, count(*) AS terms FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w NOT IN ("
    + ", ".join(f"'{w}'" for w in sorted(S.STOPWORDS_PT))
    + ") GROUP BY doc_id"
)
def portuguese_terms(t: Tables) -> DataFrame:
    """Words that the Portuguese configuration keeps, per document."""
    return S.analyze(t.documents, "text", ["doc_id"], S.PORTUGUESE).groupBy("doc_id").agg(F.count("*").alias("terms"))


@query()
def portuguese_lexemes(t: Tables) -> DataFrame:
    """The whole documents through the Portuguese configuration: words without a stem are
    stopwords. Counts per document."""
    terms = S.analyze(t.documents.withColumn("text", collapse("text")), "text", ["doc_id"], S.PORTUGUESE)
    return terms.groupBy("doc_id").agg(F.count("*").alias("terms"), F.count_distinct("lexeme").alias("lexemes"))
