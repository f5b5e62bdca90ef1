"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register `fn(table)`, where table(name) reads a given table."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op5_rendezvous_shards(table) -> DataFrame:
    """Documents over 24 equal shards, and where a 25th would take them."""
    from prumo.llm.shards import shard

    return shard(table("documents"), [1.0] * 24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, source_size, 2 * source_size::DOUBLE AS most,
         CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, most / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources),
targets AS (
  SELECT source, source_size,
         least(most, weight * (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, source NULLS FIRST LIMIT 1)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM placed
"""


@query(MIX_SQL)
def op8_mixed_sources(table) -> DataFrame:
    """What a mix of 150% of all words by source weights takes of each document."""
    from prumo.llm.mixing import mix

    docs = table("documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op1_byte_bpe(table) -> DataFrame:
    """Ids of every text by the 50k byte-level vocabulary, and the bytes they decode to, as digests."""
    import public_tokenizers

    from prumo.llm.bpe import ByteBPE
    from prumo.llm.common import small_batches

    docs = small_batches(table("documents").select("doc_id", "text"))
    bpe = ByteBPE(docs.sparkSession, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", bpe.round_trip(F.col("text")).alias("b")).select("doc_id", "b.*").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def remainder(n: int):
    """crc32 of doc_id as text, modulo n: what the held-out parts are cut by."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query()
def op6_word_first_language(table) -> DataFrame:
    """Language of every text, learnt from the documents that are not held out."""
    from prumo.llm.common import small_batches
    from prumo.llm.langid import learn, predict

    docs = small_batches(table("documents").select("doc_id", "text", "lang"))
    model = learn(docs.filter(remainder(5) != 0))
    held = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    judged = docs.select("doc_id", held, predict(docs.sparkSession, model, F.col("text")).alias("p"))
    return judged.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query()
def op9_lexicon_toxicity(table) -> DataFrame:
    """Toxicity of every text, learnt from the labels that are not held out."""
    from prumo.llm.common import small_batches
    from prumo.llm.toxicity import learn, score

    docs = small_batches(table("documents").select("doc_id", "text"))
    taught = table("labels").select("doc_id", "toxic").filter(remainder(4) != 2)
    model = learn(docs, taught)
    held = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op10_ngram_jaccard(table) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    from fractions import Fraction

    from prumo.llm.jaccard import near_duplicates

    found = near_duplicates(table("documents").select("doc_id", "text"), words=3, similarity=Fraction(9, 10))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query(
    """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
)
def op2_mtree_top_k(table) -> DataFrame:
    """The 20 rows of largest whole-number inner product for every 20th embedding."""
    from prumo.llm.mtree import top_k

    return top_k(table("embeddings"), F.col("vec_id") % 20 == 0)


@query(
    """
WITH given AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM given q JOIN given c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
)
def op7_int8_block_join(table) -> DataFrame:
    """The 20 rows of largest inner product for every 20th embedding."""
    from prumo.llm.blockjoin import nearest

    return nearest(table("embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op3_longest_match_counts(table) -> DataFrame:
    """Words and greedy longest-match tokens of every text by the 32k vocabulary."""
    import public_tokenizers

    from prumo.llm.common import small_batches
    from prumo.llm.wordpiece import pieces_of, token_counts

    docs = small_batches(table("documents").select("doc_id", "text"))
    pieces = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    counted = docs.select("doc_id", token_counts(docs.sparkSession, pieces, F.col("text")).alias("c"))
    return counted.select("doc_id", "c.n_words", "c.n_tokens")


@query()
def op4_site_quality(table) -> DataFrame:
    """Quality of every document by its text and by its source and language within the source."""
    from prumo.llm.quality import judge

    docs = table("documents").select("doc_id", "text", "source", "lang")
    judged = judge(docs, table("labels").select("doc_id", "quality").filter(remainder(4) != 2))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    return judged.select(
        F.col("id").alias("doc_id"),
        held.alias("held_out"),
        "host_rate",
        "path_rate",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


MERKLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY i) AS t
  FROM range(256) r(i)),
given AS (
  SELECT doc_id, lang, list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v:
           CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), 'string_agg', '') AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
               lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295::BIGINT) % 3 = 0 AS tampered
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN coalesce(tampered, false) THEN
           sha256(head || CASE WHEN small IS NULL THEN '-' ELSE strlen(small) || ':' || small END) END AS other FROM given),
leaves AS (
  SELECT doc_id, lang, leaf, coalesce(other, leaf) AS found, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM hashed),
tree(lvl, lang, rank, digest, n) AS (
  SELECT 0, lang, rank, leaf, n FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY lvl, lang, rank // 8, n),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(lvl, rank, digest, n) AS (
  SELECT 0, rank, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM crown WHERE n > 1 GROUP BY lvl, rank // 8, n),
nodes AS (
  SELECT lvl, 'l' || coalesce('=' || lang, '') AS tree, rank, digest, n FROM tree
  UNION ALL SELECT 1000 + lvl, '', rank, digest, n FROM crown),
-- A leaf's ancestors: by levels of its own tree, then from its subroot.
ways AS (
  SELECT l.lang, l.rank AS place, t.lvl, 'l' || coalesce('=' || l.lang, '') AS tree, l.rank // (8 ** t.lvl)::BIGINT AS rank
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT l.lang, l.rank, 1000 + c.lvl, '', s.rank // (8 ** c.lvl)::BIGINT
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT DISTINCT lvl FROM crown WHERE n > 1) c),
steps AS (
  SELECT w.lang, w.place, w.lvl, coalesce(string_agg(o.digest, '' ORDER BY o.rank) FILTER (o.rank < w.rank), '') AS before,
         coalesce(string_agg(o.digest, '' ORDER BY o.rank) FILTER (o.rank > w.rank), '') AS after
  FROM ways w JOIN nodes o ON o.lvl = w.lvl AND o.tree = w.tree AND o.rank // 8 = w.rank // 8 GROUP BY w.lang, w.place, w.lvl, w.rank),
paths AS (SELECT lang, place, list([before, after] ORDER BY lvl) AS path FROM steps GROUP BY lang, place),
proved AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM crown WHERE n = 1) AS root,
         sha256(coalesce(list_aggregate(flatten(p.path), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(list_prepend(l.found, coalesce(list_transform(p.path, lambda s: s[1] || ' ' || s[2]), [])),
                     lambda d, s: sha256(string_split(s, ' ')[1] || d || string_split(s, ' ')[2])) AS folded_root
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.rank)
SELECT *, folded_root = root AS verified FROM proved
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(table) -> DataFrame:
    """Every document proved against a Merkle root by language, and a third of them tampered with."""
    from prumo.llm.merkle import digest_of, folded, manifest, siblings_of

    docs = table("documents").select("doc_id", "source", "lang", "n_chars", "text")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = [small if c == "text" else F.col(c) for c in docs.columns]
    found = F.when(remainder(3) == 0, digest_of(changed))
    proved = manifest(docs, docs.columns, "lang", "doc_id", {"found": found}).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op13_token_planes(table) -> DataFrame:
    """Ids of every text, written to files of compressed byte planes in the order of ids, and read back."""
    import public_tokenizers

    from prumo.llm.common import small_batches
    from prumo.llm.planes import read_tokens, write_tokens
    from prumo.session import fresh_path

    docs = small_batches(table("documents").select("doc_id", "text"))
    path = fresh_path(docs.sparkSession, "token-planes")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, end=2)
    return read_tokens(docs.sparkSession, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


# Letters of the words of op12, beside a to z in either case.
ACCENTED = "À-ÿ"

VARIANT_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z{ACCENTED}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + ord(c) // 64)::BIGINT, (128 + ord(c) % 64)::BIGINT] END))),
           lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295::BIGINT) AS h
  FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
skips AS (
  SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON b.word = a.p || a.s
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON b.word = a.p || a.s),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chains AS (
  SELECT word, word AS reached, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chains c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, steps) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


@query(VARIANT_SQL)
def op12_spelling_variants(table) -> DataFrame:
    """Words of seven letters or more of all texts, every 31st with a letter lost, under their commoner spellings."""
    from prumo.llm.variants import spelling_variants

    # Words shorter than seven are not asked for, and a run does not grow.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z{ACCENTED}]{{7,}}+"), F.lit(0))
    small = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = F.when(F.col("run").rlike("[A-Z]"), small).otherwise(F.col("run")).alias("run")
    found = table("documents").select("doc_id", F.explode(runs).alias("run")).select("doc_id", lowered)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("run")).alias("word")
    words = found.withColumn("h", h).select(word).filter(F.length("word") >= 7)
    return spelling_variants(words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2"))
