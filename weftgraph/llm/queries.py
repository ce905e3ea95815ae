"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat, language, leaks, linededup, mixing, neardup, pieces, quality, sessions, sharding, topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sessions.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles", F.col("first").alias("kept"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=8)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_log(chat.events_of(table.unionByName(own))))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, the number of its lines' links to similar lines of another token set, the lines that go, and the clean text's digest."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.linked(docs, min_words=1)
    return found.select("doc_id", "class_id", F.col("links").alias("n_links"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = F.coalesce(held_out(), F.lit(False))
    profiles = language.fit(docs.filter(~out))
    return language.predict(docs, profiles, keep=(F.col("doc_id"), out.alias("held_out")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.digests(leaks.find(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_top_k, op2_mix, op3_near_duplicates, op4_shards, op5_quality, op6_pieces, op7_chat, op8_line_dedup, op9_language, op10_secrets)}


#: The words of a text, and its runs of five words (one shorter run if it has fewer).
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_RUNS = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1) IF len(w) > 0]"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, shingle, count(*) AS c FROM (SELECT doc_id, unnest({_RUNS}) AS shingle FROM d) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_size, 1) AS class_size, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
        # A word is covered if it is in a run of ten words that the text has twice; a repeat
        # is too long if a run of one word more than is allowed stands twice.
        "op5_quality": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
q AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word,
  unnest([CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') END FOR i IN range(1, len(w) + 1)]) AS g3,
  unnest([CASE WHEN i + 9 <= len(w) THEN array_to_string(w[i:i + 9], ' ') END FOR i IN range(1, len(w) + 1)]) AS g10 FROM t),
c AS (SELECT *, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3, g10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g10) > 1 AS r10 FROM q),
v AS (SELECT *, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, bool_or(r10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM c),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, coalesce(sum(length(word)) FILTER (c10), 0) AS covered FROM v GROUP BY 1),
most AS (SELECT doc_id, w, CAST(floor(greatest(60.0, n_words * 0.1)) AS BIGINT) + 1 AS k FROM t JOIN s USING (doc_id) WHERE covered > 0),
h AS (SELECT doc_id, unnest([md5(array_to_string(w[i:i + k - 1], ' ')) FOR i IN range(1, greatest(len(w) - k + 2, 1))]) AS g FROM most),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM h GROUP BY doc_id, g HAVING count(*) > 1)),
lines AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM t) WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT t) AS n FROM lines GROUP BY 1),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, covered FROM t LEFT JOIN s USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND CAST(covered AS DOUBLE) / word_chars <= 0.3 AND doc_id NOT IN (SELECT doc_id FROM long) AS kept
FROM b
""",
        "op8_line_dedup": f"""
WITH RECURSIVE l AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line, unnest(parts) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
),
w AS (SELECT doc_id, line, {_WORDS.format("t")} AS w FROM l),
k AS (SELECT doc_id, line, list_sort(list_distinct({_RUNS})) AS tokens FROM w WHERE len(w) > 0),
ids AS (SELECT tokens, row_number() OVER () AS id, count(*) AS copies, min((doc_id, line)) AS first FROM k GROUP BY tokens),
own AS (SELECT doc_id, line, id FROM k JOIN ids USING (tokens)),
tok AS (SELECT id, unnest(tokens) AS token, len(tokens) AS n FROM ids),
shared AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM tok a JOIN tok b ON a.token = b.token AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM shared WHERE 5 * common >= 4 * (na + nb - common)),
per AS (SELECT a AS id, sum(copies) AS links, min(first) AS early FROM e JOIN ids ON ids.id = e.b GROUP BY 1),
f AS (SELECT own.doc_id, own.line, own.id, coalesce(links, 0) AS links, ((own.doc_id, own.line) > ids.first OR coalesce((own.doc_id, own.line) > early, false)) AS gone FROM own JOIN ids USING (id) LEFT JOIN per USING (id)),
hub AS (SELECT id, min(doc_id) AS lead FROM own GROUP BY 1),
g AS (SELECT doc_id AS a, lead AS b FROM own JOIN hub USING (id) UNION SELECT x.lead, y.lead FROM e JOIN hub x ON x.id = e.a JOIN hub y ON y.id = e.b),
both_ways AS (SELECT a, b FROM g WHERE a <> b UNION SELECT b, a FROM g WHERE a <> b),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, x.b FROM reach r JOIN both_ways x ON x.a = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1),
sums AS (SELECT doc_id, sum(links) AS n_links, count(*) FILTER (gone) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone) AS removed FROM f GROUP BY 1),
left_over AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS t FROM l WHERE (doc_id, line) NOT IN (SELECT (doc_id, line) FROM f WHERE gone) GROUP BY 1)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM documents d JOIN c USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)
""",
        "op7_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
w AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\3'), '</turn>', '\/') AS written,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\3'), '</turn>', '\/'), '\', '\\'), ')', '\)') AS other
  FROM c
),
s AS (SELECT *, 15 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 7 + length(other) END + length(written) AS size FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""",
        "op1_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.c, d.c)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    }
