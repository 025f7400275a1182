"""One query per operator of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.llm import chat, line_dedup, mixing, neighbours, pieces, pii, quality_model, quality_rules, simhash, warc
from vocalake.llm.common import WORD
from vocalake.sources.tables import table


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_STOP = sorted({form for w in quality_rules.STOP_WORDS for form in (w, w.capitalize())})

#: The same counts and rules, each window and line as its own row.
OP4_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS txt FROM documents),
w AS (SELECT r, doc_id, txt, regexp_extract_all(txt, '{WORD}+') AS words FROM d),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
ln AS (
  SELECT r, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(txt, '[#*$%&|<>]')) AS n_symbols,
    len(regexp_extract_all(txt, '!')) AS n_exclamations,
    len(list_filter(words, lambda x: x IN ({_sql_list(_STOP)}))) AS n_stop_words,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•‣]'))) AS n_bullet_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM w JOIN ln USING (r) LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.2
    AND n_exclamations / n_words <= 0.4 AND n_stop_words / n_words >= 0.01
    AND n_dup_lines / n_lines <= 0.5 AND n_ellipsis_lines / n_lines <= 0.3
    AND n_bullet_lines / n_lines <= 0.9 AS kept
FROM b
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = line_dedup.clean_lines(docs, F.col("source"), "text")
    text = F.col("row.text")
    return cleaned.select("row.doc_id", "row.lang", "row.source", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_dropped")


#: White space goes from the ends of a line before it is compared.
_TRIM = "trim(ln, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
ln AS (
  SELECT r, source, i, lines[i] AS ln, regexp_matches(lines[i], '{WORD}') AS word
  FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT r, source, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL))),
seen AS (SELECT source, {_TRIM} AS k, count(DISTINCT r) AS holding FROM ln WHERE word GROUP BY ALL),
bad AS (
  SELECT s.source, k FROM seen s JOIN t ON s.source IS NOT DISTINCT FROM t.source
  WHERE holding >= {line_dedup.MIN_PAGES} AND holding > {line_dedup.RATIO} * pages),
marked AS (
  SELECT r, i, ln, word AND b.k IS NOT NULL AS gone
  FROM ln LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM ln.source AND b.k = {_TRIM}),
kept AS (
  SELECT r, coalesce(string_agg(ln, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean,
    count(*) FILTER (gone) AS n FROM marked GROUP BY r)
SELECT doc_id, lang, source, clean AS text, length(clean)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN kept USING (r)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits of a SHA-1 are four signs of base 32.
_FIVE = "('0x' || substr(sha, 5 * k + 1, 5))::BIGINT"
OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda k: {' || '.join(f"'{_BASE32}'[(({_FIVE} >> {s}) & 31) + 1]" for s in (15, 10, 5, 0))}), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("key", "doc_id")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_model.scored(docs, weights)
    predicted = (F.col("score") >= quality_model.THRESHOLD).cast("int")
    return found.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: A conversation that says control strings itself.
HOSTILE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(rows.union(own)))


#: The frame of a turn is 23 characters; a line end stands between turns; each control string and backslash adds one.
OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}')),
e AS (
  SELECT *, len(regexp_extract_all(role, '{{controls}}')) + len(regexp_extract_all(txt, '{{controls}}')) AS added FROM c),
t AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
    coalesce(string_agg(txt, '' ORDER BY turn NULLS FIRST, role, txt) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(txt) + added + {len(chat.TURN + chat.TEXT + chat.END)} + 1) - 1 AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM t
""".format(controls="|".join(re.escape(c) for c in sorted((*chat.CONTROLS, chr(92)), key=len, reverse=True)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_model": op1_quality_model,
        "op2_mixing": op2_mixing,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_rules": op4_quality_rules,
        "op5_pii": op5_pii,
        "op6_neighbours": op6_neighbours,
        "op7_line_dedup": op7_line_dedup,
        "op8_warc": op8_warc,
        "op9_simhash": op9_simhash,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op10_chat": OP10_SQL}
