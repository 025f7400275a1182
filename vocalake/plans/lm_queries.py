"""Language model queries: counts, contexts, probabilities, rescoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.operators import lm
from vocalake.session import shared_path
from vocalake.sources.tables import table


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, a line each: the corpus of the model."""
    return lm.lines(table(spark, sf_dir, "conversations"), "text")


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of counts by order over all documents' lines."""
    return lm.counts_of_counts(lm.lines(table(spark, sf_dir, "documents"), "text"))


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written and read again, with the share of each word among the runs of its order."""
    path = shared_path(spark, "model")
    lm.save(lm.counts(_corpus(spark, sf_dir)), path)
    return lm.load(spark, path).groupBy("n").agg(F.count("*").alias("n_grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.counts(_corpus(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.counts(lm.lines(table(spark, sf_dir, "documents"), "text"), 1).select(F.col("gram").alias("word"), "cnt")


def left_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.left_contexts(lm.counts(_corpus(spark, sf_dir)))


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.followers(lm.counts(_corpus(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str, standard: bool = False) -> DataFrame:
    asked = lm.in_context(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return lm.logprob(asked, lm.counts(_corpus(spark, sf_dir)), standard)


def logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("item_id", "pos", "w", F.round("logp", 8).alias("logp"))


def logprob_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).select("item_id", "pos", "w", F.round("logp", 8).alias("logp"))


def rescore_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in groups of five as candidates of a segment; item_id stands in for the acoustic score."""
    scores = lm.rescored(_scored(spark, sf_dir), "item_id")
    total = F.col("lm_score") - (F.col("item_id") % 7) / 10
    best = scores.groupBy(F.floor(F.col("item_id") / 5).alias("segment")).agg(
        F.max_by("item_id", F.struct(total, -F.col("item_id"))).alias("best_item"), F.max(total).alias("score"), F.count("*").alias("n_candidates")
    )
    return best.select("segment", "best_item", F.round("score", 8).alias("score"), "n_candidates")


_TOKENS = "regexp_extract_all(lower({}), '[A-Za-z\\x{{0900}}-\\x{{097F}}]+')"


def _grams_sql(source: str, orders: str = "(1), (2), (3)") -> str:
    return f"""
ln AS (SELECT row_number() OVER () AS r, line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {source})
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
tk AS (SELECT r, list_concat(list_concat(['<s>'], {_TOKENS.format('line')}), ['</s>']) AS t FROM ln),
gr AS (SELECT n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS gram
       FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tk, (VALUES {orders}) AS o(n))),
grams AS (SELECT n, gram, count(*) AS cnt FROM gr GROUP BY n, gram)"""


_PARTS = """
fol AS (SELECT regexp_replace(gram, ' [^ ]+$', '') AS context, count(*) AS n_followers FROM grams WHERE n >= 2 GROUP BY 1)"""


def _left_sql(standard: bool = False) -> str:
    return f"""
lc AS (SELECT regexp_extract(gram, '[^ ]+$') AS word, count(DISTINCT split_part(gram, ' ', 1)) AS n_left
       FROM grams WHERE {'n = 2' if standard else 'n >= 2'} GROUP BY 1)"""


def _scored_sql(standard: bool = False) -> str:
    total = "count(*)" if standard else "sum(cnt)"
    return f"""
WITH {_grams_sql('conversations')},{_PARTS},{_left_sql(standard)},
tot AS (SELECT coalesce({total}, 0)::DOUBLE AS total FROM grams WHERE n = 2),
it AS (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark),
q AS (SELECT item_id, i - 1 AS pos, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] END AS c1, CASE WHEN i > 2 THEN t[i - 2] END AS c2
      FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM it)),
j AS (
  SELECT q.*, greatest(coalesce(n_left, 0) / greatest(total, 1), 1e-8) AS p0,
    coalesce(k1.cnt, 0) AS n1, coalesce(g1.cnt, 0) AS h1, coalesce(f1.n_followers, 0) AS f1,
    coalesce(k2.cnt, 0) AS n2, coalesce(g2.cnt, 0) AS h2, coalesce(f2.n_followers, 0) AS f2
  FROM q CROSS JOIN tot LEFT JOIN lc ON lc.word = q.w
  LEFT JOIN grams k1 ON k1.gram = c1 LEFT JOIN grams g1 ON g1.gram = c1 || ' ' || w LEFT JOIN fol f1 ON f1.context = c1
  LEFT JOIN grams k2 ON k2.gram = c2 || ' ' || c1 LEFT JOIN grams g2 ON g2.gram = c2 || ' ' || c1 || ' ' || w
  LEFT JOIN fol f2 ON f2.context = c2 || ' ' || c1),
p1 AS (SELECT *, CASE WHEN n1 = 0 THEN p0 ELSE greatest(h1 - 0.75::DOUBLE, 0) / n1 + 0.75::DOUBLE * f1 / n1 * p0 END AS p1 FROM j),
p2 AS (SELECT *, CASE WHEN n2 = 0 THEN p1 ELSE greatest(h2 - 0.75::DOUBLE, 0) / n2 + 0.75::DOUBLE * f2 / n2 * p1 END AS p2 FROM p1),
scored AS (SELECT item_id, pos, w, ln(greatest(p2, 1e-12)) AS logp FROM p2)"""


QUERIES = {
    "lm_ngram_counts": ngram_counts,
    "lm_ngrams": ngrams,
    "lm_saved_model": saved_model,
    "lm_vocabulary": vocabulary,
    "lm_left_context": left_context,
    "lm_followers": followers,
    "lm_logprob": logprob,
    "lm_logprob_standard": logprob_standard,
    "lm_rescore_best": rescore_best,
}
SQL = {
    "lm_ngram_counts": f"WITH {_grams_sql('documents')} SELECT n, cnt, count(*) AS n_grams FROM grams GROUP BY n, cnt",
    "lm_saved_model": f"WITH {_grams_sql('conversations')} SELECT n, count(*) AS n_grams, sum(cnt)::BIGINT AS total, max(cnt) AS most FROM grams GROUP BY n",
    "lm_ngrams": f"WITH {_grams_sql('conversations')} SELECT n, gram, cnt FROM grams",
    "lm_vocabulary": f"WITH {_grams_sql('documents', '(1)')} SELECT gram AS word, cnt FROM grams",
    "lm_left_context": f"WITH {_grams_sql('conversations')},{_left_sql()} SELECT word, n_left FROM lc",
    "lm_followers": f"WITH {_grams_sql('conversations')},{_PARTS} SELECT context, n_followers FROM fol",
    "lm_logprob": f"{_scored_sql()} SELECT item_id, pos::INT AS pos, w, round(logp, 8) AS logp FROM scored",
    "lm_logprob_standard": f"{_scored_sql(True)} SELECT item_id, pos::INT AS pos, w, round(logp, 8) AS logp FROM scored",
    "lm_rescore_best": f"""{_scored_sql()},
s AS (SELECT item_id, 0.6::DOUBLE * sum(logp) / count(*) - (item_id % 7) / 10 AS score FROM scored GROUP BY item_id),
b AS (SELECT *, item_id // 5 AS segment FROM s)
SELECT segment, arg_max(item_id, row(score, -item_id)) AS best_item, round(max(score), 8) AS score, count(*) AS n_candidates
FROM b GROUP BY segment""",
}
