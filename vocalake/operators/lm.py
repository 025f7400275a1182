"""N-gram language model with absolute discounting and Kneser-Ney back-off, as joins over count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.functions.text import tokenize

BEGIN, FINISH = "<s>", "</s>"
DISCOUNT, FLOOR, LEAST = 0.75, 1e-8, 1e-12


def lines(docs: DataFrame, text: str) -> DataFrame:
    """One row (line) per line with a sign that isn't white space."""
    return docs.select(F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike(r"\S"))


def _runs(tokens: Column, n: int) -> Column:
    found = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
        lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")),
    )
    return F.when(F.size(tokens) >= n, found).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))


def ngrams(tokens: Column, order: int) -> Column:
    """All runs of 1..order tokens, joined by blanks."""
    return F.concat(*[_runs(tokens, n) for n in range(1, order + 1)])


def counts(corpus: DataFrame, order: int = 3, line: str = "line") -> DataFrame:
    """(n, gram, cnt) over the lines, each between its begin and end marks."""
    marked = corpus.select(F.concat(F.array(F.lit(BEGIN)), tokenize(F.col(line)), F.array(F.lit(FINISH))).alias("t"))
    return marked.select(F.explode(ngrams(F.col("t"), order)).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("cnt"))


def counts_of_counts(corpus: DataFrame, order: int = 3, line: str = "line") -> DataFrame:
    """(n, cnt, n_grams): how many different runs of n tokens occur cnt times.

    Runs are told apart by a 64-bit hash of their tokens, so that no run is spelled out or shuffled as text.
    """
    marked = corpus.select(F.concat(F.array(F.lit(BEGIN)), tokenize(F.col(line)), F.array(F.lit(FINISH))).alias("t"))
    hashed = marked.select(F.transform("t", lambda w: F.xxhash64(w)).alias("h"))
    rows = hashed.select(F.posexplode("h").alias("i", "h0"), "h")
    parts = [F.struct(F.lit(1).alias("n"), F.col("h0").alias("gram"))]
    gram = F.col("h0")
    for n in range(2, order + 1):
        gram = F.xxhash64(gram, F.get("h", F.col("i") + (n - 1)))
        parts.append(F.when(F.size("h") >= F.col("i") + n, F.struct(F.lit(n).alias("n"), gram.alias("gram"))))
    grams = rows.select(F.explode(F.filter(F.array(*parts), lambda g: g.isNotNull())).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("cnt"))
    return grams.groupBy("n", "cnt").agg(F.count("*").alias("n_grams"))


def save(grams: DataFrame, path: str) -> None:
    """A model's counts as Parquet, by order."""
    grams.select("n", "gram", "cnt").write.mode("overwrite").partitionBy("n").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(n, gram, cnt) of a saved model."""
    return spark.read.schema("gram string, cnt long, n int").parquet(path).select("n", "gram", "cnt")


def left_contexts(grams: DataFrame, standard: bool = False) -> DataFrame:
    """(word, n_left): distinct first words of the runs that end in word; of pairs only, if standard."""
    runs = grams.filter("n = 2" if standard else "n >= 2")
    return runs.groupBy(F.substring_index("gram", " ", -1).alias("word")).agg(F.countDistinct(F.substring_index("gram", " ", 1)).alias("n_left"))


def followers(grams: DataFrame) -> DataFrame:
    """(context, n_followers): how many different words follow a context."""
    context = F.expr("substr(gram, 1, length(gram) - length(substring_index(gram, ' ', -1)) - 1)")
    return grams.filter("n >= 2").groupBy(context.alias("context")).agg(F.count("*").alias("n_followers"))


def in_context(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, w, c1, c2): each token with the one and the two before it, null where there is none."""
    tokens = texts.select(F.col(key), tokenize(F.col(text)).alias("t"))
    rows = tokens.select(key, "t", F.posexplode("t").alias("pos", "w"))
    return rows.select(key, "pos", "w", F.expr("get(t, pos - 1)").alias("c1"), F.expr("get(t, pos - 2)").alias("c2"))


def logprob(asked: DataFrame, grams: DataFrame, standard: bool = False) -> DataFrame:
    """asked's rows (w, c1, c2, ...) with logp, the natural log of the probability of w after c2 c1.

    Each different (c2, c1, w) is looked up once. standard: the continuation share is distinct left
    neighbours over pair types, not the default's contexts of all orders over pair tokens. The counts are
    gone through once: what each gram says (c: its count, f: a follower of its context, l: a left context
    of its last word, t: the total of pairs) is kept where it is asked for and summed.
    """
    text, pair = F.col("gram"), F.col("n") == 2
    context = F.expr("substr(gram, 1, length(gram) - length(substring_index(gram, ' ', -1)) - 1)")

    def said(kind: str, key: Column, value: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit(None).cast("string") if value is None else value).alias("value"))

    facts = F.array(
        said("c", text),
        F.when(F.col("n") >= 2, said("f", context)),
        F.when(pair if standard else F.col("n") >= 2, said("l", F.substring_index("gram", " ", -1), F.substring_index("gram", " ", 1))),
        F.when(pair, said("t", F.lit(""))),
    )
    facts = grams.select(F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("s"), "cnt").select("s.*", "cnt")
    asks = {"left": ("l", F.col("w")), "total": ("t", F.lit("")), "k1_n": ("c", F.col("c1")), "k1_f": ("f", F.col("c1")), "g1_n": ("c", F.concat_ws(" ", "c1", "w"))}
    asks |= {"k2_n": ("c", F.expr("c2 || ' ' || c1")), "k2_f": ("f", F.expr("c2 || ' ' || c1")), "g2_n": ("c", F.expr("c2 || ' ' || c1 || ' ' || w"))}
    slots = F.array(*[F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), key.alias("key")) for slot, (kind, key) in asks.items()])
    each = asked.select("w", "c1", "c2").distinct().select("w", "c1", "c2", F.explode(F.filter(slots, lambda s: s["key"].isNotNull())).alias("s")).select("w", "c1", "c2", "s.*")
    told = facts.join(each.select("kind", "key").distinct(), ["kind", "key"]).groupBy("kind", "key", "value").agg(F.count("*").alias("types"), F.sum("cnt").alias("tokens"))
    told = told.groupBy("kind", "key").agg(F.count("*").alias("values"), F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
    number = F.when(F.col("kind") == "l", F.col("values")).when((F.col("kind") == "f") | ((F.col("kind") == "t") & F.lit(standard)), F.col("types")).otherwise(F.col("tokens"))
    met = each.join(told.select("kind", "key", number.alias("number")), ["kind", "key"], "left").groupBy("w", "c1", "c2")
    each = met.agg(*[F.coalesce(F.max(F.when(F.col("slot") == slot, F.col("number"))), F.lit(0)).alias(slot) for slot in asks])
    low = F.greatest(F.col("left") / F.greatest("total", F.lit(1)), F.lit(FLOOR))
    for k, g in (("k1", "g1"), ("k2", "g2")):
        own = F.greatest(F.col(f"{g}_n") - DISCOUNT, F.lit(0.0)) / F.col(f"{k}_n")
        back = DISCOUNT * F.col(f"{k}_f") / F.col(f"{k}_n")
        low = F.when(F.col(f"{k}_n") == 0, low).otherwise(own + back * low)
    found = each.select(F.col("w").alias("w_"), F.col("c1").alias("c1_"), F.col("c2").alias("c2_"), F.log(F.greatest(low, F.lit(LEAST))).alias("logp"))
    same = F.col("w").eqNullSafe(F.col("w_")) & F.col("c1").eqNullSafe(F.col("c1_")) & F.col("c2").eqNullSafe(F.col("c2_"))
    return asked.join(found, same).select(*asked.columns, "logp")


def rescored(scored: DataFrame, key: str, weight: float = 0.6) -> DataFrame:
    """(key, lm_score): weight times the mean log probability of the candidate's words."""
    return scored.groupBy(key).agg((weight * F.sum("logp") / F.count("*")).alias("lm_score"))
