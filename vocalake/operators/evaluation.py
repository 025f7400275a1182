"""Evaluation: classification reports, equal error rate, confusion tables, error rates, metric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalake.operators import joins
from vocalake.operators.kernels import token_errors


def f1_report(rows: DataFrame, gold: str, pred: str, classes: list) -> DataFrame:
    """(class, tp, n_pred, support, precision, recall, f1) of every class; a rate without rows is 0."""
    spread = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("class"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("t")),
                                           F.struct(F.col(pred).alias("class"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    sums = spread.groupBy("x.class").agg(F.sum("x.t").alias("tp"), F.sum("x.p").alias("n_pred"), F.sum("x.g").alias("support"))
    kind = rows.schema[gold].dataType.simpleString()
    all_ = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in classes], f"class {kind}"))
    filled = all_.join(sums, "class", "left").na.fill(0, ["tp", "n_pred", "support"])
    rate = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    filled = filled.withColumns({"precision": rate("tp", "n_pred"), "recall": rate("tp", "support")})
    both = F.col("precision") + F.col("recall")
    return filled.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def f1_averages(report: DataFrame, chosen: list) -> DataFrame:
    """(macro_f1_chosen, macro_f1, weighted_f1, accuracy): the first over the chosen classes only."""
    return report.agg(
        F.avg(F.when(F.col("class").isin(chosen), F.col("f1"))).alias("macro_f1_chosen"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
    )


#: Ranges of scores over which the running counts are carried on; each is a task of its own.
RANGES = 256


def equal_error_rate(scores: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """(eer, threshold): where the miss and false-alarm rates are closest, thresholds falling, ties by key.

    The running counts are sums over ranges of scores, then over the scores of a range, then over the rows of a score
    in the order of their keys, so that the only global order is one of RANGES sums. Only the scores between whose rows
    the balance can lie, two or three, have their rows put in order. NaN if a class has no row. Rates are compared
    as whole numbers of rows.
    """
    rows = scores.filter(F.col(label).isin(0, 1)).select(F.col(score).cast("double").alias("score"), F.col(label).alias("label"), F.col(key).alias("key"))
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("P"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("N"))
    by_score = rows.groupBy("score").agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("misses"))
    ends = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    place = F.least(F.floor((F.col("high") - F.col("score")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
    by_score = by_score.crossJoin(F.broadcast(ends)).withColumn("range", F.when(F.col("high") > F.col("low"), place).otherwise(0))
    sums = by_score.groupBy("range").agg(F.sum("hits").alias("rp"), F.sum("misses").alias("rn"))
    before = W.orderBy("range")
    sums = sums.select(F.col("range").alias("r"), (F.sum("rp").over(before) - F.col("rp")).alias("rp"), (F.sum("rn").over(before) - F.col("rn")).alias("rn"))
    order = W.partitionBy("range").orderBy(F.desc("score"))
    base = by_score.join(F.broadcast(sums), by_score["range"] == sums["r"]).select(
        F.col("score").alias("at"), (F.col("rp") + F.sum("hits").over(order) - F.col("hits")).alias("p0"), (F.col("rn") + F.sum("misses").over(order) - F.col("misses")).alias("n0"), "hits", "misses"
    )
    base = base.crossJoin(F.broadcast(total))
    # the gap falls from row to row: only the scores at whose ends it changes its sign, or is least, can hold the balance
    start = (F.col("P") - F.col("p0")) * F.col("N") - F.col("n0") * F.col("P")
    end = (F.col("P") - F.col("p0") - F.col("hits")) * F.col("N") - (F.col("n0") + F.col("misses")) * F.col("P")
    base = base.withColumns({"least": F.when((start >= 0) & (end <= 0), F.lit(0).cast("long")).otherwise(F.least(F.abs(start), F.abs(end)))})
    edge = base.agg(F.min(F.abs(end)).alias("edge"))
    near = base.crossJoin(F.broadcast(edge)).filter((F.col("least") == 0) | (F.abs(end) <= F.col("edge"))).drop("edge", "least", "hits", "misses")
    inner = W.partitionBy("score").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    running = rows.join(F.broadcast(near), rows["score"] == near["at"]).withColumns({"tp": F.col("p0") + F.sum("label").over(inner), "fp": F.col("n0") + F.sum(1 - F.col("label")).over(inner)})
    gap = F.abs((F.col("P") - F.col("tp")) * F.col("N") - F.col("fp") * F.col("P"))
    rate = (1 - F.col("tp") / F.col("P") + F.col("fp") / F.col("N")) / 2
    found = running.filter("P > 0 AND N > 0").agg(F.min_by(F.struct(rate.alias("eer"), "score"), F.struct(gap, -F.col("score"), "key")).alias("best"))
    return found.select(F.coalesce("best.eer", F.lit(float("nan"))).alias("eer"), F.coalesce("best.score", F.lit(float("nan"))).alias("threshold"))


def confusion(matched: DataFrame, kinds: DataFrame, pred: str, gold: str) -> DataFrame:
    """(pred_kind, gold_kind, n) for all pairs of kinds, 0 where nothing matched. kinds: (kind), a fixed short list."""
    grid = kinds.select(F.col("kind").alias("pred_kind")).crossJoin(F.broadcast(kinds.select(F.col("kind").alias("gold_kind"))))
    found = matched.groupBy(F.col(pred).alias("pred_kind"), F.col(gold).alias("gold_kind")).agg(F.count("*").alias("n"))
    return grid.join(found, ["pred_kind", "gold_kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def word_error_rate(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """(errors, words, wer): edits over all pairs of token arrays by the reference's tokens; NaN without any."""
    counted = pairs.select(token_errors(reference, hypothesis).alias("e"), F.size(reference).alias("n"))
    sums = counted.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")).otherwise(F.lit(float("nan"))))


def character_error_rate(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """(errors, chars, cer) by the built-in edit distance."""
    sums = pairs.agg(F.sum(F.levenshtein(reference, hypothesis)).alias("errors"), F.sum(F.length(reference)).alias("chars"))
    return sums.withColumn("cer", F.when(F.col("chars") > 0, F.col("errors") / F.col("chars")).otherwise(F.lit(float("nan"))))


def span_errors(reference: DataFrame, hypothesis: DataFrame, spans: DataFrame, by: str, label: str = "label") -> DataFrame:
    """(label, errors, words, n_spans, wer): the words of both sides that share time with each span, by the span's label.

    reference and hypothesis: (by, w_id, w, w_start, w_end), spans: (by, s_id, s_start, s_end, label). A word belongs to every
    span with which it shares more than 50 ms; spans without a word on either side are left out.
    """

    def of(words: DataFrame, name: str) -> DataFrame:
        met = joins.overlapping(words, spans, by)
        ordered = F.array_sort(F.collect_list(F.struct("w_id", "w")))
        return met.groupBy(by, "s_id", label).agg(F.transform(ordered, lambda x: x["w"]).alias(name))

    both = of(reference, "ref").join(of(hypothesis, "hyp").drop(label), [by, "s_id"])
    counted = both.select(label, token_errors("ref", "hyp").alias("e"), F.size("ref").alias("n"))
    sums = counted.groupBy(label).agg(F.sum("e").alias("errors"), F.sum("n").alias("words"), F.count("*").alias("n_spans"))
    return sums.withColumn("wer", F.col("errors") / F.col("words"))


def merged_reports(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, first, second): the metrics (name, value) of two reports, null where one lacks a name."""
    a, b = first.select("name", F.col("value").alias("first")), second.select("name", F.col("value").alias("second"))
    return a.join(b, "name", "full")


def deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, before, after, delta): the change of each metric from the first report to the second; null if one lacks it."""
    both = merged_reports(first, second).withColumnsRenamed({"first": "before", "second": "after"})
    return both.withColumn("delta", F.col("after") - F.col("before"))


def counts_report(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """One row: n, and n_<class> of every class, counted with partial sums."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])


def summary(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(name, value, limit, passed): all limits and metrics; a metric that is missing or null doesn't pass, one without a limit has none to pass."""
    joined = limits.join(metrics, "name", "full")
    passed = F.when(F.col("limit").isNotNull(), F.coalesce(F.col("value") < F.col("limit"), F.lit(False)))
    return joined.select("name", "value", "limit", passed.alias("passed"))
