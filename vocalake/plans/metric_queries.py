"""Evaluation, vector, signal and sampling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.functions import vectors as vec
from vocalake.functions.text import tokenize
from vocalake.operators import evaluation as ev
from vocalake.operators import frames as fr
from vocalake.operators import joins, models, sampling, signal
from vocalake.plans.frame_queries import _P, _TR, CLASSES, F_SQL, series
from vocalake.sources import audio
from vocalake.sources.tables import table


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each frame as gold and that of the frame before as prediction."""
    from pyspark.sql import Window as W

    before = F.lag("label", 1).over(W.partitionBy("clip_id").orderBy("frame"))
    return series(spark, sf_dir).select(F.col("label").alias("gold"), F.coalesce(before, "label").alias("pred"))


def f1_report(spark, sf_dir):
    out = ev.f1_report(_lagged(spark, sf_dir), "gold", "pred", CLASSES)
    return out.select("class", "tp", "n_pred", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


def f1_averages(spark, sf_dir):
    out = ev.f1_averages(ev.f1_report(_lagged(spark, sf_dir), "gold", "pred", CLASSES), ["click", "view"])
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def eer(spark, sf_dir):
    """labels.quality scored by the share of different tokens of the document's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    scores = docs.select("doc_id", F.coalesce(F.round(F.try_divide(F.size(F.array_distinct("t")).cast("double"), F.size("t")), 6), F.lit(0.0)).alias("score"))
    joined = scores.join(table(spark, sf_dir, "labels"), "doc_id")
    out = ev.equal_error_rate(joined, "score", "quality", "doc_id")
    return out.select(F.round("eer", 8).alias("eer"), "threshold")


def _kinds(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.concat_ws(">", "from_label", "to_label"))


def confusion(spark, sf_dir):
    """All transitions of the series against all of those of the series one frame later."""
    gold = _kinds(fr.transitions(series(spark, sf_dir))).select("clip_id", F.col("frame").alias("g"), F.col("kind").alias("g_kind"))
    pred = _kinds(fr.transitions(series(spark, sf_dir))).select("clip_id", (F.col("frame") + 1).alias("p"), F.col("kind").alias("p_kind"))
    matched = joins.greedy_matches(pred, gold, "clip_id", 3)
    kinds = spark.createDataFrame([(f"{a}>{b}",) for a in CLASSES for b in CLASSES if a != b], "kind string")
    return ev.confusion(matched, kinds, "p_kind", "g_kind")


def _pairs(spark, sf_dir) -> DataFrame:
    """Each turn of a conversation with the next."""
    rows = table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("ref"), "hyp")


def cer(spark, sf_dir):
    out = ev.character_error_rate(_pairs(spark, sf_dir), "ref", "hyp")
    return out.select("errors", "chars", F.round("cer", 8).alias("cer"))


def wer(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select(tokenize(F.col("ref")).alias("ref"), tokenize(F.col("hyp")).alias("hyp"))
    out = ev.word_error_rate(pairs, "ref", "hyp")
    return out.select("errors", "words", F.round("wer", 8).alias("wer"))


def span_wer(spark, sf_dir):
    """The words of each turn against those of the next, ten seconds each, by spans of five seconds that are early or late."""
    pairs = _pairs(spark, sf_dir).select("conv_id", "turn", tokenize(F.col("ref")).alias("ref"), tokenize(F.col("hyp")).alias("hyp"))
    key = pairs.select(F.concat_ws(":", "conv_id", "turn").alias("by"), "ref", "hyp")

    def timed(side: str) -> DataFrame:
        rows = key.select("by", F.size(side).alias("n"), F.posexplode(side).alias("w_id", "w"))
        return rows.select("by", "w_id", "w", (F.col("w_id") * 10.0 / F.col("n")).alias("w_start"), ((F.col("w_id") + 1) * 10.0 / F.col("n")).alias("w_end"))

    spans = key.select("by", F.explode(F.array(F.struct(F.lit(0).alias("s_id"), F.lit(0.0).alias("s_start"), F.lit(5.0).alias("s_end"), F.lit("early").alias("label")),
                                               F.struct(F.lit(1).alias("s_id"), F.lit(5.0).alias("s_start"), F.lit(10.0).alias("s_end"), F.lit("late").alias("label")))).alias("s")).select("by", "s.*")
    out = ev.span_errors(timed("ref"), timed("hyp"), spans, "by")
    return out.select("label", "errors", F.col("words").cast("long").alias("words"), "n_spans", F.round("wer", 8).alias("wer"))


def report_deltas(spark, sf_dir):
    """Mean length of the documents of each source: of all, then of those with a label of quality."""
    docs = table(spark, sf_dir, "documents")
    length = lambda rows: rows.groupBy(F.col("source").alias("name")).agg(F.avg(F.length("text")).alias("value"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    out = ev.deltas(length(docs), length(labelled))
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


def _stub_translator():
    """A model for tests of the slot: marks its input."""
    return lambda texts: [f"T:{t}" for t in texts]


def _stub_language():
    return lambda texts: [{"label": t[:1].lower(), "conf": 1 / (1 + len(t))} for t in texts]


def _missing_model():
    raise ImportError("no model here")


def model_translate(spark, sf_dir):
    """The slot of translation with a cache that holds every item whose text is short."""
    items = table(spark, sf_dir, "benchmark").select(F.col("text").alias("sentence"))
    cache = items.distinct().filter(F.length("sentence") < 120).select("sentence", F.concat(F.lit("C:"), "sentence").alias("translation"))
    found, _ = models.translated(items, cache, _stub_translator)
    return found.select(F.md5("sentence").alias("key"), F.substring("translation", 1, 2).alias("origin"), F.md5("translation").alias("digest"))


def model_language(spark, sf_dir):
    found = models.apply_model(table(spark, sf_dir, "benchmark").select("item_id", "text"), "language", _stub_language, "text", "lang")
    return found.select("item_id", "lang.label", F.round("lang.conf", 8).alias("conf"))


def model_embed(spark, sf_dir):
    """The slot of embeddings where no model can be loaded."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = models.apply_model(rows, "embed", models.loaded_or(_missing_model, models.pooled_vectors), "embedding", "pooled")
    return found.select("vec_id", F.round(F.col("pooled")[0].cast("double"), 5).alias("mean"), F.round(F.col("pooled")[1].cast("double"), 5).alias("sd"))


def wav_round_trip(spark, sf_dir):
    """Vectors as samples, through WAV files as bytes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(16000).alias("rate"), F.col("embedding").alias("samples"))
    back = audio.from_wav(audio.as_wav(rows, "vec_id"), "vec_id")
    return back.select("vec_id", "rate", F.posexplode("samples").alias("at", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def fixed_length(spark, sf_dir):
    """48 components of each vector from a place that follows from its number, padded with zeros."""
    rows = table(spark, sf_dir, "embeddings")
    cut = vec.fixed_length(F.col("embedding"), 48, (F.col("vec_id") % 40 + 1).cast("int"))
    return rows.select("vec_id", F.posexplode(cut).alias("at", "x")).withColumn("x", F.round("x", 6))


def summary(spark, sf_dir):
    values = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    metrics = values.select(F.explode(F.array(F.struct(F.lit("quality").alias("name"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("value")))).alias("m")).select("m.*")
    limits = spark.createDataFrame([("quality", 0.5), ("toxic", 0.25), ("missing", 1.0)], "name string, limit double")
    return ev.summary(metrics, limits).withColumn("value", F.round("value", 8))


def cosine(spark, sf_dir):
    """Each vector against the mean direction of its label."""
    rows = table(spark, sf_dir, "embeddings")
    mean = signal.components(rows, "vec_id", "embedding", "label").groupBy("label", "dim").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("all")).select("label", F.col("all.m").alias("centre"))
    return rows.join(mean, "label").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"), vec.arg_max(F.col("embedding")).alias("top"))


def stats_pool(spark, sf_dir):
    out = signal.pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("pooled").alias("dim", "value")).withColumn("value", F.round("value", 6))


def znorm(spark, sf_dir):
    return signal.z_normed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("z", F.round("z", 6))


def cmvn(spark, sf_dir):
    rows = signal.components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("vec_id", "id")
    moved = [signal.matched_statistics(rows.filter(F.col("label") == a), rows.filter(F.col("label") == (a + 1) % 10)) for a in range(10)]
    out = reduce(DataFrame.unionAll, moved)
    return out.select("id", "dim", F.round("y", 6).alias("y"))


def softmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(F.array_max(vec.softmax(F.col("embedding"))), 8).alias("p"))


def filterbank(spark, sf_dir):
    rows = signal.components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return signal.filtered(rows, signal.filterbank(spark), "vec_id").withColumn("energy", F.round("energy", 6))


def spectral_sub(spark, sf_dir):
    """Vectors of a label as the frames of a clip, in the order of vec_id."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "embeddings").withColumn("frame", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    rows = rows.select("label", "frame", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.abs(F.col("x").cast("double")))
    return signal.spectral_subtraction(rows, "label", "frame", 5).withColumn("clean", F.round("clean", 6))


def mcd(spark, sf_dir):
    """Every user's series in pairs of value and next value, against that of the next user; a user against itself is 0."""
    own = series(spark, sf_dir).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("all"))
    own = own.select("clip_id", F.transform(F.col("all.value"), lambda v: F.array(F.log1p(v), F.sqrt(v))).alias("c"))
    other = own.select((F.col("clip_id") - 1).alias("clip_id"), F.col("c").alias("b"))
    pairs = own.join(other, "clip_id").select("clip_id", F.col("c").alias("a"), "b").union(own.select((-F.col("clip_id") - 1).alias("clip_id"), F.col("c"), F.col("c")))
    return signal.cepstral_distances(pairs, "clip_id").withColumn("mcd", F.round("mcd", 6))


def balanced(spark, sf_dir):
    return sampling.balanced(table(spark, sf_dir, "labels"), "quality", "doc_id", 7).select("doc_id", "quality")


def split(spark, sf_dir):
    return sampling.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.7, 3)


def batches(spark, sf_dir):
    return sampling.batch_numbers(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 4)


def cache(spark, sf_dir):
    """Items whose text is not in the cache that holds every third; duplicates are asked for once."""
    items = table(spark, sf_dir, "benchmark")
    held = items.filter("item_id % 3 = 0").select(F.md5("text").alias("key"), F.col("item_id").alias("value"))
    hits, misses = joins.cache_split(items.select(F.md5("text").alias("key")), held, "key", "value")
    return hits.select("key", F.lit("hit").alias("state")).union(misses.select("key", F.lit("miss").alias("state")))


_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"

#: DuckDB's distance counts bytes; one control character stands in for each accented letter of the texts.
_ACCENTED = "äöüßÄÖÜéèêçñóíÉÈÊÇÑÓÍ"
_STAND_INS = "".join(chr(k) for k in range(1, 32) if k not in (9, 10, 11, 12, 13))[: len(_ACCENTED)]

QUERIES = {
    "eval_f1_report": f1_report,
    "eval_f1_averages": f1_averages,
    "eval_eer": eer,
    "eval_confusion": confusion,
    "eval_cer": cer,
    "eval_wer": wer,
    "eval_span_wer": span_wer,
    "eval_deltas": report_deltas,
    "model_translate": model_translate,
    "model_language": model_language,
    "model_embed": model_embed,
    "src_wav_round_trip": wav_round_trip,
    "vec_fixed_length": fixed_length,
    "eval_summary": summary,
    "vec_cosine": cosine,
    "vec_stats_pool": stats_pool,
    "vec_znorm": znorm,
    "vec_cmvn": cmvn,
    "vec_softmax": softmax,
    "sig_filterbank": filterbank,
    "sig_spectral_sub": spectral_sub,
    "sig_mcd": mcd,
    "sample_balanced": balanced,
    "split_grouped": split,
    "batch_numbers": batches,
    "cache_anti_join": cache,
}
_TOKENS = "regexp_extract_all(lower({}), '[A-Za-z\\x{{0900}}-\\x{{097F}}]+')"
_TOKEN_PAIRS = f"""p AS (SELECT row_number() OVER () AS id, {_TOKENS.format('a.text')} AS r, {_TOKENS.format('b.text')} AS h
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
#: The table of edit distances, a row for each token of the reference: insertions are a running least along the row.
_TOKEN_EDITS = """e AS (SELECT id, 0 AS i, r, h, range(0, len(h) + 1) AS t FROM p
  UNION ALL SELECT id, i + 1, r, h, list_transform(list_reduce(list_transform(b, lambda x, k: [x - k]), lambda x, y: list_append(x, least(x[len(x)], y[1]))), lambda x, k: x + k)
  FROM (SELECT id, i, r, h, list_transform(t, lambda x, j: CASE WHEN j = 1 THEN x + 1 ELSE least(x + 1, t[j - 1] + (h[j - 1] <> r[i + 1])::BIGINT) END) AS b FROM e WHERE i < len(r))),
d AS (SELECT id, t[len(t)] AS errors, len(r) AS n FROM e WHERE i = len(r))"""
_CLASS_ROWS = ", ".join(f"('{c}')" for c in CLASSES)
_F1 = f"""{F_SQL}, l AS (SELECT label AS gold, coalesce(lag(label) {_P}, label) AS pred FROM f),
c(class) AS (VALUES {', '.join(f"('{c}')" for c in CLASSES)}),
s AS (SELECT class, count(*) FILTER (gold = class AND pred = class) AS tp, count(*) FILTER (pred = class) AS n_pred, count(*) FILTER (gold = class) AS support FROM c, l GROUP BY class),
r AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall FROM s),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""
SQL = {
    "eval_f1_report": f"WITH {_F1} SELECT class, tp, n_pred, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM rep",
    "eval_f1_averages": f"""WITH {_F1} SELECT round(avg(f1) FILTER (class IN ('click', 'view')), 8) AS macro_f1_chosen, round(avg(f1), 8) AS macro_f1,
round(sum(f1 * support) / sum(support), 8) AS weighted_f1, round(sum(tp) / sum(support), 8)::DOUBLE AS accuracy FROM rep""",
    "eval_eer": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z\\x{0900}-\\x{097F}]+') AS t FROM documents),
s AS (SELECT t.doc_id, coalesce(round(len(list_distinct(t))::DOUBLE / nullif(len(t), 0), 6), 0) AS score, quality FROM t JOIN labels USING (doc_id)),
c AS (SELECT *, sum(quality) OVER w AS tp, sum(1 - quality) OVER w AS fp, sum(quality) OVER () AS P, sum(1 - quality) OVER () AS N FROM s WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT * FROM c ORDER BY abs((P - tp) * N - fp * P), score DESC, doc_id LIMIT 1)
SELECT round((1 - tp / P + fp / N) / 2, 8)::DOUBLE AS eer, score AS threshold FROM b""",
    "eval_cer": f"""WITH c AS (SELECT conv_id, turn, translate(text, '{_ACCENTED}', '{_STAND_INS}') AS text FROM conversations),
p AS (SELECT a.text AS ref, b.text AS hyp FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT sum(levenshtein(ref, hyp))::BIGINT AS errors, sum(length(ref))::BIGINT AS chars, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 8)::DOUBLE AS cer FROM p""",
    "eval_summary": """WITH v(name, value) AS (SELECT 'quality', avg(quality) FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels),
l(name, "limit") AS (VALUES ('quality', 0.5::DOUBLE), ('toxic', 0.25::DOUBLE), ('missing', 1.0::DOUBLE))
SELECT l.name, round(value, 8) AS value, "limit", coalesce(value < "limit", false) AS passed FROM l LEFT JOIN v USING (name)""",
    "vec_cosine": f"""WITH {_E}, m AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY ALL),
c AS (SELECT vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine FROM e JOIN m USING (label, dim) GROUP BY vec_id)
SELECT vec_id, round(cosine, 6) AS cosine, (list_position(embedding, list_max(embedding)) - 1)::INT AS top FROM c JOIN embeddings USING (vec_id)""",
    "vec_stats_pool": f"""WITH {_E}, s AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY ALL),
p AS (SELECT label, dim, m AS v FROM s UNION ALL SELECT label, dim + 64, s FROM s)
SELECT label, dim::INT AS dim, round(v / (sqrt(sum(v * v) OVER (PARTITION BY label)) + 1e-9), 6) AS value FROM p""",
    "vec_znorm": f"WITH {_E} SELECT vec_id, dim::INT AS dim, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 6) AS z FROM e WINDOW w AS (PARTITION BY dim)",
    "vec_cmvn": f"""WITH {_E}, s AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) + 1e-6 AS s FROM e GROUP BY ALL)
SELECT vec_id AS id, e.dim::INT AS dim, round(0.85::DOUBLE * ((x - a.m) / a.s * b.s + b.m) + (1 - 0.85::DOUBLE) * x, 6) AS y
FROM e JOIN s a ON a.label = e.label AND a.dim = e.dim JOIN s b ON b.label = (e.label + 1) % 10 AND b.dim = e.dim""",
    "vec_fixed_length": """WITH s AS (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(range(0, 48), lambda x: 0.0::DOUBLE)) AS v, vec_id % 40 AS o FROM embeddings),
c AS (SELECT vec_id, v[o + 1 : o + 48] AS v FROM s) SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS at, round(unnest(v), 6) AS x FROM c""",
    "eval_wer": f"""WITH RECURSIVE {_TOKEN_PAIRS}, {_TOKEN_EDITS} SELECT sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS words, round(sum(errors) / sum(n), 8)::DOUBLE AS wer FROM d""",
    "eval_span_wer": f"""WITH RECURSIVE {_TOKEN_PAIRS.replace("p AS", "q AS", 1)}, s(label, c, z) AS (VALUES ('early', 0.0::DOUBLE, 5.0::DOUBLE), ('late', 5.0::DOUBLE, 10.0::DOUBLE)),
p AS (SELECT row_number() OVER () AS id, label,
        list_filter(r, lambda w, i: least(z, i * 10.0::DOUBLE / len(r)) - greatest(c, (i - 1) * 10.0::DOUBLE / len(r)) > 0.05::DOUBLE) AS r,
        list_filter(h, lambda w, i: least(z, i * 10.0::DOUBLE / len(h)) - greatest(c, (i - 1) * 10.0::DOUBLE / len(h)) > 0.05::DOUBLE) AS h FROM q, s),
{_TOKEN_EDITS} SELECT label, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS words, count(*) AS n_spans, round(sum(errors) / sum(n), 8)::DOUBLE AS wer
FROM d JOIN p USING (id) WHERE len(p.r) > 0 AND len(p.h) > 0 GROUP BY label""",
    "eval_deltas": """WITH a AS (SELECT source AS name, avg(length(text)) AS v FROM documents GROUP BY 1),
b AS (SELECT source AS name, avg(length(text)) AS v FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT name, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b USING (name)""",
    "eval_confusion": f"""WITH RECURSIVE {F_SQL}, {_TR}, k AS (SELECT clip_id, frame, from_label || '>' || to_label AS kind FROM tr),
p AS (SELECT clip_id, frame + 1 AS p, kind, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS n FROM k),
c AS (SELECT p.clip_id, n, p.kind, coalesce(list(k.frame ORDER BY abs(k.frame - p), k.frame) FILTER (k.frame IS NOT NULL), []) AS near
      FROM p LEFT JOIN k ON k.clip_id = p.clip_id AND abs(k.frame - p) <= 3 GROUP BY p.clip_id, n, p.kind),
w AS (SELECT DISTINCT clip_id, 0::BIGINT AS n, NULL::VARCHAR AS kind, NULL::BIGINT AS took, []::BIGINT[] AS used FROM k
      UNION ALL SELECT clip_id, n, kind, took, CASE WHEN took IS NULL THEN used ELSE list_append(used, took) END
      FROM (SELECT w.clip_id, c.n, c.kind, w.used, list_filter(c.near, lambda x: NOT list_contains(w.used, x))[1] AS took FROM w JOIN c ON c.clip_id = w.clip_id AND c.n = w.n + 1)),
kinds AS (SELECT a.x || '>' || b.x AS kind FROM (VALUES {_CLASS_ROWS}) a(x), (VALUES {_CLASS_ROWS}) b(x) WHERE a.x <> b.x),
m AS (SELECT w.kind AS pred_kind, k.kind AS gold_kind, count(*) AS n FROM w JOIN k ON k.clip_id = w.clip_id AND k.frame = w.took GROUP BY ALL)
SELECT a.kind AS pred_kind, b.kind AS gold_kind, coalesce(n, 0) AS n FROM kinds a CROSS JOIN kinds b LEFT JOIN m ON m.pred_kind = a.kind AND m.gold_kind = b.kind""",
    "model_translate": """WITH t AS (SELECT text, CASE WHEN length(text) < 120 THEN 'C:' ELSE 'T:' END AS origin FROM benchmark) SELECT md5(text) AS key, origin, md5(origin || text) AS digest FROM t""",
    "model_language": "SELECT item_id, lower(text[1]) AS label, round(1 / (1 + length(text)), 8)::DOUBLE AS conf FROM benchmark",
    "model_embed": """WITH s AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT vec_id, round((m / (sqrt(m * m + s * s) + 1e-9))::FLOAT::DOUBLE, 5) AS mean, round((s / (sqrt(m * m + s * s) + 1e-9))::FLOAT::DOUBLE, 5) AS sd FROM s""",
    "src_wav_round_trip": f"""WITH {_E} SELECT vec_id, 16000 AS rate, dim::INT AS at, round(round_even((greatest(least(x::FLOAT, 1.0::FLOAT), -1.0::FLOAT) * 32767::FLOAT)::DOUBLE, 0) / 32768, 6) AS x FROM e""",
    "sig_filterbank": f"""WITH {_E}, b AS (SELECT k, floor(127 * k / 18)::INT AS low, floor(127 * (k + 1) / 18)::INT AS m, floor(127 * (k + 2) / 18)::INT AS h FROM (SELECT unnest(range(0, 8)) AS k)),
c AS (SELECT k, low, CASE WHEN m = low THEN low + 1 ELSE m END AS mid, h FROM b), t AS (SELECT k, low, mid, CASE WHEN h = mid THEN mid + 1 ELSE h END AS high FROM c),
w AS (SELECT k, bin, CASE WHEN bin < mid THEN (bin - low) / greatest(mid - low, 1) ELSE (high - bin) / greatest(high - mid, 1) END AS weight
      FROM t, (SELECT unnest(range(0, 64)) AS bin) WHERE bin >= low AND bin < high)
SELECT vec_id, k::INT AS filter, round(sum(x * x * weight), 6) AS energy FROM e JOIN w ON w.bin = e.dim WHERE weight > 0 GROUP BY ALL""",
    "vec_softmax": f"WITH {_E}, m AS (SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS t FROM e) SELECT vec_id, round(1 / sum(exp(x - t)), 8) AS p FROM m GROUP BY vec_id",
    "sig_spectral_sub": """WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
x AS (SELECT label, frame, abs(unnest(embedding)::DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM r),
p AS (SELECT label, dim, sqrt(avg(x * x)) AS noise FROM x WHERE frame < 5 GROUP BY ALL)
SELECT label, frame::INT AS frame, dim::INT AS dim, round(greatest(x - 2 * noise, 0.02::DOUBLE * x), 6) AS clean FROM x JOIN p USING (label, dim)""",
    "sample_balanced": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) AS k FROM labels),
m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM labels GROUP BY quality)) SELECT doc_id, quality FROM r, m WHERE k <= least""",
    "split_grouped": "SELECT doc_id, source, CASE WHEN ('0x' || substr(md5('3:' || source), 1, 8))::BIGINT < 3006477107 THEN 'train' ELSE 'test' END AS part FROM documents",
    "batch_numbers": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS batch FROM conversations",
    "cache_anti_join": """WITH k AS (SELECT md5(text) AS key FROM benchmark), h AS (SELECT md5(text) AS key FROM benchmark WHERE item_id % 3 = 0)
SELECT k.key, 'hit' AS state FROM k JOIN h USING (key) UNION ALL SELECT DISTINCT key, 'miss' FROM k WHERE key NOT IN (SELECT key FROM h)""",
}
