"""Hand-computed cases and laws for the operators of the engine."""

import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalake.functions import phonemes as ph
from vocalake.functions import text as tx
from vocalake.functions import vectors as vec
from vocalake.operators import evaluation as ev
from vocalake.operators import frames as fr
from vocalake.operators import joins, kernels, lm, models, sampling, signal
from vocalake.plans import metric_queries, text_queries
from vocalake.sources import audio
from vocalake.sources import transcripts as tr


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def series(spark, labels, clip=1):
    return spark.createDataFrame([(clip, k, label, float(k)) for k, label in enumerate(labels)], "clip_id long, frame long, label string, value double")


def test_run_lengths_tile_the_series(spark):
    got = fr.runs(series(spark, "1 1 2 2 2 0".split())).orderBy("seg_id").collect()
    assert [(r.start, r.end, r.label) for r in got] == [(0.0, 0.02, "1"), (0.02, 0.05, "2"), (0.05, 0.06, "0")]


def test_dilation(spark):
    got = fr.dilated(series(spark, ["a"] * 10 + ["b"] * 10)).filter("boundary = 1").agg(F.min("frame"), F.max("frame")).first()
    assert tuple(got) == (5, 15)


def test_frame_of_time(spark):
    rows = spark.createDataFrame([(0.29,), (0.57,)], "t double").select(fr.frame_of(F.col("t")).alias("f"))
    assert [r.f for r in rows.collect()] == [28, 56]


def _eer(spark, rows):
    df = spark.createDataFrame([(k, s, y) for k, (s, y) in enumerate(rows)], "id long, score double, label int")
    return tuple(ev.equal_error_rate(df, "score", "label", "id").first())


def test_equal_error_rate(spark):
    got = _eer(spark, [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.4, 0), (0.3, 0)])
    assert got == (pytest.approx(1 / 3), 0.7)
    assert _eer(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)]) == (0.0, 0.8)
    assert all(math.isnan(x) for x in _eer(spark, [(0.9, 1), (0.8, 1)]))


def test_back_off_probabilities(spark):
    grams = lm.counts(spark.createDataFrame([("a b c",), ("a b d",)], "line string"))
    asked = spark.createDataFrame([("c", None, None), ("c", "b", None), ("c", "b", "a"), ("z", "b", "a"), ("a", None, None)], "w string, c1 string, c2 string")
    got = {(r.w, r.c1, r.c2): r.logp for r in lm.logprob(asked, grams).collect()}
    assert math.exp(got["c", None, None]) == pytest.approx(0.25)
    assert math.exp(got["c", "b", None]) == pytest.approx(0.3125)
    assert got["c", "b", "a"] == pytest.approx(-1.023389, abs=1e-6)
    assert got["z", "b", "a"] == pytest.approx(-18.996045, abs=1e-6)
    assert math.exp(got["a", None, None]) == pytest.approx(0.125)
    standard = {r.w: r.logp for r in lm.logprob(asked.filter("w = 'a'"), grams, standard=True).collect()}
    assert math.exp(standard["a"]) == pytest.approx(1 / 6)


def test_hit_rate_and_greedy_matches(spark):
    gold = spark.createDataFrame([(1, 100), (1, 200)], "c int, g long")
    pred = spark.createDataFrame([(1, 120), (1, 221)], "c int, p long")
    assert tuple(joins.hit_rate(gold, pred, "c", 20).first()) == (2, 1, 0.5)
    assert tuple(joins.hit_rate(gold.filter("g < 0"), pred, "c", 20).first()) == (0, 0, 1.0)
    pred = spark.createDataFrame([(1, 10, "x"), (1, 12, "y")], "c int, p long, p_kind string")
    gold = spark.createDataFrame([(1, 11, "g")], "c int, g long, g_kind string")
    assert [r.p for r in joins.greedy_matches(pred, gold, "c", 20).collect()] == [10]


def test_overlap(spark):
    words = spark.createDataFrame([(1, 1, 1.0, 1.25)], "c int, w_id int, w_start double, w_end double")
    spans = spark.createDataFrame([(1, 1, 1.125, 2.0), (1, 2, 1.21, 9.0)], "c int, s_id int, s_start double, s_end double")
    assert [(r.s_id, r.overlap) for r in joins.overlapping(words, spans, "c").collect()] == [(1, 0.125)]


def test_text_functions(spark):
    toks = lambda s: F.split(F.lit(s), " ")
    assert one(spark, tx.drop_repeats(toks("a a b a"))) == ["a", "b", "a"]
    assert one(spark, tx.most_repeated(toks("x y x x"))) == 3
    assert one(spark, tx.collapse_token_runs(toks("x x x x x"))) == ["x", "x"]
    assert one(spark, tx.collapse_token_runs(toks("x x x x"))) == ["x"] * 4
    assert one(spark, tx.collapse_repeats(F.lit("aaaaaaaaab"))) == "aaab"
    assert one(spark, tx.collapse_repeats(F.lit("go go go go go now"))) == "go go now"
    assert one(spark, tx.collapse_repeats(F.lit("je-je-je-je-je"))) == "je-je-je"
    assert one(spark, tx.language_tag(F.lit("हाँ ok"))) == "hin_Deva"
    assert one(spark, tx.sentences(F.lit("One. Two!\nthree"))) == ["One.", "Two!", "three"]
    assert one(spark, tx.spoken_chunks(F.lit("One. Two! three"), 6)) == ["One. Two!", "three"]
    assert one(spark, tx.restore_terms(F.lit("a ⟦T0⟧ b"), F.create_map(F.lit("⟦T0⟧"), F.lit("x")))) == "a x b"


def test_compression(spark):
    df = spark.createDataFrame([("हाँ " * 50,), ("a b c",), ("",)], "t string").select(kernels.compression_ratio("t").alias("r"))
    long, short, empty = [r.r for r in df.collect()]
    assert long > 2.4 and short < 1 and empty == 1.0


@pytest.mark.parametrize(("word", "ipa"), [("see", "sɪː"), ("day", "dɛɪ"), ("chat", "tʃæt"), ("oxen", "ɒksɛn"), ("stochastic", "stəˈkæstɪk")])
def test_english_phonemes(spark, word, ipa):
    assert one(spark, ph.english(F.lit(word))) == ipa


@pytest.mark.parametrize(("word", "ipa"), [("नमस्ते", "nəməst̪eː"), ("घर", "gʱəɾ"), ("है", "ɦɛː"), ("हिंदी", "ɦɪ̃d̪iː")])
def test_devanagari_phonemes(spark, word, ipa):
    assert one(spark, ph.devanagari(F.lit(word))) == ipa


def test_routing(spark):
    got = [one(spark, ph.route(F.lit(w))) for w in ("kya", "हाँ", "model", "aहाँ")]
    assert got == ["hi-roman", "hi", "en", "hi"]
    assert one(spark, ph.roman_hindi(F.lit("kya"))) == "kjə"


def test_switch_marks(spark):
    lines = spark.createDataFrame([(2, "नमस्ते दोस्तों, today we study the cepstrum और viterbi.")], "id int, text string")
    rows = {r.id: r for r in text_queries.switch_marked(lines).collect()}
    assert rows[2].boundaries == "3,9,11"  # tokens 3, 8 and 9, each behind the marks before it
    assert rows[2].ipa.split().count("|") == 3


def test_distances():
    assert kernels.edit_distance("a b c d".split(), "a x c".split()) == 2
    assert kernels.edit_distance([], ["a"]) == 1
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0], table[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert kernels.edit_distance(a, b) == table[-1, -1]
    x = rng.normal(size=(30, 4))
    assert kernels.cepstral_distance(x, x) == 0.0
    assert kernels.MCD_SCALE == pytest.approx(6.141851463713754)
    assert kernels.warp_path(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2])) == [(0, 0), (0, 1), (1, 2), (2, 3)]


def test_cepstra():
    weights = kernels.triangles(40, 512, 16000)
    assert weights.shape == (40, 257) and (weights.max(axis=1) > 0).all() and weights.max() <= 1.0
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    assert kernels.power_frames(tone)[5].argmax() == 32
    assert kernels.linear_cepstra(tone).shape == (101, 20)
    eye = kernels.cosine_transform(np.eye(6), 6)
    assert np.allclose(eye @ eye.T, np.eye(6))


def test_signal_levels(spark):
    frames = series(spark, ["a"] * 4)
    peak = signal.peak_normalised(frames).agg(F.max("value")).first()[0]
    assert peak == pytest.approx(10 ** (-3 / 20))
    sweep = {r.epsilon: r.snr_db for r in signal.snr_sweep(series(spark, ["a"] * 100), [0.01, 0.5]).collect()}
    assert sweep[0.01] == pytest.approx(40.0, abs=0.01) and sweep[0.5] == pytest.approx(6.02, abs=0.01)
    joined = signal.joined_chunks(frames.withColumn("value", F.lit(1.0)), frames.withColumn("value", F.lit(1.0)), 2)
    assert joined.count() == 6 and all(r.value == pytest.approx(1.0) for r in joined.collect())


def test_vectors(spark):
    assert one(spark, vec.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert one(spark, vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None
    assert one(spark, vec.arg_max(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert sum(one(spark, vec.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1.0)
    assert one(spark, vec.fixed_length(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]


def test_samples(spark):
    rows = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), F.floor(F.col("id") / 10).alias("g"))
    got = sampling.balanced(rows, "y", "id").groupBy("y").count().collect()
    assert {r["count"] for r in got} == {25}
    parts = sampling.grouped_split(rows, "g").groupBy("g").agg(F.countDistinct("part").alias("n")).collect()
    assert all(r.n == 1 for r in parts)


def test_error_rates_of_equal_texts(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["b"])], "r array<string>, h array<string>")
    assert tuple(ev.word_error_rate(df, "r", "h").first()) == (1, 3, pytest.approx(1 / 3))
    assert math.isnan(ev.word_error_rate(df.limit(0), "r", "h").first().wer)


def test_model_slot_and_cache(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "sentence string")
    cache = spark.createDataFrame([("a", "cached")], "sentence string, translation string")
    done, whole = models.translated(asked, cache, lambda: lambda texts: [t.upper() for t in texts])
    assert sorted((r.sentence, r.translation) for r in done.collect()) == [("a", "cached"), ("a", "cached"), ("b", "B")]
    assert whole.count() == 2


def test_audio_and_transcripts(spark, tmp_path):
    tone = np.sin(np.arange(1600) / 10).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(audio.encode(tone, 16000))
    row = audio.read_wav(spark, str(tmp_path)).first()
    assert row.rate == 16000 and np.allclose(row.samples, tone, atol=1e-4)
    assert audio.decode(audio.as_wav(audio.read_wav(spark, str(tmp_path), 0.05)).first().content)[1].shape == (800,)
    (tmp_path / "t.json").write_text('{"language": "hi", "segments": [{"start": 0, "end": 1, "text": "a", "words": [{"w": "a", "s": 0.1, "e": 0.2}]}, {"text": "b"}]}')
    found = tr.read_transcripts(spark, str(tmp_path / "t.json"))
    assert found.select(tr.plain_text(F.col("segments"))).first()[0] == "a b"
    assert tr.words(found, "language").first().p is None
    assert tr.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "t.json")) == str(tmp_path / "t.json")


def test_result_does_not_depend_on_partitions(spark):
    frames = series(spark, list("aabbbacc")).repartition(3)
    assert sorted(map(tuple, fr.runs(frames).collect())) == sorted(map(tuple, fr.runs(frames.coalesce(1)).collect()))


def test_streamed_run_lengths(spark, tmp_path):
    from vocalake.streaming import frames as sf

    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(id) AS ts, 1L AS user_id, substr('aabbbc', CAST(id AS INT) + 1, 1) AS event_type FROM range(6)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = sf.run_lengths(sf.with_time(stream)).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.label, r.n) for r in spark.table("runs").collect()] == [("a", 2), ("b", 3)]


def test_confusion_matches_all_transitions(spark, tmp_path):
    """Three clips against a plain walk: each prediction in time order takes the nearest free gold frame, the earliest of equals."""
    rng = np.random.default_rng(3)
    rows = [(u * 100 + k, u, k, str(rng.choice(["click", "error", "view"])), 1.0) for u in range(3) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string, value double")
    events.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u in range(3):
        labels = [r[3] for r in rows if r[1] == u]
        gold = [(k, f"{labels[k - 1]}>{labels[k]}") for k in range(1, 60) if labels[k - 1] != labels[k]]
        used = set()
        for p, kind in [(k + 1, kind) for k, kind in gold]:
            near = sorted((abs(g - p), g, other) for g, other in gold if abs(g - p) <= 3 and g not in used)
            if near:
                used.add(near[0][1])
                want[kind, near[0][2]] = want.get((kind, near[0][2]), 0) + 1
    got = {(r.pred_kind, r.gold_kind): r.n for r in metric_queries.confusion(spark, str(tmp_path)).collect() if r.n}
    assert got == want


def test_clean_segments_drop_repeated_phrases(spark, tmp_path):
    """Six times a phrase passes the test of single tokens, not that of compression."""
    phrase = "stochastic gradients wander through noisy valleys before settling somewhere quiet. "
    texts = [phrase, phrase * 6, "a b " * 7, "", None]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = text_queries.clean_segments(spark, str(tmp_path)).collect()
    assert [(r.turn, r.text) for r in kept] == [(0, phrase.strip())]


# ---------------------------------------------------------------- text against plain Python

END = "।!?."


def py_sentences(text, longest=200):
    out, buf = [], ""
    for piece in re.findall(rf"[{END}]+|\n+|[^{END}\n]+", text):
        buf += piece
        if buf[-1] in END or len(buf) > longest:
            out.append(buf.strip())
            buf = ""
    return [s for s in [*out, buf.strip()] if s]


def py_chunks(text, most, strip):
    out, buf = [], ""
    for piece in re.findall(rf"[{END}]+|[^{END}]+", text):
        buf += piece
        if len(buf) >= most and (buf.strip() if strip else buf)[-1:] in tuple(END):
            out.append(buf.strip())
            buf = ""
    return [s for s in [*out, buf.strip()] if s]


def py_short(text, most):
    out = []
    for c in py_chunks(text, most, True):
        while len(c) > most:
            cut = c.rfind(" ", 0, most)
            cut = cut if cut > 0 else most
            out.append(c[:cut].strip())
            c = c[cut:].strip()
        out.append(c)
    return [c for c in out if c]


def test_sentences_and_chunks(spark):
    rng = random.Random(4)
    texts = ["", " ", "a", "...", "x" * 500, "a b " * 200, "no end\n\nat all", "a.   !! b", "word " * 27 + "end.   !! more words here and there. " * 9]
    texts += ["".join(rng.choice(["a", "bc", " ", "  ", ".", "?!", "\n", "।", "word ", "longerword "]) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    got = rows.select("k", tx.sentences(t, 20).alias("a"), tx.spoken_chunks(t, 30).alias("b"), tx.short_chunks(t, 30).alias("c")).collect()
    for r in got:
        assert r.a == py_sentences(texts[r.k], 20), texts[r.k]
        assert r.b == py_chunks(texts[r.k], 30, False), texts[r.k]
        assert r.c == py_short(texts[r.k], 30), texts[r.k]
    long = spark.createDataFrame([("One sentence. " * 100_000,)], "t string").select(F.size(tx.sentences(t)).alias("n")).first()
    assert long.n == 100_000


def py_collapse(tokens, run=5, longest=10, keep=2):
    out = []
    for _, own in itertools.groupby(tokens):
        own = list(own)
        out += own[:keep] if len(own) >= run and len(own[0]) <= longest else own
    return out


def test_token_runs(spark):
    rng = random.Random(6)
    lists = [[], ["a"] * 5, ["abcdefghijk"] * 9, ["a"] * 4, ["a", "a$1", "a"]] + [[rng.choice(["a", "aa", "ab", "b", "é"]) for _ in range(rng.randint(1, 40)) for _ in range(rng.choice([1, 1, 6]))] for _ in range(100)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "k int, t array<string>")
    for r in rows.select("k", tx.collapse_token_runs(F.col("t")).alias("c")).collect():
        assert r.c == py_collapse(lists[r.k])


def test_terms(spark):
    terms = [(f"w{k}", f"g{k}") for k in range(60)] + [("multi word", "M"), ("c++", "C"), ("", "never"), ("घर", "house")]
    texts = ["W1 and w1, multi  word; Multi Word w59x xw59 w5", "c++ C++ c+ घर मेराघर", "", " ".join(f"w{k}" for k in range(60))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", tx.protect_terms(F.col("t"), terms))
    got = [r for r in rows.select("k", "p.*", tx.restore_terms(F.col("p.masked"), F.col("p.glosses")).alias("back")).orderBy("k").collect()]
    assert got[0].masked == "⟦T1⟧ and ⟦T1⟧, multi  word; ⟦T0⟧ ⟦T2⟧9x xw59 ⟦T2⟧" and got[0].back == "g1 and g1, multi  word; M g59x xw59 g5"
    assert got[1].masked == "⟦T0⟧ ⟦T0⟧ c+ ⟦T1⟧ मेराघर"
    assert got[2].masked == "" and got[2].glosses == {}
    assert len(got[3].glosses) == 51 and len(re.findall(r"w\d+", got[3].masked)) == 9


def test_normal_form_of_devanagari(spark):
    words = ["ज़रा", "ज़रा", "फ़र्क", "क़लम", "पढ़ना", "ऩ", "ऩ", "ऱा", "य़"]
    got = [r.ipa for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(ph.devanagari(F.col("w")).alias("ipa")).collect()]

    def spoken(word):
        out, text, i = "", unicodedata.normalize("NFC", word), 0
        while i < len(text):
            after = text[i + 1 : i + 2]
            if text[i] in ph.CONSONANTS:
                out += ph.CONSONANTS[text[i]] + ("" if after == ph.NO_VOWEL else ph.SIGNS.get(after, "ə"))
                i += after == ph.NO_VOWEL or after in ph.SIGNS
            else:
                out += {**ph.VOWELS, **ph.SIGNS}.get(text[i], "")
            i += 1
        return out.removesuffix("ə")

    assert got == [spoken(w) for w in words] and got[0] == got[1] == "dʒəɾaː"


# ---------------------------------------------------------------- reports, sets and features


def test_saved_model(spark, tmp_path):
    grams = lm.counts(spark.createDataFrame([("a b a",), ("b",), ("",)], "line string"))
    lm.save(grams, str(tmp_path / "m"))
    assert sorted(map(tuple, lm.load(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, grams.collect()))
    of_counts = {(r.n, r.cnt): r.n_grams for r in lm.counts_of_counts(spark.createDataFrame([("a b a",), ("b",), ("",)], "line string")).collect()}
    want = grams.groupBy("n", "cnt").count().collect()
    assert of_counts == {(r.n, r.cnt): r["count"] for r in want}


def test_equal_error_rate_against_all_thresholds(spark):
    rng = random.Random(3)
    for case in range(8):
        values = [0.5] if case == 0 else [round(rng.random(), 1 if case % 2 else 3) for _ in range(12)]
        rows = [(k, rng.choice(values), rng.randint(0, 1)) for k in range(40)] + [(100, 0.1, 1), (101, 0.9, 0)]
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        whole, none = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
        best, tp, fp = None, 0, 0
        for k, s, y in order:
            tp, fp = tp + y, fp + 1 - y
            now = (abs((whole - tp) * none - fp * whole), -s, k, (1 - tp / whole + fp / none) / 2)
            best = min(best, now) if best else now
        got = ev.equal_error_rate(spark.createDataFrame(rows, "k int, s double, y int"), "s", "y", "k").first()
        assert (got.eer, got.threshold) == (pytest.approx(best[3]), -best[1])
    assert math.isnan(ev.equal_error_rate(spark.createDataFrame([(1, 0.5, 1)], "k int, s double, y int"), "s", "y", "k").first().eer)


def test_span_errors(spark):
    words = lambda text, late=0.0: spark.createDataFrame([(1, k, w, k * 1.0 + late, k + 0.9 + late) for k, w in enumerate(text.split())], "c int, w_id int, w string, w_start double, w_end double")
    spans = spark.createDataFrame([(1, 0, 0.0, 2.0, "eng"), (1, 1, 2.0, 4.0, "hin"), (1, 2, 9.0, 9.5, "eng")], "c int, s_id int, s_start double, s_end double, label string")
    got = {r.label: r for r in ev.span_errors(words("a b c d"), words("a x c", 0.0), spans, "c").collect()}
    assert (got["eng"].errors, got["eng"].words, got["eng"].n_spans) == (1, 2, 1) and got["eng"].wer == 0.5
    assert (got["hin"].errors, got["hin"].words) == (1, 2)


def test_reports(spark):
    report = lambda **v: spark.createDataFrame(list(v.items()), "name string, value double")
    both = {r.name: (r.before, r.after, r.delta) for r in ev.deltas(report(a=1.0, b=2.0), report(b=2.5, c=1.0)).collect()}
    assert both == {"a": (1.0, None, None), "b": (2.0, 2.5, 0.5), "c": (None, 1.0, None)}
    limits = spark.createDataFrame([("a", 2.0), ("d", 1.0)], "name string, limit double")
    assert {r.name: r.passed for r in ev.summary(report(a=1.0, b=2.0), limits).collect()} == {"a": True, "b": None, "d": False}


def test_balanced_is_the_first_in_hash_order(spark):
    rows = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(500)], "k int, y int")
    for digits in (1, 4):
        got = sorted(r.k for r in sampling.balanced(rows, "y", "k", 2, digits).collect())
        key = lambda k: __import__("hashlib").md5(f"2:{k}".encode()).hexdigest()
        want = [k for y in (0, 1) for k in sorted((k for k in range(500) if int(k % 5 == 0) == y), key=lambda k: (key(k), k))[:100]]
        assert got == sorted(want)


def test_interleaved_sets(spark):
    chunks = [(1, "a", k, 3, "eng") for k in range(4)] + [(1, "b", k, 5, "hin") for k in range(4)] + [(2, "b", 0, 2, "hin")]
    rows = spark.createDataFrame(chunks, "set long, kind string, ord long, n_frames long, label string")
    got = sampling.interleaved(rows, 5, 0.2, 2)
    labels = {s: [r.label for r in got.filter(f"set = {s}").orderBy("frame").collect()] for s in (1, 2)}
    assert labels[2] == ["hin", "hin", "sil", "sil"]
    counts = {x: labels[1].count(x) for x in set(labels[1])}
    assert counts == {"eng": 12, "hin": 20, "sil": 16} and labels[1][0] == "eng"
    assert labels[1] == [r.label for r in sampling.interleaved(rows.repartition(3), 5, 0.2, 2).filter("set = 1").orderBy("frame").collect()]


def test_edges_of_deltas(spark):
    frames = spark.createDataFrame([(1, k, "x", 3.0 * k + 0.5 * k * k) for k in range(20)] + [(2, k, "x", 1.0) for k in range(8)], "clip_id long, frame long, label string, value double")
    got = fr.padded_deltas(frames).orderBy("frame").collect()
    assert len(got) == 20 and all(r.delta2 == pytest.approx(1.0) for r in got)
    assert [r.delta for r in got] == pytest.approx([3.0 + min(max(k, 4), 15) for k in range(20)])
    both = kernels.with_slopes(np.array([[3.0 * k + 0.5 * k * k] for k in range(20)]))
    slopes = np.array([r.delta for r in got])
    assert both[:, 1] == pytest.approx((slopes - slopes.mean()) / (slopes.std() + 1e-6))


def test_rescaled_path(spark):
    path = spark.createDataFrame([(1, k, k, k) for k in range(5)], "clip_id long, step long, i long, j long")
    got = fr.rescaled_path(path, spark.createDataFrame([(1, 25, 5)], "clip_id long, n long, m long"), 10).orderBy("step").collect()
    assert [(r.i, r.j) for r in got] == [(round(k * 2.5), round(k * 0.5)) for k in range(5)]


def test_features(spark):
    rate = 16000
    tone = np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)
    levels = kernels.log_mel(tone, rate)
    assert levels.shape == (101, 80) and levels.max() == 0.0 and levels.min() >= -80
    centre = np.argmax(kernels.mel_triangles(80, 512, rate)[int(np.argmax(levels[50]))]) * rate / 512
    assert abs(centre - 1000) < 50
    clips = spark.createDataFrame([("a", rate, tone.tolist()), ("b", rate, [0.0] * 100)], "path string, rate int, samples array<double>")
    for kind, n in (("mel", 119), ("linear", 60)):
        got = signal.features(clips, kind).groupBy("path").agg(F.countDistinct("dim").alias("d"), F.countDistinct("frame").alias("f")).collect()
        assert [(r.path, r.d, r.f) for r in got] == [("a", n, 101)]


def test_warp_of_long_series():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=60), rng.normal(size=45)
    cost = np.abs(x[:, None] - y)
    total = np.full((61, 46), np.inf)
    total[0, 0] = 0
    for i in range(1, 61):
        for j in range(1, 46):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    path = kernels.warp_path(x, y)
    assert sum(cost[i, j] for i, j in path) == pytest.approx(total[60, 45]) and path[0] == (0, 0) and path[-1] == (59, 44)


def test_sources_and_sinks(spark, tmp_path):
    tr.write_lines(spark.createDataFrame([("a",), ("  ",), ("b c",)], "t string"), "t", str(tmp_path / "l"))
    assert sorted(r.value for r in tr.read_lines(spark, str(tmp_path / "l")).collect()) == ["a", "b c"]
    tr.write_json(spark.createDataFrame([("en", [(0.0, 1.0, "hi")])], "language string, segments array<struct<start: double, end: double, text: string>>"), str(tmp_path / "j"))
    back = tr.read_transcripts(spark, str(tmp_path / "j")).first()
    assert back.language == "en" and back.segments[0].text == "hi" and back.segments[0].avg_logprob is None
    (tmp_path / "d.json").write_text('{"language": "mai", "entries": {"Word": "G", "two words": "H"}}')
    assert sorted(map(tuple, tr.read_dictionary(spark, str(tmp_path / "d.json")).collect())) == [("two words", "H"), ("word", "G")]
    terms = spark.createDataFrame([("aa",), ("bbb",), ("ab",), ("c",)], "t string")
    assert [r.t for r in sampling.longest_first(terms, "t", 3).collect()] == ["bbb", "aa", "ab"]


def test_best_candidates(spark):
    rows = spark.createDataFrame([(1, 0, -1.0, -1.0), (1, 1, -0.5, -1.5), (1, 2, -9.0, 0.0), (2, 0, 0.0, 0.0)], "seg int, ord int, a double, l double")
    assert [(r.seg, r.ord) for r in models.rescored_candidates(rows, "seg", "a", "l").orderBy("seg").collect()] == [(1, 0), (2, 0)]


def test_fallbacks_of_models(spark):
    def missing():
        raise ImportError("none")

    rows = spark.createDataFrame([(1, [3.0, 3.0]), (2, [])], "k int, v array<double>")
    got = models.apply_model(rows, "embed", models.loaded_or(missing, models.pooled_vectors), "v", "e").orderBy("k").collect()
    assert got[0].e == pytest.approx([1.0, 0.0]) and got[1].e == [0.0, 0.0]
    assert models.loaded_or(lambda: len, models.pooled_vectors)()("abc") == 3


def test_spectral_denoise():
    rng = np.random.default_rng(5)
    noise = 0.1 * rng.normal(size=16000)
    tone = np.where(np.arange(16000) > 4000, np.sin(2 * np.pi * 440 * np.arange(16000) / 16000), 0.0)
    clean = kernels.spectral_denoise(noise + tone)
    assert len(clean) == 16000 and np.mean(clean[:3000] ** 2) < 0.1 * np.mean(noise[:3000] ** 2)
    assert np.mean((clean[5000:15000] - tone[5000:15000]) ** 2) < np.mean(noise[5000:15000] ** 2)
    assert kernels.spectral_denoise(noise, alpha=0.0, beta=0.0) == pytest.approx(noise, abs=1e-6)


def _tone(hertz, rate, n):
    return np.sin(2 * np.pi * hertz * np.arange(n) / rate)


@pytest.mark.parametrize(("rate", "to"), [(44100, 16000), (16000, 22050), (8000, 16000), (16000, 16000)])
def test_resampled_tones(rate, to):
    got = kernels.resampled(_tone(1000, rate, rate), rate, to)
    assert len(got) == to and np.abs(got - _tone(1000, to, to))[200:-200].max() < 5e-3
    if to < rate:  # what the new rate cannot hold goes
        assert np.abs(kernels.resampled(_tone(12000, rate, rate), rate, to))[200:-200].max() < 5e-3
    assert len(kernels.resampled(np.zeros(0), rate, to)) == 0


@pytest.mark.parametrize("hertz", [80.0, 220.0, 987.8])
def test_pitch_of_tones(spark, hertz):
    both = np.r_[_tone(hertz, 22050, 22050), np.zeros(8192)]
    f0, level = kernels.pitch_track(both)
    assert len(f0) == len(level) == 1 + len(both) // 256
    assert np.abs(f0[4:80] - hertz).max() < 0.01 * hertz and (f0[-20:] == 0).all()
    clips = spark.createDataFrame([("a", 22050, both.tolist()), ("b", 22050, [])], "path string, rate int, samples array<double>")
    rows = signal.pitches(clips).orderBy("frame").collect()
    assert [r.path for r in rows] == ["a"] * len(f0) and [r.hertz for r in rows] == f0.tolist()


def test_constant_q(spark):
    for k in (12, 40, 83):
        found = kernels.constant_q(_tone(32.7032 * 2 ** (k / 12), 16000, 16000))
        assert found.shape == (63, 84) and found[31].argmax() == k and found[31, k] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError):
        kernels.constant_q(np.zeros(4000), 4000)
    clips = spark.createDataFrame([("a", 16000, _tone(440, 16000, 16000).tolist()), ("b", 16000, [0.0] * 2000)], "path string, rate int, samples array<double>")
    got = signal.features(clips, "constant_q").groupBy("path").agg(F.countDistinct("dim").alias("d"), F.countDistinct("frame").alias("f")).collect()
    assert [(r.path, r.d, r.f) for r in got] == [("a", 60, 63)]


def test_waveform_of_a_mel_spectrum(spark):
    chord = 0.3 * (_tone(440, 16000, 16000) + _tone(1320, 16000, 16000))
    power = kernels.power_frames(chord) @ kernels.mel_triangles().T
    made = kernels.waveform(power)
    again = kernels.power_frames(made) @ kernels.mel_triangles().T
    assert len(made) == 16000 and np.linalg.norm(np.sqrt(again) - np.sqrt(power)) < 0.25 * np.linalg.norm(np.sqrt(power))
    assert np.array_equal(made, kernels.waveform(power)) and len(kernels.waveform(np.zeros((0, 80)))) == 0
    rows = spark.createDataFrame([("a", 16000, power.tolist())], "path string, rate int, power array<array<double>>")
    assert signal.waveforms(rows).first().samples == pytest.approx(made.astype(np.float32).tolist())


def test_wav_at_another_rate(spark):
    rows = spark.createDataFrame([("a", 44100, _tone(500, 44100, 44100).tolist())], "path string, rate int, samples array<double>")
    got = audio.from_wav(audio.as_wav(rows), to=16000).first()
    assert got.rate == 16000 and np.abs(np.array(got.samples) - _tone(500, 16000, 16000))[200:-200].max() < 1e-2


def test_snr_sweep_sums_by_frame(spark):
    """F1: by frame the mean is one bit above a value of 5.76, whose sign then flips; backwards it is that value."""
    values = [6.98, 9.37, 5.82, 0.87, 5.76]
    for order in (1, -1):
        rows = [(1, k, "a", v) for k, v in enumerate(values)][::order]
        frames = spark.createDataFrame(rows, "clip_id long, frame long, label string, value double").coalesce(1)
        got = signal.snr_sweep(frames, [0.01]).first()
        assert got.flipped == 0.2 and got.snr_db == pytest.approx(40, abs=1e-4)


def test_warp_path_holds_a_block_of_steps(spark, monkeypatch):
    """the steps of a long pair aren't held as one table, with the same path; a batch of pairs is cut by its bytes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, 90).astype(float), rng.integers(0, 5, 70).astype(float)
    whole = kernels.warp_path(x, y)
    monkeypatch.setattr(kernels, "STEPS", 0)
    assert kernels.warp_path(x, y) == whole
    tracemalloc.start()
    kernels.warp_path(rng.random(3000), rng.random(3000))
    assert tracemalloc.get_traced_memory()[1] < 6_000_000
    tracemalloc.stop()
    pairs = spark.createDataFrame([(k, [[0.0, 1.0], [1.0, 1.0]], [[0.0, 1.0]] if k else []) for k in range(3)], "clip_id long, a array<array<double>>, b array<array<double>>")
    got = {r.clip_id: r.mcd for r in signal.cepstral_distances(pairs, "clip_id").collect()}
    assert math.isnan(got[0]) and got[1] == got[2] == pytest.approx(kernels.MCD_SCALE / 2)
