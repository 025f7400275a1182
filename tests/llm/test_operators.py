"""The operators against brute-force versions on small rows, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocalake.llm import chat, common, line_dedup, mixing, neighbours, pieces, pii, quality_model, quality_rules, shingles, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, txt string, words string, bad string, size string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    """Rows with more columns, whose names the operators use themselves."""
    rows = [(k, t, "en", sources[k] if sources else "s", 0, "r", "x", "w", "b", "z", "c") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "the", "of", "and", "x1", "zeta!"]
    out = [None, "", "   \n\t ", "one", "a b", "a b c", "é ü 日本 🙂"]
    for _ in range(40):
        out.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))))
    return [*out, out[10], out[11], "long " * 20000]


# ---------------------------------------------------------------- quality rules


def test_quality_rules(spark, texts):
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts)).select("row.doc_id", "*").drop("row").collect()}
    for k, text in enumerate(texts):
        w = WORD.findall(text or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_rules_compile_to_names(spark):
    text = ("the # $ % and of " * 20).strip()
    rules = (quality_rules.Rule("symbols", "symbol_ratio", most=0.1), quality_rules.Rule("length", "mean_word_chars", least=9))
    assert quality_rules.judge(docs(spark, [text]), rules=rules).first().failed == ["symbols", "length"]
    with pytest.raises(ValueError, match="no bound"):
        quality_rules.compile_rules((quality_rules.Rule("empty", "n_words"),))


# ---------------------------------------------------------------- line dedup


def test_line_dedup(spark):
    body = [f"own line {k}\n  footer  \n\nshared {k % 2}" for k in range(20)] + [None, "", "footer", "footer"]
    sources = ["a"] * 12 + ["b"] * 8 + [None, "a", None, "a"]
    rows = docs(spark, body, sources)
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(rows, min_pages=3, ratio=0.4).collect()}
    assert line_dedup.drop_boilerplate(rows).columns == rows.columns
    pages, holding = Counter(sources), Counter()
    for t, s in zip(body, sources, strict=True):
        for line in {x.strip() for x in (t or "").split("\n") if x.strip()}:
            holding[s, line] += 1
    for k, (t, s) in enumerate(zip(body, sources, strict=True)):
        want = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or not (holding[s, x.strip()] >= 3 and holding[s, x.strip()] > 0.4 * pages[s]))
        assert got[k] == want
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


def test_line_dedup_joins_large_tables_by_shuffle(spark, monkeypatch):
    rows = docs(spark, [f"line {k}\nfooter" for k in range(30)])
    broadcast = line_dedup.drop_boilerplate(rows).select("doc_id", "text").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(line_dedup.drop_boilerplate(rows).select("doc_id", "text").collect()) == sorted(broadcast)


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, texts):
    got = {r.key: r.w0 % 2**64 for r in simhash.fingerprints(docs(spark, texts), "doc_id", "text", simhash.Plan()).collect()}
    assert got == {k: brute_fingerprint(t, 3) for k, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 63), min_size=0, max_size=4, unique=True), st.integers(0, 2**64 - 1))
def test_masks_cover(radius, flips, value):
    flips = flips[:radius]
    other = value
    for b in flips:
        other ^= 1 << b
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert any(value & m == other & m for m in masks)


def test_parts_and_refined_masks_cover():
    plan, rng = simhash.Plan(radius=11, parts=2), random.Random(1)
    masks = [m for m, _ in simhash.first_masks(plan)]
    fine = [m for m, _ in simhash.refined_masks(simhash.refined_masks(simhash.first_masks(simhash.Plan()), 2), 2)]
    for _ in range(300):
        wide, near = (sum(1 << b for b in rng.sample(range(64), n)) for n in (11, 2))
        assert any(not wide & m for m in masks)
        assert any(not near & m for m in fine)


def union(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_reach_what_is_near(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(8)}
    prints |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(simhash._signed(p), 0) for p in prints], "w0 long, w1 long")
    found = simhash.links(rows, simhash.Plan(), bucket).collect()
    at = {p: k for k, p in enumerate(prints)}
    got = union(len(prints), [(at[r.a0 % 2**64], at[r.b0 % 2**64]) for r in found])
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert got == union(len(prints), near)
    assert all(((r.a0 ^ r.b0) % 2**64).bit_count() <= 2 for r in found)


@pytest.mark.parametrize("plain", [10**6, 0])
def test_connected(spark, monkeypatch, plain):
    monkeypatch.setattr(common, "PLAIN_LINKS", plain)
    rng = random.Random(8)
    pairs = [(0, k) for k in range(1, 40)] + [(50 + k, 51 + k) for k in range(30)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)]
    edges = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string")
    roots = union(200, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert {int(r.node): int(r.root) for r in common.connected(edges).collect()} == {x: roots[x] for x in touched}
    assert common.connected(edges.limit(0)).count() == 0


def test_components_and_keep_one(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(6)]
    near = [b.replace(b.split()[5], "other") for b in base[:3]]
    all_ = [*base, *near, base[4], None, "", "  "]
    rows = docs(spark, all_)
    got = {r.key: r for r in simhash.components(rows).collect()}
    prints = [brute_fingerprint(t, 3) for t in all_]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(all_)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert [got[k].component_id for k in range(len(all_))] == union(len(all_), pairs)
    assert [got[k].fingerprint for k in range(len(all_))] == [f"{p:016x}" for p in prints]
    kept = simhash.keep_one(rows.union(rows))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 10]
    assert simhash.components(docs(spark, [])).count() == 0
    no_key = simhash.keep_one(docs(spark, ["x", "x", "y"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r.text for r in no_key.collect()) == ["x", "y"]


def test_near_copies_link_from_a_similarity_of_exactly_0_8(spark):
    """Of 400 different words (396 shingles) 44 new last ones leave 352 of 440, which is 0.8; 45 leave 351 of 441."""
    rng, texts = random.Random(8), []
    for k in range(30):
        own = [f"w{k}x{i}" for i in range(400)]
        texts += [" ".join(own), " ".join([*own[:356], *(f"n{k}x{i}" for i in range(44))]), " ".join([*(f"m{k}x{i}" for i in range(45)), *own[45:]])]
    texts += [" ".join(rng.choices(texts[0].split(), k=400)), texts[3].upper(), None, " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(union(len(texts), near)))
    assert len(near) == 30 + 1 + 1 + 1


def splitmix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def test_near_copies_meet_by_covering_masks_of_their_fingerprints(spark):
    """What _bands lets meet is what the masks of simhash let meet, by whole numbers in plain Python, and is near in 128 bits."""
    rng, texts = random.Random(21), []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(300)]
        texts += [" ".join([*own[: 300 - cut], *(f"n{k}x{i}" for i in range(cut))]) for cut in (0, 3, 20, 60, 150)]
    texts += [" ".join(rng.choices(texts[0].split(), k=300)), "one two", None]
    sets = [shingles.shingle_set(t).tolist() for t in texts]
    prints = []
    for own in sets:
        words = [[splitmix((h + k * 0x9E3779B97F4A7C15) % 2**64) for h in own] for k in range(1, 25)]
        prints.append(sum(1 << 64 * k + b for k, word in enumerate(words) for b in range(64) if 2 * sum(x >> b & 1 for x in word) > len(own)))
    masks = [m for low in range(0, 1536, 24) for m in simhash.covering_masks(list(range(low, low + 24)), 1)]
    head = [p & (1 << 64) - 1 for p in prints], [p & (1 << 128) - 1 for p in prints]
    near = lambda i, j: (head[0][i] ^ head[0][j]).bit_count() <= 26 and (head[1][i] ^ head[1][j]).bit_count() <= 42
    pairs = [(i, j) for i, j in itertools.combinations([k for k, s in enumerate(sets) if s], 2) if near(i, j) and any(prints[i] & m == prints[j] & m for m in masks)]
    nodes = shingles._nodes(shingles.prints(docs(spark, texts), "doc_id", "text"))
    key = {r.id: r.least.key for r in nodes.collect()}
    met = defaultdict(list)
    for r in shingles._bands(nodes).collect():
        met[r.band].append(key[r.id])
    got = {p for own in met.values() for p in itertools.combinations(sorted(own), 2)}
    assert set(pairs) <= got and union(len(texts), pairs) == union(len(texts), got)
    assert {(5 * k, 5 * k + c) for k in range(12) for c in (1, 2)} <= got and not any(i // 5 != j // 5 for i, j in got if j < 60)


def test_short_texts_that_differ_in_one_shingle_of_five(spark):
    """Bits of four and five shingles differ more often than an angle says; 4 of 5 is 0.8, 3 of 4 is not."""
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k in range(400) for n in (9, 8)] + ["a b c d e f g h", "a b c d e f g"]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect())
    assert kept == [*range(0, 800, 2), 800, 801]


@pytest.mark.parametrize("within", [True, False])
def test_pairs_that_meet_in_buckets(within, monkeypatch):
    monkeypatch.setattr(shingles, "PAIRS", 7)
    rng = np.random.default_rng(4)
    band, at = rng.integers(0, 5, 60), np.repeat(np.arange(30), 2)
    first, root, n = rng.random(30) < 0.5, rng.integers(0, 8, 30), rng.integers(8, 12, 30)
    met = {(x, y) for b, x in zip(band, at, strict=True) for c, y in zip(band, at, strict=True) if b == c and x < y and (within or first[x] != first[y])}
    want = sorted((int(x), int(y)) for x, y in met if root[x] != root[y] and min(n[x], n[y]) >= 0.8 * max(n[x], n[y]))
    got = [(k, int(y)) for k, others in shingles._met_pairs(band, at, first, root, n, within, 0.8) for y in others]
    assert got == want


def test_short_texts_in_many_blocks(spark, monkeypatch):
    """Of 15 shingles one changes with the first word or the last and two with the last but one: a change of one word at an end
    leaves 14 of 16, which is a link, any other 13 of 17 or fewer."""
    monkeypatch.setattr(shingles, "NODES", 5)
    rng = random.Random(12)
    texts = [" ".join([rng.choice(["a", "b"]), *(f"w{i}" for i in range(16)), *rng.choices("cdefghijklmnop", k=2)]) for _ in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    got = {r.key: r.component_id for r in shingles.components(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == union(len(texts), near)
    assert 5 < len(set(union(len(texts), near))) < 55


def test_near_prints_count_all_bits():
    rng = np.random.default_rng(5)
    one = np.r_[rng.integers(-(2**63), 2**63 - 1, shingles.LONGS), 9]
    others = np.repeat(one[None, :], 4, axis=0)
    for row, bits in enumerate((shingles.ALL, shingles.ALL + 1, 1536, 1536)):
        for b in range(1536 - bits, 1536):
            others[row, b // 64] ^= np.int64(-(2**63)) if b % 64 == 63 else np.int64(1 << b % 64)
    others[3, -1] = shingles.SHORT
    assert shingles.near_prints(one, others).tolist() == [True, False, False, True]


def test_sets_are_sent_only_of_texts_that_can_link(spark, monkeypatch):
    """A group of texts that meet at a similarity of about a half, in many blocks, and a link in it: only the linked are compared as sets,
    and no join makes more rows than the nodes have in their groups or in their pairs of blocks."""
    made, rows = [], {}
    monkeypatch.setattr(shingles, "NODES", 5)
    sets, kept = shingles._sets, shingles.materialised
    monkeypatch.setattr(shingles, "_sets", lambda docs, text, shingle, wanted: made.append(wanted.count()) or sets(docs, text, shingle, wanted))
    monkeypatch.setattr(shingles, "materialised", lambda df, tag: rows.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, tag))
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, *(f"x{k}y{i}" for i in range(100))]) for k in range(60)]
    texts.append(texts[7] + " end")
    got = {r.key: r.component_id for r in shingles.components(docs(spark, texts)).collect()}
    assert got == {k: 7 if k == 60 else k for k in range(61)}
    assert sum(made) == 2
    assert not any("Join Inner, ((band" in line and "block" in line for plans in rows.values() for plan in plans for line in plan.split("\n"))


# ---------------------------------------------------------------- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 0, 1000], [1, 1, 1], 1000) == [20, 0, 980]
    assert mixing.targets([], [], 0) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_permutation(n, key):
    got = mixing.permuted(np.arange(n), n, key)
    assert sorted(got.tolist()) == list(range(n))
    assert got[mixing.position(n - 1, n, key)] == n - 1


def test_shards_sum_to_the_quota():
    quota = np.array([1000, 0, 37, 5000])
    counts = [mixing.shard_counts(quota, k, 256, 3) for k in range(-(-int(quota.sum()) // 256))]
    assert (sum(c for c, _ in counts) == quota).all()
    assert all((b == sum((c for c, _ in counts[:k]), np.zeros(4, int))).all() for k, (_, b) in enumerate(counts))
    assert all(c.sum() == 256 for c, _ in counts[:-1])


@pytest.mark.parametrize("scale", [1, 10**6, 10**12])
def test_draws_without_replacement_at_any_size(scale):
    counts = np.array([5, 0, 3, 12]) * scale
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 7 * scale, 20 * scale - 1, 20 * scale):
        got = mixing.drawn(counts, n, rng)
        assert got.sum() == n and (got >= 0).all() and (got <= counts).all()
    many = np.array([mixing.drawn(counts, 7 * scale, rng) for _ in range(4000)]) / scale
    assert many.mean(axis=0) == pytest.approx([7 * 5 / 20, 0, 7 * 3 / 20, 7 * 12 / 20], abs=0.06)
    n, k, all_ = 7 * scale, 5 * scale, 20 * scale
    want = n * (k / all_) * (1 - k / all_) * (all_ - n) / (all_ - 1) / scale**2
    assert many[:, 0].var() == pytest.approx(want, rel=0.15)


def test_shards_of_very_many_slots():
    quota = np.array([4 * 10**10, 10**11, 7])
    total = -(-int(quota.sum()) // 16384)
    parts = [mixing.shard_counts(quota, k, 16384, 3) for k in (0, 1, total // 2, total - 1)]
    assert all(c.sum() == 16384 for c, _ in parts[:3]) and (parts[0][0] == parts[1][1]).all()
    assert (parts[3][0] + parts[3][1] == quota).all()


def test_equal_rows_are_taken_each_for_itself(spark):
    rows = docs(spark, [None] * 50 + ["a b c d e"] * 30 + [f"w{k} x" for k in range(40)], ["s"] * 120).withColumn("doc_id", F.when(F.col("doc_id") < 80, F.lit(None)).otherwise(F.col("doc_id")))
    found = mixing.taken(rows, block=4, slots=8).collect()
    assert len(found) == 120 and sum(r.taken for r in found) == round(1.5 * (150 + 80))
    starts = sorted((r.start, r.size) for r in found if r["size"])
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts))


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    body = [" ".join(f"w{k}_{i}" for i in range(rng.choice([0, 3, 40, 300, 2500]))) for k in range(120)] + [None, "", "a b", "a b"]
    sources = [rng.choice(["b", "a", "é", None, "a", "a"]) for _ in body]
    rows = docs(spark, body, sources)
    found = mixing.taken(rows, block=64, slots=32).collect()
    assert len(found) == len(body)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.taken(rows.repartition(3), block=64, slots=32).collect()))
    size = [len(WORD.findall(t or "")) for t in body]
    names = sorted({s for s in sources if s is not None}) + [None]
    totals = [sum(z for z, s in zip(size, sources, strict=True) if s == n) for n in names]
    want = dict(zip(names, mixing.targets(totals, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size)), strict=True))
    sums = defaultdict(int)
    for r in found:
        assert r.size == size[r.key] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        sums[r.source] += r.taken
    assert all(abs(sums[n] - want[n]) <= 1 for n in names)
    pieces_, _ = mixing.mix(rows, block=64, slots=32)
    per_slot = pieces_.groupBy("shard", "number", "block").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    assert per_slot.agg(F.max("n")).first()[0] <= 2 * 64
    mixed = mixing.mixed_documents(rows.dropDuplicates(["doc_id"]), block=64, slots=32).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set((body[r.doc_id]).split())
    assert words == Counter({r.key: r.taken for r in found if r.taken})
    assert mixing.taken(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- SentencePiece


def test_pieces_equal_the_library(spark, texts):
    own = pieces.codec(pieces.read_model())
    rng = random.Random(1)
    odd = ["".join(rng.choice("  \n\taeiothnsrléß日🙂.,()12▁İ\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    all_ = [t or "" for t in texts] + odd
    assert [r.tolist() for r in own.encode(all_)] == own.processor.encode(all_)
    assert [own.decode(i) for i in own.processor.encode(odd)] == own.processor.decode(own.processor.encode(odd))
    got = pieces.encoded(docs(spark, texts)).collect()
    assert all(r.lossless and r.n_tokens == len(r.token_ids) for r in got)
    back = pieces.decoded(pieces.encoded(docs(spark, texts))).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encoded(docs(spark, [])).count() == 0
    assert not pieces.encoded(docs(spark, ["a▁b"])).first().lossless
    with pytest.raises(ValueError, match="prefix"):
        pieces.encoded(docs(spark, ["a"]).withColumn("N_Tokens", F.lit(1)))


def test_pieces_in_small_batches_equal_the_library(spark, texts, monkeypatch):
    own, rng = pieces.codec(pieces.read_model()), random.Random(2)
    long = ["".join(rng.choices("abcdefgh", k=30_000)), " ".join("".join(rng.choices("aeioust", k=4)) for _ in range(60_000))]
    got = pieces.encoded(docs(spark, [*texts, *long])).collect()
    assert all(r.token_ids == own.processor.encode(r.text or "") and r.lossless for r in got)
    tokens, sizes = own.encode_all([t or "" for t in texts])
    assert own.decode_all(tokens, sizes) == [t or "" for t in texts]


def test_decoding_odd_ids(spark):
    own = pieces.codec(pieces.read_model())
    ids = own.processor.encode("some text")
    rows = spark.createDataFrame([(1, ids), (2, [ids[0], None, *ids[1:]]), (3, None), (4, []), (5, [-1, 10**6]), (5, [-1, 10**6]), (6, [None])], "k int, token_ids array<int>")
    got = [r.decoded for r in pieces.decoded(rows).orderBy("k").collect()]
    unknown = own.processor.decode([own.unk, own.unk])
    assert got == ["some text", "some text", "", "", *[unknown.removeprefix(" ")] * 2, ""]
    assert pieces.decoded(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="decoded"):
        pieces.decoded(rows.withColumn("Decoded", F.lit(1)))


def test_unigram_lattice_finds_the_best_sum():
    score = {"a": -3.0, "b": -3.1, "ab": -4.0, "ba": -2.5, "aba": -9.0, "bb": -5.9}
    lattice = pieces.Lattice({p: k for k, p in enumerate(score)}, score, merges=False)

    def best(word):
        if not word:
            return 0.0
        return max(best(word[n:]) + score[word[:n]] for n in range(1, len(word) + 1) if word[:n] in score)

    words = sorted("".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n))
    flat, sizes, strange = lattice.segment(words)
    at = 0
    for word, size in zip(words, sizes, strict=True):
        own = [lattice.names[k] for k in flat[at : at + size]]
        at += size
        assert "".join(own) == word and sum(score[p] for p in own) == pytest.approx(best(word))
    assert strange == []
    assert lattice.segment(["acb"])[2] == ["c"]


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "4", "9", ".", "-", " ", "+", "@", "a", "Z", "%", "(", ")", "🙂", "255.", "4111111111111111", "://"]), max_size=40).map("".join))
def test_base_spans(text):
    assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute_spans(text)


def test_added_spans_and_rows(spark):
    text = 'IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789, token = "2abc3ff2ca8fb1e4c565a0eb", https://bob:pw1@host.org/x me@x.org'
    assert [s[2] for s in pii.find(text)] == ["iban", "ssn", "secret", "url", "email", "email"]
    assert pii.redact(text, pii.find(text)).startswith("IBAN: [IBAN], SSN [SSN], token")
    rows = pii.scan(spark.createDataFrame([(1, "a@b.c +1 (212) 555-0100"), (2, None), (3, ""), (3, "")], "doc_id long, text string"), redacted=True).collect()
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.n_email, first.n_phone, first.spans, first.redacted) == (1, 1, "email:0:5,phone:6:23", "[EMAIL] [PHONE]")
    assert first.base_sha256 == hashlib.sha256(first.spans.encode()).hexdigest()
    assert [r.spans for r in rows if r.doc_id > 1] == ["", "", ""]
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- neighbours


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    keys = neighbours.hilbert_keys(cells, bits)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def _brute(vectors, ids, q, k):
    scores = vectors @ vectors[q]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]]
    return [int(ids[i]) for i in order[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    vectors[7] = vectors[9]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wide = neighbours.search(table, is_query=F.col("vec_id") % 20 == 0, k=5, curves=2, window=1.0, block=64).collect()
    got = defaultdict(list)
    for r in sorted(wide, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    ids = np.arange(400)
    assert dict(got) == {q: _brute(vectors.astype(float), ids, q, 5) for q in range(0, 400, 20)}
    few = neighbours.search(table.filter("vec_id < 3"), k=20).groupBy("query_id").count().collect()
    assert [r["count"] for r in few] == [2, 2, 2]
    assert neighbours.search(table.filter("vec_id >= 1000")).filter("query_id <> 1005").count() == 0


def test_neighbours_of_equal_vectors_are_the_smallest_keys(spark):
    """A third of the rows are equal, many more than a window holds."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-4, 5, size=(900, 8)).astype(np.float32)
    vectors[::3] = [3, -1, 2, 0, 4, -4, 1, 2]
    ids = rng.permutation(900)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")
    found = neighbours.search(table, is_query=F.col("vec_id") % 20 == 0, k=20, least_window=16).collect()
    got, at = defaultdict(list), {int(i): k for k, i in enumerate(ids)}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    equal = [q for q in range(0, 900, 20) if at[q] % 3 == 0]
    assert equal and all(got[q] == _brute(vectors.astype(float), ids, at[q], 20) for q in equal)


def test_neighbours_of_repeated_keys_and_ties(spark):
    """30 vectors of one key nearest to a query, scores equal beyond the last rank, repeated rows, columns of other names."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(7, [100.0 + k, 0.0, float(k % 3), 0.0]) for k in range(30)]
    rows += [(100 + int(i), [2.0, *rng.integers(-3, 4, 3).astype(float).tolist()]) for i in rng.permutation(60)] * 2
    rows += [(20, [1.0, 1.0, 0.0, 0.0]), (20, [3.0, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, embedding array<float>, place int, score double, v string")
    for least in (8, 1000):
        found = neighbours.search(table, is_query=F.col("vec_id") % 20 == 0, k=20, window=1.0, least_window=least, block=16, curves=2).collect()
        got = defaultdict(list)
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append((r.vec_id, r.score))
        best = defaultdict(lambda: -np.inf)
        for q, v in rows:
            for i, w in rows:
                if q % 20 == 0 and i != q:
                    best[q, i] = max(best[q, i], float(np.dot(v, w)))
        for q in {q for q, _ in rows if q % 20 == 0}:
            want = sorted(((i, s) for (a, i), s in best.items() if a == q), key=lambda x: (-x[1], x[0]))[:20]
            assert got[q] == want
        assert sorted(got) == sorted({q for q, _ in rows if q % 20 == 0})


def test_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet")
    found = neighbours.search(table, is_query=F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    data = table.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], dtype=float)
    at = {int(v): k for k, v in enumerate(ids)}
    hits = sum(len(set(r.v) & set(_brute(vectors, ids, at[r.query_id], 20))) for r in found)
    assert hits >= 0.9 * 20 * len(found)


# ---------------------------------------------------------------- WARC


def test_archives(spark):
    long = "é" * 9000
    rows = [(1, "u", long), (2, None, long), (3, "w\r\n", "a\r\n\r\nWARC/1.1\r\n"), (4, "x", None), (5, "y", ""), (5, "y", ""), (None, "n", "null id"), (None, "n", "null id"), (0, "z", long), (0, "z", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == warc.payload_digest(html[r.page_id])
        assert r.record_type == "revisit" or r.payload == html[r.page_id]
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "response", None)] * 2 + [(0, "response", None)] * 2 + [(1, "revisit", 0), (2, "revisit", 0), (3, "response", None), (4, "response", None), (5, "revisit", 4), (5, "revisit", 4)]
    assert Counter(r.record_type for r in warc.round_trip(pages, min_bytes=5).filter("page_id IN (4, 5)").collect()) == {"response": 3}
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(spark, folder, data):
    """Pages of a file with these bytes."""
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(data)
    return warc.read(spark, str(folder)).orderBy("page_id").collect()


def test_damaged_segments_are_noticed(spark, tmp_path):
    parts = list(warc.records(1, "u", b"x" * 9000, None, "k"))
    assert len(parts) > 2
    for k, (own, intact) in enumerate([(parts[::-1], True), (parts[:1] + parts[2:], False), (parts[:-1], False), (parts[1:], False), (parts + parts[1:2], False)]):
        assert [r.intact for r in archive(spark, tmp_path / f"{k}", b"".join(map(warc.member, own)))] == [intact]


def test_archives_of_other_writers(spark, tmp_path):
    """Members one by one, all in one, or none; names in any case, folded lines, no blank; other record types and digests."""

    def record(kind, fields, block):
        return f"WARC/1.0\r\nwarc-type:{kind}\r\n{fields}content-length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=x\r\n"
    records = [
        record("warcinfo", "", b"software: x"),
        record("request", "WARC-Record-ID: <r>\r\n", b"GET /"),
        record("response", "WARC-Page-ID: 1\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Payload-Digest: md5:abc\r\n", http + b"\r\nplain body\r\n\r\nmore"),
        record("response", "WARC-Page-ID: 2\r\n", http + b"TRANSFER-encoding: gzip, Chunked\r\n\r\n" + warc.chunked(b"abc", 2)),
        record("response", "WARC-Page-ID: 3\r\n", http + b"Transfer-Encoding: chunked\r\n\r\n5\r\nab"),
        record("resource", "WARC-Record-ID: <s>\r\nWARC-Segment-Number: 1\r\n", b"half"),
        record("continuation", "WARC-Segment-Origin-ID: <s>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 8\r\n", b"half"),
        record("revisit", "WARC-Page-ID: 4\r\n", b""),
    ]
    whole = b"".join(records)
    for k, data in enumerate([b"".join(map(warc.member, records)), b"\0".join(map(warc.member, records)), warc.member(whole), whole]):
        got = archive(spark, tmp_path / f"{k}", data)
        assert [(r.page_id, r.record_type, r.payload and bytes(r.payload), r.intact) for r in got] == [
            (1, "response", b"plain body\r\n\r\nmore", True), (2, "response", b"abc", True), (3, "response", None, False), (4, "revisit", None, True)
        ]
        assert got[0].url == "http://a/ b" and got[0].payload_digest == warc.payload_digest(b"plain body\r\n\r\nmore") and got[3].payload_bytes is None
    for cut in (whole[:-9], whole[:-2], whole[:20], b"no archive\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed(warc.inflated(cut)))
        with pytest.raises(ValueError):
            list(warc.parsed(warc.inflated(warc.member(cut))))
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.inflated(warc.member(whole)[:-9]))
    assert list(warc.parsed(warc.inflated(b""))) == []


def test_very_long_pages_and_other_columns(spark):
    rng = random.Random(9)
    long = "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(1_500_000))
    rows = [(1, "u", long, "x", 1), (2, "v", long, "x", 1), (3, "w", "a" * 4096, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, block int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].payload.decode() == long and (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, len(long.encode())) and got[3].intact
    assert "payload" not in warc.round_trip(pages, payload=False).columns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=5), st.integers(1, 60))
def test_records_in_pieces(blocks, piece):
    data = b"".join(warc._record("response", [("WARC-Page-ID", k)], b) for k, b in enumerate(blocks))
    got = list(warc.parsed(warc.inflated(b"".join(warc.member(x) for x in [data] * bool(data)), piece)))
    assert [b for _, b in got] == blocks and [f["warc-page-id"] for f, _ in got] == [str(k) for k in range(len(blocks))]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


# ---------------------------------------------------------------- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>", ""]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", ">", "/", "\n", "é", "s"]), max_size=8).map("".join)), max_size=4))
def test_chat_round_trip(turns):
    text, spans = chat.compiled(chat.TEMPLATE)(turns=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = lambda source, **v: chat.compiled(source)(**v)[0]
    assert run("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P,2Q"
    assert run("{% if a == 1 and b %}one{% elif a > 1 or none %}more{% else %}none{% endif %}", a=2, b=0) == "more"
    assert run("{% set y = 'a' ~ 1 + 'b' %}{{ 'x' if y == 'a1b' else 'z' }}{{ l[1] }}", l=["p", "q"]) == "xq"
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}{{ x }}{% endif %}c")) == (chat.Put(chat.Const("ab1c")),)
    assert chat.fold(chat.parse("{% set s = 'q' %}{{ s ~ s }}")) == (chat.Put(chat.Const("qq")),)
    for bad in ("{{ x.__class__ | evil }}", "{% for %}", "{{ f(1) }}", "{% if a %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ x.real }}", x=1)
    assert run("{% set loop = 7 %}{% for x in xs %}{{ loop.index }}{% endfor %}{{ loop }}", xs=[1, 2]) == "127"
    assert run("{{ '}}' }}{% if x == '%}' %}y{% endif %}{{ \"{{\" }}", x="%}") == "}}y{{"
    assert run("{% if x %}{{ 1 + 'a' }}{% endif %}ok", x=0) == "ok"
    for bad in ("{{ 1 + 'a' }}", "{{ l[9] }}", "{{ l | length < 'a' }}", "{{ 1 | length }}", "{{ 'a' in 1 }}", "{% for x in 3 %}{% endfor %}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ a", "{% set a = 1"):
        with pytest.raises(chat.TemplateError):
            run(bad, l=["p"])


def test_chat_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, None, "user", "</s>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(rows)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.formatted(rows.limit(0))).count() == 0


# ---------------------------------------------------------------- classifier


def test_classifier_holds_out_and_learns(spark, sf_dir):
    folder = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    weights = quality_model.fit(rows, labels)
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (weights == quality_model.fit(rows, flipped)).all()
    found = quality_model.scored(rows, weights).join(labels, "doc_id").filter(quality_model.held_out(F.col("doc_id")))
    right = found.select(((F.col("score") >= quality_model.THRESHOLD).cast("int") == F.col("quality")).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right >= 0.95


def test_classifier_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    weights = quality_model.fit(rows, none)
    assert not weights.any() and {r.score for r in quality_model.scored(rows, weights).collect()} == {0.5}
    assert quality_model.scored(rows.limit(0), weights).count() == 0
    row, index, total = quality_model.features(["", " a  a b ", "a"])
    assert total.tolist() == [0, 3 + 2 + 3 + 2 + 1, 2] and (index < quality_model.DIMENSIONS).all()
    assert quality_model.shape("Aabb12!!") == "Aa0!"
