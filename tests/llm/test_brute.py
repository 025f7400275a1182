"""Queries that SQL cannot express, whole, against plain-Python versions on the smallest tables."""

import hashlib
import itertools
import math
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_fingerprint, brute_spans, union
from vocalake.llm import line_dedup, mixing, pieces, quality_model, queries

M64 = 2**64 - 1


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


# ---------------------------------------------------------------- op1


def plain_mix(*parts):
    out = parts[0] * 0x9E3779B97F4A7C15 & M64
    for part in parts[1:]:
        out = ((out ^ out >> 29) * 0xBF58476D1CE4E5B9 + part) & M64
    out = (out ^ out >> 32) * 0x94D049BB133111EB & M64
    return (out ^ out >> 31) & (quality_model.DIMENSIONS - 1)


def plain_grams(text):
    words = [w for w in WORD.findall(text)]
    w = [xxhash.xxh64_intdigest(x) for x in words]
    s = [(xxhash.xxh64_intdigest(quality_model.shape(x)) + (k > 0 and words[k - 1] == x)) & M64 for k, x in enumerate(words)]
    out = [plain_mix(x) for x in w] + [plain_mix(a, b) for a, b in itertools.pairwise(w)]
    out += [plain_mix(x ^ 0x5A5A) for x in s] + [plain_mix(a ^ 0xA5A5, b) for a, b in itertools.pairwise(s)]
    return out + [plain_mix(a ^ 0xC3C3, b, c) for a, b, c in zip(s, s[1:], s[2:], strict=False)]


def plain_weights(texts, labels):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= quality_model.L1:
            return 0.0
        return -(z[k] - math.copysign(quality_model.L1, z[k])) / ((quality_model.BETA + math.sqrt(n[k])) / quality_model.ALPHA + quality_model.L2)

    for _ in range(quality_model.EPOCHS):
        for text, label in zip(texts, labels, strict=True):
            grams = plain_grams(text)
            x = {k: float(np.float32(quality_model.SCALE * c / max(1, len(grams)))) for k, c in Counter(grams).items()} | {quality_model.DIMENSIONS: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * x[k] for k in x)))))
            for k in x:
                g = (p - label) * x[k]
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality_model.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def test_quality_model_against_plain_python(spark, sf_dir):
    """All documents and labels: weights and scores of the query, the rows in the order in which it learns them."""
    docs = {d["doc_id"]: d["text"] or "" for d in rows_of(spark, sf_dir, "documents")}
    held = lambda k: __import__("zlib").crc32(str(k).encode()) % 5 == 0
    known = {r["doc_id"]: r["quality"] for r in rows_of(spark, sf_dir, "labels") if not held(r["doc_id"]) and r["doc_id"] in docs}
    from pyspark.sql import functions as F

    order = spark.createDataFrame([(k,) for k in known], "k long").orderBy(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)), "k")
    keys = [r.k for r in order.collect()]
    weights = plain_weights([docs[k] for k in keys], [known[k] for k in keys])
    got = {r.doc_id: r for r in queries.op1_quality_model(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        grams = plain_grams(text)
        logit = quality_model.SCALE * sum(weights.get(g, 0.0) for g in grams) / max(1, len(grams)) + weights.get(quality_model.DIMENSIONS, 0.0)
        score = 1 / (1 + math.exp(-logit))
        assert got[k].score == pytest.approx(score, abs=1e-5) and got[k].held_out == held(k)
        assert got[k].predicted == int(got[k].score >= 0.3)


# ---------------------------------------------------------------- op2


def plain_permuted(index, n, key):
    if n <= 1:
        return 0
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def scrambled(x, k):
        x = (x + k) * 0x9E3779B97F4A7C15 & M64
        x ^= x >> 29
        x = x * 0xD1B54A32D192ED03 & M64
        return (x ^ x >> 32) & mask

    while True:
        left, right = index >> half, index & mask
        for r in range(4):
            left, right = right, left ^ scrambled(right, key * 4 + r + 1)
        index = left << half | right
        if index < n:
            return index


def plain_taken(docs, block=mixing.BLOCK, seed=mixing.SEED):
    """{place of a row in docs: words taken of it, by word}, slot by slot."""
    weights, sizes = (5, 2, 1), [len(WORD.findall(d["text"] or "")) for d in docs]
    names = sorted({d["source"] for d in docs if d["source"] is not None}) + [None] * any(d["source"] is None for d in docs)
    totals = [sum(z for z, d in zip(sizes, docs, strict=True) if d["source"] == n) for n in names]
    wanted = mixing.targets(totals, [weights[k % 3] for k in range(len(names))], 1.5 * sum(totals))
    buckets, taken = max(1, -(-len(docs) // mixing.BUCKET_ROWS)), defaultdict(Counter)
    for number, (name, size, target) in enumerate(zip(names, totals, wanted, strict=True)):
        stream = []
        for k, (d, z) in enumerate(zip(docs, sizes, strict=True)):
            if d["source"] == name:
                h = xxhash.xxh64_intdigest(struct.pack("<q", d["doc_id"]), 42)
                h = xxhash.xxh64_intdigest((d["text"]).encode(), h) if d["text"] is not None else h
                h = h - 2**64 if h >> 63 else h
                stream.append((h % buckets, d["doc_id"], h, z, k))
        words = [(k, i) for *_, z, k in sorted(stream) for i in range(z)]
        blocks, left, slot = -(-size // block), min(round(target), 2 * size), 0
        while left > 0:
            turn = slot // blocks
            at = plain_permuted(slot % blocks, blocks, (seed * 1_000_003 + number) * 4_099 + turn)
            for k, i in words[at * block : (at + 1) * block][:left]:
                taken[k][i] += 1
            left -= len(words[at * block : (at + 1) * block][:left])
            slot += 1
    return taken


def test_mixing_against_plain_python(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents")
    want = plain_taken(docs)
    got = {r.doc_id: r for r in queries.op2_mixing(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        assert got[d["doc_id"]].taken == sum(want[k].values())


# ---------------------------------------------------------------- op5, op9


def test_personal_data_against_patterns(spark, sf_dir):
    docs = {d["doc_id"]: d["text"] or "" for d in rows_of(spark, sf_dir, "documents")}
    got = queries.op5_pii(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(docs) and sum(r.n_spans for r in got) > 0
    for r in got:
        spans = brute_spans(docs[r.doc_id])
        kinds = Counter(s[2] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        shown = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(r.spans.split(",")) and r.n_spans == len([x for x in r.spans.split(",") if x])


def test_simhash_against_all_pairs(spark, sf_dir):
    docs = sorted((d["doc_id"], d["text"]) for d in rows_of(spark, sf_dir, "documents"))
    prints = [brute_fingerprint(t, 3) for _, t in docs]
    roots = union(len(docs), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{p:016x}", docs[root][0]) for (k, _), p, root in zip(docs, prints, roots, strict=True)}


# ---------------------------------------------------------------- pipeline


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    """Each stage from what its predecessor has kept."""
    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_rules, plain_lines, plain_near, plain_mixture, plain_tokens), strict=True):
        columns = columns or docs.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        found = stage(spark, docs, sf_dir)
        if plain is not plain_tokens:
            assert found.columns == columns, name
        plain(docs, found)
        docs = found


def plain_rules(docs, found):
    kept = {r["doc_id"] for r in by_sql(docs, queries.OP4_SQL) if r["kept"]}
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in kept)
    assert 0 < len(kept) < docs.count()


def plain_lines(docs, found):
    pages, holding = Counter(), Counter()
    for r in docs.collect():
        pages[r.source] += 1
        holding.update((r.source, x) for x in {x.strip() for x in r.text.split("\n") if x.strip()})
    want = {}
    for r in docs.collect():
        bad = lambda x, s=r.source: x.strip() and holding[s, x.strip()] >= line_dedup.MIN_PAGES and holding[s, x.strip()] > line_dedup.RATIO * pages[s]
        want[r.doc_id] = "\n".join(x for x in r.text.split("\n") if not bad(x))
    assert {r.doc_id: r.text for r in found.collect()} == want
    assert all(r.n_chars == len(r.text) for r in found.collect())


def plain_near(docs, found):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := [x.lower() for x in WORD.findall(r.text or "")]) else set() for r in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = [rows[k] for k in sorted(set(union(len(rows), near)))]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def plain_mixture(docs, found):
    rows = [r.asDict() for r in docs.collect()]
    want = plain_taken(rows)
    words = defaultdict(Counter)
    for r in found.collect():
        words[r.doc_id].update(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    for k, d in enumerate(rows):
        own = WORD.findall(d["text"] or "")
        assert words[d["doc_id"]] == Counter(itertools.chain.from_iterable([own[i]] * n for i, n in want[k].items()))


def plain_tokens(docs, found):
    own = pieces.codec(pieces.read_model()).processor
    assert sorted((r.doc_id, r.token_ids) for r in found.collect()) == sorted((r.doc_id, own.encode(r.text)) for r in docs.collect())
