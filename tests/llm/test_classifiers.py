"""Ops 8 and 9 against plain versions of their features, training and scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa

from convoke.llm import arrowtext as X
from convoke.llm import language, quality

M = (1 << 64) - 1
TEXTS = ["The cat 12 sat on the mat. mat! é É", None, "", "one", "a a a b", "word," * 9, "Ünï çödé text with 日本語 words", "x" * 300 + " y"]


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def word_hash(w):
    return mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) + len(w)) & M)


def shape(w):
    kinds = [1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 0 for b in w]
    out = 0
    for k, most in ((1, 3), (2, 1), (3, 1), (4, 1)):
        out = out * 4 + min(kinds.count(k), most)
    out = out * 256 + (0 if kinds[-1] else w[-1])
    return mix(out * 4 + min(len(w) >> 3, 3) + 1)


def plain_features(text):
    ws = (text or "").encode().split()
    h, s = [word_hash(w) for w in ws], [shape(w) for w in ws]
    at = lambda v, k: v[k] if k < len(v) else 0
    out = []
    for k in range(len(ws)):
        left = len(ws) - k
        two = (s[k] * 3 + at(s, k + 1)) & M
        made = [(h[k], 1), (h[k] * 5 + at(h, k + 1), 2), (s[k], 1), (two, 2), (two * 7 + at(s, k + 2), 3), (11 if h[k] == at(h, k + 1) else 13, 2)]
        out.append([mix(x & M) >> (64 - quality.BITS) if left >= need else 0 for x, need in made])
    return out


def test_features_of_quality():
    streams, bounds = quality.features(*X.buffers(pa.array(TEXTS)))
    for k, t in enumerate(TEXTS):
        assert [[int(s[i]) for s in streams] for i in range(bounds[k], bounds[k + 1])] == plain_features(t)


def test_training_and_scores_of_quality():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(1, 40, 6)).astype(np.int32), None, int(rng.integers(0, 2))) for _ in range(30)]
    rows = [(at, rng.random(len(at)).astype(np.float32), label) for at, _, label in rows]
    weights, bias = quality.train(rows)
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def solve(z, n):
        return 0.0 if abs(z) <= quality.L1 else (math.copysign(quality.L1, z) - z) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            w, wb = [solve(z.get(i, 0.0), n.get(i, 0.0)) for i in at.tolist()], solve(zb, nb)
            g = 1 / (1 + math.exp(-(sum(a * float(b) for a, b in zip(w, x, strict=True)) + wb))) - label
            for i, own, v in zip(at.tolist(), w, x.tolist(), strict=True):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g * v - (math.sqrt(old + (g * v) ** 2) - math.sqrt(old)) / quality.ALPHA * own
                n[i] = old + (g * v) ** 2
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / quality.ALPHA * wb
            nb += g * g
    assert abs(bias - solve(zb, nb)) < 1e-6 and all(abs(weights[i] - solve(z[i], n[i])) < 1e-5 for i in z) and np.count_nonzero(weights) <= len(z)
    weights = rng.normal(size=1 << quality.BITS).astype(np.float32)
    got = quality.scores(pa.RecordBatch.from_pydict({"text": pa.array(TEXTS)}), weights, 0.3)
    for k, t in enumerate(TEXTS):
        found = [i for line in plain_features(t) for i in line]
        total = sum(float(weights[i]) for i in found) / max(1, len(found)) * quality.SCALE
        assert abs(got[k] - 1 / (1 + math.exp(-(total + 0.3)))) < 1e-6


def test_conflicting_and_missing_labels(spark):
    docs = spark.createDataFrame([(k, "good text of words") for k in range(1, 9)] + [(1, "other text")] * 3, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    for labels in (none, odd):
        weights, bias = quality.learn(docs, labels)
        assert bias == 0 and not weights.any()
        assert {r.score for r in quality.score(docs, (weights, bias)).collect()} == {0.5}
    both = spark.createDataFrame([(k, q) for k in range(1, 9) for q in (0, 1)], "doc_id long, quality int")
    assert {r.score > 0.5 for r in quality.score(docs, quality.learn(docs, both)).collect()} == {True}
    assert quality.keep_good(docs, both).count() == docs.count()


def plain_grams(text):
    low = [b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in (text or "").encode()]
    two = [a << 8 | b for a, b in zip(low, low[1:])]
    three = [(((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16) + (1 << 16) for a, b, c in zip(low, low[1:], low[2:])]
    return two + three


def test_margins_of_language():
    rng = np.random.default_rng(2)
    texts = [t for t in TEXTS if t] + ["ab", "a", "", "long text " * 60]
    w = rng.normal(size=((1 << 16) + (1 << 16) + 1, 3)).astype(np.float32)
    for block in (7, 64, 1 << 17):
        got = language.margins(*X.buffers(pa.array(texts)), w, block)
        for k, t in enumerate(texts):
            found = plain_grams(t)
            n = max(2 * len(t.encode()) - 3, 1)
            want = w[found].astype(float).sum(0) / n * language.SCALE + w[-1] if found else w[-1]
            assert np.allclose(got[k], want, atol=1e-4)


def test_training_of_language():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 30))) for _ in range(24)]
    words = language.code(3)
    rows = [(*language.shares(np.frombuffer(t.encode(), np.uint8)), k % 3) for k, t in enumerate(texts)]
    for (at, x, _), t in zip(rows, texts, strict=True):
        found = plain_grams(t)
        assert at.tolist() == sorted(set(found)) and np.allclose(x, [found.count(i) / len(found) * language.SCALE for i in at.tolist()])
    got, bits = language.train(rows, words), words.shape[1]
    w, seen, size = {}, {}, (1 << 16) + (1 << 16)
    order = np.random.default_rng(3)
    for _ in range(language.EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, lang = rows[k]
            own = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            for b in range(bits):
                y = float(words[lang][b])
                margin = sum(w.get((i, b), 0.0) * v for i, v in own) * y
                for i, v in own:
                    g = v * (-y / (1 + math.exp(min(30, max(-30, margin)))))
                    seen[i, b] = seen.get((i, b), 1e-3) + g * g
                    w[i, b] = w.get((i, b), 0.0) - language.RATE * g / math.sqrt(seen[i, b])
    assert all(abs(got[i, b] - v) < 1e-4 for (i, b), v in w.items())


def test_odd_rows_of_language(spark):
    rows = spark.createDataFrame([(None, "aaa bbb", "x"), (None, "aaa bbb", "x"), (7, "aaa bbb", "x"), (7, "ccc ddd", "y"), (8, None, "y"), (9, "ccc ddd", None), (10, "ccc ddd", "y")], "doc_id long, text string, lang string")
    langs, w = language.learn(rows)
    assert langs == ["x", "y"]
    got = [(r.doc_id, r.lang_pred) for r in language.identify(rows, (langs, w)).collect()]
    assert sorted(got, key=str) == sorted([(None, "x"), (None, "x"), (7, "x"), (7, "y"), (8, "und"), (9, "y"), (10, "y")], key=str)
    assert language.identify(rows.limit(0), (langs, w)).count() == 0
