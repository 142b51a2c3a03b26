"""Operators over texts against plain versions of themselves, and their odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.llm import arrowtext as X
from convoke.llm import attention, automaton, language, packing, quality, scoring, secrets, simhash, substring, tokencount
from convoke.llm import decontaminate as D

ODD = [None, "", "   \n", "é", "a" * 20_000, "one", "x y", " nbsp ", "tab\tnew\nline\r\x0b\x0cend"]
SHAPE = "doc_id long, text string, d long, H string, found string, _row int, lang string"


def docs(spark, texts, ids=None):
    """Rows with columns whose names clash with those that operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "h", "f", 2, "en") for i, t in zip(ids, texts, strict=True)], SHAPE)


def words(text):
    return (text or "").encode().split()


def corpus(seed, n=60, kinds=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(kinds)] + ["é", "Ab"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    copies = [base[rng.randrange(n)] for _ in range(10)] + [base[0] + "  " + base[1], "a a " * 40]
    return base + copies


def test_words_and_hashes():
    import pyarrow as pa

    texts = [*ODD, "b a", "a b", "x" * 9]
    data, offsets = X.buffers(pa.array(texts))
    for size in (3, 1 << 18):
        cuts = list(X.blocks(data, offsets, X.NOT_SPACE, size))
        assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]]
    starts, ends, h, bounds = X.words(data, offsets)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        assert [raw[a:b] for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)] == words(t)
    by = {}
    for a, b, x in zip(starts, ends, h, strict=True):
        assert by.setdefault(raw[a:b], x) == x
    assert len(set(by.values())) == len(by)
    sliced = pa.array(texts).slice(3, 4)
    assert X.buffers(sliced)[1][-1] == sum(len((t or "").encode()) for t in texts[3:7])
    assert X.words(*X.buffers(pa.array([], pa.string())))[3].tolist() == [0]


# 1


def brute_leaks(text, items, size=10):
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hit, found = set(), set()
    for item, t in items:
        own = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        n = min(size, len(own))
        if not n:
            continue
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found |= {item}
    return len(ws), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, limit, monkeypatch):
    texts = corpus(1) + ODD
    items = [(1, texts[3]), (2, " ".join(texts[4].split()[:12]).upper()), (12, "w1 w2"), (3, texts[3]), (None, "w5 w5"), (4, None), (5, "--")]
    rows, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", limit)
    monkeypatch.setattr(D.find_leaks, "__defaults__", (10, limit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in D.decontaminate(rows, bench).collect()}
    assert got == {k: brute_leaks(t, items) for k, t in enumerate(texts)}
    kept = D.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v[1]}
    assert D.decontaminate(rows.limit(0), bench).count() == 0 and not D.decontaminate(rows, bench.limit(0)).filter("contaminated").count()
    twice = docs(spark, ["w1 w2", None, "w1 w2"], [7, 7, None])
    assert sorted((r.doc_id or 0, r.n_hit) for r in D.decontaminate(twice, bench).collect()) == [(0, 2), (7, 0), (7, 2)]


# 2


def test_gradients_and_windows():
    model, rng = attention.Model(7), np.random.default_rng(0)
    model.w = {k: rng.normal(size=v.shape) * 0.3 for k, v in model.w.items()}
    inputs, targets = rng.integers(0, 8, (3, 2 * attention.HALF)), rng.integers(-1, 7, (3, attention.HALF))
    _, d = model.gradients(inputs, targets)
    for name, w in model.w.items():
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        losses = []
        for step in (1e-5, -1e-5):
            w[at] += step
            losses.append(model.gradients(inputs, targets)[0])
            w[at] -= step
        assert abs((losses[0] - losses[1]) / 2e-5 - d[name][at]) < 1e-6
    ids, bounds = np.arange(70, dtype=np.int32) % 7, np.array([0, 1, 1, 50, 70])
    inputs, targets, ends = attention.layout(ids, bounds, 7)
    assert sorted(targets[targets >= 0]) == sorted(ids) and np.diff(ends).tolist() == [1, 0, 4, 2]
    # Each target's inputs end with the id before it, and later ids don't count.
    p = attention.Model(7)
    p.w = {k: v + 0.1 for k, v in p.w.items()}
    one = p.log_probabilities(inputs, targets)
    changed = inputs.copy()
    changed[:, -1] = 3
    assert np.allclose(p.log_probabilities(changed, targets)[:, :-1], one[:, :-1])
    every = [p.log_probabilities(inputs[:1], np.full((1, attention.HALF), k))[0, 0] for k in range(7)]
    assert abs(sum(math.exp(x) for x in every) - 1) < 1e-5


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLE", 20)
    texts = corpus(2, 80, 30) + ODD
    rows = docs(spark, texts, [*range(len(texts) - 1), None])
    held = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2
    low = lambda t: re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
    ids = [*range(len(texts) - 1), None]
    train = [low(t) for i, t in zip(ids, texts, strict=True) if not held(i)]
    counts = collections.Counter(w for t in train for w in t)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    for share in (1e-6, 0.01):
        got = {r.doc_id: r for r in scoring.score_texts(rows, share=share).collect()}
        for i, t in zip(ids, texts, strict=True):
            ws = low(t)
            base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws) + math.log10((len(train) + 1) / (total + kinds + 1))
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws) + 1, sum(w in counts for w in ws) + 1, total, held(i))
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert scoring.score_texts(rows.limit(0)).count() == 0
    lone = scoring.score_texts(docs(spark, ["a b"], [2 if held(2) else next(k for k in range(99) if held(k))])).first()
    assert (lone.n_tokens, lone.n_known, lone.train_tokens, lone.base_score) == (3, 0, 0, 0.0)


# 4


def test_packing(spark):
    rng = random.Random(3)
    bits = ["l'été", "IT'S", "don't", "''s", "'llama", "  ", "\n", "ß", "ŒUVRE", "½", "x²", "12", "!!!", "<|endoftext|>", "İ", "日本", "\x1c", "\x85", "foo", "BAR"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ODD + ["word " * 5000]
    rows = docs(spark, texts).repartition(3)
    small = packing.Encoder(most=40)
    whole = small.tokenizer
    expect = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    for k in range(0, len(texts), 20):
        assert [x.tolist() for x in small.encode([t or "" for t in texts[k : k + 20]])] == [expect[j][:-1] for j in range(k, min(len(texts), k + 20))]
    assert len(small.known) <= 40
    pieces = packing.pack(rows, 256, pool=2000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) <= 256 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(expect[p.doc_id])
    for k, ids in expect.items():
        own = sorted(by_doc[k], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids and [p.start for p in own] == [sum(len(q.ids) for q in own[:j]) for j in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:j]) for j in range(len(own))] and sum(p.length for p in own) <= 256
    assert packing.pack(rows.limit(0)).count() == 0


def test_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        sequence, offset, n = packing.best_fit(sizes, 64)
        room, plain = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [r for r in room if r >= sizes[k]]
            used = min(fits) if fits else 64
            if fits:
                room.remove(used)
            room += [used - sizes[k]] if used > sizes[k] else []
            plain[k] = 64 - used
        assert offset == [plain[k] for k in range(len(sizes))] and (not sizes or max(sequence) == n - 1)


# 5


def test_golay_code():
    v = np.random.default_rng(0).integers(0, 1 << 23, 500)
    own = simhash.decode(v)
    for weight in range(4):
        # A codeword changed in up to three bits decodes to itself.
        word = v ^ simhash._errors()[simhash.syndrome(v)]
        for k in range(weight):
            word = word ^ (1 << (7 * k))
        assert (simhash.decode(word) == own).all()
    rng = random.Random(2)
    for _ in range(3000):
        a = b = rng.getrandbits(64)
        for k in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << k
        one, two = (set(simhash.keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert one & two


def test_simhash(spark, monkeypatch):
    texts = corpus(4, 80, 40) + ODD + ["ONE", "one", "w1 w2 w3 " * 30 + "x", "w1 w2 w3 " * 30 + "y"]
    ids = [*range(3, len(texts) + 1), None, None]
    rows = docs(spark, texts, ids)
    prints = [simhash.fingerprint((t or "").encode().lower().split()) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[k], *(label[j] for j in range(len(texts)) if (prints[j] ^ prints[k]).bit_count() <= 3)]) for k in range(len(texts))]
    least = {x: min((ids[k] for k in range(len(texts)) if label[k] == x and ids[k] is not None), default=None) for x in set(label)}
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted(((i is None, i or 0, f"{p:016x}", least[x]) for i, p, x in zip(ids, prints, label, strict=True)), key=str)
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_fingerprints_against_plain_xxh64():
    """An XXH64 of one's own and bit counts in Python integers."""
    p = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
    m = (1 << 64) - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & m
    mix = lambda acc, x: turn((acc + x * p[1]) & m, 31) * p[0] & m

    def xxh64(b, seed=42):
        at, word = 0, lambda k, n: int.from_bytes(b[k : k + n], "little")
        if len(b) >= 32:
            v = [(seed + p[0] + p[1]) & m, (seed + p[1]) & m, seed, (seed - p[0]) & m]
            while at + 32 <= len(b):
                v = [mix(x, word(at + 8 * k, 8)) for k, x in enumerate(v)]
                at += 32
            h = sum(turn(x, n) for x, n in zip(v, (1, 7, 12, 18), strict=True)) & m
            for x in v:
                h = ((h ^ mix(0, x)) * p[0] + p[3]) & m
        else:
            h = (seed + p[4]) & m
        h = (h + len(b)) & m
        while at + 8 <= len(b):
            h, at = (turn(h ^ mix(0, word(at, 8)), 27) * p[0] + p[3]) & m, at + 8
        if at + 4 <= len(b):
            h, at = (turn(h ^ (word(at, 4) * p[0] & m), 23) * p[1] + p[2]) & m, at + 4
        for x in b[at:]:
            h = turn(h ^ (x * p[4] & m), 11) * p[0] & m
        h = (h ^ h >> 33) * p[1] & m
        h = (h ^ h >> 29) * p[2] & m
        return h ^ h >> 32

    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 9, 60):
        ws = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(1, 20))) for _ in range(n)]
        made = [b" ".join(ws[k : k + 3]) for k in range(max(1, n - 2))] if n else []
        hashes = [xxh64(x) for x in made]
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if made else 0
        assert simhash.fingerprint(ws) == want


# 6


def test_token_counts(spark):
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"bcd", b"cde", b"abcdef", b"\xc3\xa9a", b"cdefgh"})
    texts = corpus(5) + ODD + ["abcde abcdx abcdefgh ABCDEFG abcab éab bcdbcde"]
    known = set(vocabulary)

    def brute(w):
        n = 0
        while w:
            w = w[next(k for k in range(min(len(w), 6), 0, -1) if w[:k] in known) :]
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens, r.longest_word) for r in tokencount.token_counts(docs(spark, texts), vocabulary).collect()}
    for k, t in enumerate(texts):
        n = [brute(w) for w in re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()]
        assert got[k] == (len(n), sum(n), max(n, default=0))
    assert tokencount.token_counts(docs(spark, []), vocabulary).count() == 0


def test_token_counts_of_the_real_vocabulary(monkeypatch):
    """Pieces read by a decoding of one's own, cuts by plain search, and long words by parts."""
    import json
    import pyarrow as pa
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    table = {}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    for b in range(256):
        table[chr(b) if b in shown else chr(256 + [x for x in range(256) if x not in shown].index(b))] = b
    known = {bytes([b]) for b in range(256)}
    for w in entries:
        w = w[:-4] if w.endswith("</w>") else w
        if w and set(w) <= set(table):
            known.add(bytes(table[c] for c in w))
    assert sorted(known) == tokencount.pieces() and len(known) > 40_000
    rng = random.Random(11)
    some = sorted(known, key=lambda w: (len(w), w))
    texts = ["".join(rng.choice(some[256:]).decode("utf-8", "replace") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts += ["internationalization antidisestablishmentarianism", "日本語の文章" * 500, "".join(rng.choice("abcdeth") for _ in range(30_000)), "ab" * 5000, "x" * 9000]

    def plain(w):
        n, longest = 0, len(some[-1])
        while w:
            w = w[next(k for k in range(min(len(w), longest), 0, -1) if w[:k] in known) :]
            n += 1
        return n

    matcher = tokencount.matcher(sorted(known))
    data, offsets = X.buffers(pa.array(texts))
    starts, ends, _, bounds = X.words(data, offsets)
    got = matcher.counts(data, starts, ends)
    raw = data.tobytes()
    assert got.tolist() == [plain(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    monkeypatch.setattr(tokencount, "LONG", 3)
    for part in (2, 3, 7):
        monkeypatch.setattr(tokencount, "PART", part)
        assert matcher.counts(data[: offsets[302]], starts[: bounds[302]], ends[: bounds[302]]).tolist() == got[: bounds[302]].tolist()


# 7


def base_spans(text):
    b = (text or "").encode()
    at = lambda i: len(b[:i].decode("utf-8", "ignore"))
    out = [(at(m.start()), 0, at(m.end())) for m in re.finditer(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", b) if len(m[1]) >= 6]
    out += [(at(m.start()), 1, at(m.end())) for m in re.finditer(rb"AKIA[A-Z0-9]+", b) if len(m[0]) >= 20]
    return sorted(out + [(at(m.start()), 2, at(m.end())) for m in re.finditer(rb"[0-9a-f]+", b) if len(m[0]) >= 24])


def all_spans(text):
    """Base spans and every assign match, wherever it begins, whose value is long enough."""
    every = re.finditer(r"""(?=((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))""", text or "")
    return sorted({*base_spans(text), *((m.start(1), 0, m.end(1)) for m in every if len(m[2]) >= 6)})


def test_secrets(spark):
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "AKIAB", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "\n", "é", "x", "--", ".", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ODD + ["token=secret:abcdefgh", "a" * 30 + "f" * 100_000]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(rows)).collect()}
    added = 0
    for k, t in enumerate(texts):
        want = base_spans(t)
        told = ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in want)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(x[1] == j for x in want) for j in range(3)]
        whole = all_spans(t)
        assert got[k].spans == ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in whole)
        added += len(whole) - len(want)
    assert added > 50 and got[len(texts) - 2].spans == "assign:0:12,assign:6:21"
    clean = secrets.redact(rows)
    assert clean.columns == rows.columns
    for r in clean.collect():
        t = texts[r.doc_id]
        assert (r.text is None) == (t is None) and (base_spans(t) or r.text == t) and not [x for x in base_spans(r.text) if x[1] > 0]
    assert secrets.find_secrets(rows.limit(0)).count() == 0


def test_secrets_in_long_lines():
    many = b"token=" * 170_000 + b"abcdef"
    blob = b"token=" + b"a1B2/" * 200_000 + b"\nsecret = '" + b"q" * 50_000
    began = time.perf_counter()
    assert [len(x) for x in secrets.spans([many, blob])] == [170_000, 2]
    assert time.perf_counter() - began < 20
    assert secrets.spans([blob])[0] == [(0, 1_000_006, 0, True), (1_000_007, 1_050_017, 0, True)]
    alone = [secrets.spans([t])[0] for t in (b"token=token=abcdefgh", b"token=secret:abcdefgh")]
    both = secrets.spans([b"token=secret:abcdefgh token=token=abcdefgh"])[0]
    assert alone[0] == [(0, 20, 0, True), (6, 20, 0, False)] and both == alone[1] + [(a + 22, b + 22, k, base) for a, b, k, base in alone[0]]


def test_automaton():
    rng = random.Random(9)
    patterns = ["ab+c", "(x|yz){2,}", "[0-9]{3}", "q?r", "a[^b\\x0a]c"]
    rules = automaton.compiled(patterns)
    for _ in range(300):
        text = "".join(rng.choice("abcxyzqr019\n") for _ in range(rng.randint(1, 200))).encode()
        at, which = rules.hits(np.frombuffer(text, np.uint8), lanes=rng.choice([1, 7, 64, 4096]))
        want = {}
        for k, p in enumerate(patterns):
            for end in range(1, len(text) + 1):
                if re.search(f"(?:{p})\\Z".encode(), text[:end]):
                    want[end - 1] = want.get(end - 1, 0) | 1 << k
        assert dict(zip(at.tolist(), which.tolist(), strict=True)) == want


# 8 and 9


def test_quality(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "word", "text", "some"]) for _ in range(rng.randint(5, 60))) + "."
    junk = lambda: " ".join(rng.choice(["the", "of", "and"]) + rng.choice(["###", "$$$"]) for _ in range(rng.randint(5, 60)))
    texts = [clean() if k % 4 else junk() for k in range(400)] + [None, "", "x" * 50_000]
    rows = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 > 0) if k % 5 else None, 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    model = quality.learn(rows, labels)
    got = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    right = [(got[k] >= 0.3) == (k % 4 > 0) for k in range(400)]
    assert sum(right) > 390
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= quality.KEEP}
    none = quality.learn(rows, labels.limit(0))
    assert {r.score for r in quality.score(rows, none).collect()} == {0.5} and quality.score(rows.limit(0), model).count() == 0


def test_language(spark):
    rng = random.Random(8)
    kinds = {"xx": "abcd", "yy": "efgh", "zz": "àéîõ"}
    texts, langs = [], []
    for k in range(300):
        lang = sorted(kinds)[k % 3]
        texts.append(" ".join("".join(rng.choice(kinds[lang]) for _ in range(5)) for _ in range(rng.randint(1, 30))))
        langs.append(lang if k % 7 else None)
    texts += [None, "", "123 !!", "7" * 60_000]
    langs += ["xx"] * 4
    rows = spark.createDataFrame([(k, t, lang, 1) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.identify(rows, language.learn(rows)).collect()}
    assert sum(got[k].lang_pred == sorted(kinds)[k % 3] for k in range(300)) > 290
    assert [(got[k].lang_pred, got[k].score, got[k].ambiguous) for k in range(300, 304)] == [("und", 0.0, True)] * 4
    assert all(0 <= r.score <= 1 for r in got.values())
    alone = language.learn(rows.filter("lang = 'xx'"))
    assert {r.lang_pred for r in language.identify(rows.limit(50), alone).collect()} == {"xx"}
    assert {r.lang_pred for r in language.identify(rows, language.learn(rows.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 6, 9, 40])
def test_codes(n):
    words = language.code(n)
    apart = [(a != b).sum() for k, a in enumerate(words) for b in words[:k]]
    assert min(apart) >= 1 and (n > 6 or words.shape[1] == 2 ** (n - 1) - 1)
    best, score, unsure = language.decide(words * 3.0, words)
    assert best.tolist() == list(range(n)) and not unsure.any() and (score > 0.5).all()
    if n > 2:
        flipped = words * 3.0
        flipped[:, 0] *= -0.2
        assert language.decide(flipped, words)[0].tolist() == list(range(n))


# 10


def brute_repeats(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ws = words(t)
        gone, own = set(), []
        for k in range(len(ws) - size + 1):
            g = tuple(ws[k : k + size])
            if g in seen or g in own:
                gone |= set(range(k, k + size))
            own.append(g)
        seen |= set(own)
        out[i] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode())
    return out


@pytest.mark.parametrize(("size", "anchor", "batches"), [(5, 3, 1), (5, 5, 3), (20, 10, 3)])
def test_substring_dedup(spark, size, anchor, batches):
    texts = corpus(6, 40, 12) + ODD + ["b " * 60, "p q r s t u v w x y z " * 4]
    rows = docs(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(rows, size, anchor, batches).collect()}
    assert got == brute_repeats(enumerate(texts), size)


def test_substring_cases(spark):
    long = " ".join(f"u{k}" for k in range(30))
    rows = docs(spark, [long, long, long, "x " + long, None], [5, 5, 3, None, None])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(rows, texts=False).collect())
    assert got == [(0, 0), (0, 30), (3, 0), (5, 30), (5, 30)]
    assert substring.remove_repeats(rows.limit(0)).count() == 0


def test_repeated_windows():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        h, c, d, t, at = (rng.integers(0, k, n) for k in (5, 2, 4, 2, 6))
        again, same = substring.repeats(h.astype(np.uint64), c.astype(np.uint16), d, t, at)
        rows = list(zip(h.tolist(), c.tolist(), d.tolist(), t.tolist(), at.tolist(), strict=True))
        want = [any(r[:2] == q[:2] and (q[2] < r[2] or q[2:4] == r[2:4] and q[4] < r[4]) for q in rows) for r in rows]
        assert again.tolist() == want
        # Of rows that are equal in all and not repeated, all but one are told.
        assert all(not (a and b) for a, b in zip(again, same, strict=True)) and len({r for r, w in zip(rows, want, strict=True) if not w}) == n - sum(want) - int(same.sum())


def test_index_takes_batches_without_old_texts(spark, tmp_path):
    texts = corpus(7, 60, 10) + [" ".join(f"v{k}" for k in range(40))] * 2
    rows = docs(spark, texts)
    cuts, path, size = [0, 20, 35, len(texts)], f"file://{tmp_path}/index", 5
    want, got = brute_repeats(enumerate(texts), size), {}
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        # Each batch opens the index anew and sees its own rows only.
        index = substring.FingerprintIndex(spark, path, size, 3, most_runs=k + 1)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(rows.filter(f"doc_id >= {a} AND doc_id < {b}"), index=index).collect()}
        index.close()
    assert got == want
    index = substring.FingerprintIndex(spark, path, size, 3)
    assert len(index.list["runs"]) == 3
    index.compact()
    assert len(index.list["runs"]) == 1 and len([x for x in (tmp_path / "index").iterdir() if x.name.startswith("run-")]) == 1
    late = docs(spark, [texts[3], "new " * 3], [900, 901])
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(late, index=index, texts=False).collect()} == {900: len(words(texts[3])) if len(words(texts[3])) >= size else 0, 901: 0}
    other = substring.FingerprintIndex(spark, path, size, 3)
    other._listed(other.list["runs"])
    with pytest.raises(RuntimeError):
        index._listed(index.list["runs"])
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, path, 9)
    assert spark.sql("SHOW TABLES").count() > 0
    index.close()
    other.close()
    assert spark.sql("SHOW TABLES").count() == 0
    gone = substring.FingerprintIndex(spark)
    folder = gone.path.removeprefix("file://")
    gone.close()
    import os

    assert not os.path.exists(folder)


def test_bitmap(spark):
    from convoke.llm.bits import bitmap, passes

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = bitmap(rows, "h")
    own = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64)
    other = np.random.default_rng(0).integers(0, 2**64, 20_000, np.uint64)
    assert passes(bits, own).all() and passes(bits, other).mean() < 0.1
    assert not passes(bitmap(rows.limit(0), "h"), own).any()
