"""Op 9: language identification by error-correcting output codes.

Every language has a codeword.  For each bit of the codewords a logistic
classifier over hashed byte n-grams (two and three bytes, A-Z lower-cased,
other ASCII but letters as spaces) tells how likely that bit is.  The codeword with the
least loss, each bit weighted by its classifier's margin, names the language; a
row is ambiguous when the bits it got differ from that codeword in more places
than the code corrects, or when two codewords are about as near.

Codes: all ways to split up to 6 languages in two; for more, the best of some
random codes by their least distance.  Classifiers learn from a sample of at
most ``SAMPLE`` rows a language, those with the least hashes of doc_id and text;
rates from counts over all rows keep the others out beforehand.  What leaves the
executors is the sample's n-gram counts, not its texts.

Only text is an input of a prediction.  A text that is null or has no letter is
``und`` with score 0; so is every text if there is nothing to learn from.  Rows with
null or repeated doc_ids are rows of their own, and repeated rows count each (at one
hash, they are taken alike).  Ties between codewords go to the first language by name.
Texts of any length are read whole; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrowtext as X
from .quality import remainder
from ..plans.tables import columns

SAMPLE, EPOCHS, RATE, SCALE = 800, 4, 0.5, 10.0
#: More languages than this are no list of languages.
MOST = 2000
_BITS = 16
#: Small letters and bytes above ASCII as they are, capitals as small letters, all else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def code(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        return np.array([[1 if k == 0 or column >> (k - 1) & 1 == 0 else -1 for column in range(1, 1 << (n - 1))] for k in range(n)], np.float32)
    rng, length = np.random.default_rng(5), 10 * int(np.ceil(np.log2(n)))
    tries = [rng.choice(np.array([-1, 1], np.float32), (n, length)) for _ in range(50)]
    nearest = lambda c: (np.triu(length - c @ c.T, 1) + np.tril(np.full((n, n), np.inf))).min()
    return max(tries, key=nearest)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the two- and three-byte sequences that begin at each byte (shorter by 1 and 2)."""
    low = _FOLD[data].astype(np.uint32)
    two = low[:-1] << 8 | low[1:]
    three = two[:-1] << 8 | low[2:]
    return two.astype(np.int64), (((three * np.uint32(2654435761)) >> np.uint32(32 - _BITS)) + np.uint32(1 << 16)).astype(np.int64)


def shares(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-gram numbers of a text and their scaled shares."""
    found = np.concatenate(grams(data)) if len(data) > 2 else np.zeros(0, np.int64)
    at, n = np.unique(found, return_counts=True)
    return at.astype(np.int32), n / max(1, len(found)) * SCALE


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], words: np.ndarray) -> np.ndarray:
    """Weights (features by bits) by adaptive gradient steps on (numbers, shares, language) rows; the last row is the bias."""
    size, bits = (1 << 16) + (1 << _BITS), words.shape[1]
    w, seen = np.zeros((size + 1, bits)), np.full((size + 1, bits), 1e-3)
    made = []
    for at, x, k in rows:
        made.append((np.append(at, size), np.append(x, 1.0)[:, None], words[k]))
    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in order.permutation(len(made)):
            at, x, y = made[k]
            margin = np.clip((w[at] * x).sum(0) * y, -30, 30)
            g = x * (-y / (1 + np.exp(margin)))
            seen[at] += g * g
            w[at] -= RATE * g / np.sqrt(seen[at])
    return w.astype(np.float32)


def margins(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Each text's margin for each bit."""
    rows = len(offsets) - 1
    total = np.zeros((rows, w.shape[1]))
    for a in range(0, len(data), block):
        b = min(len(data), a + block)
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        ends = offsets[first + 1 : last + 1]
        own = data[a : min(len(data), b + 2)]
        for k, found in enumerate(grams(own), 2):
            found = found[: b - a]
            here = w[found].astype(np.float64) if len(found) else np.zeros((0, w.shape[1]))
            cut = np.clip(np.concatenate([[a], ends]) - a, 0, len(found))
            # A sequence that would reach into the next text counts for none.
            for j in range(1, k):
                over = ends - j - a
                here[over[(over >= 0) & (over < len(here))]] = 0
            total[first:last] += np.stack([X.sums(np.ascontiguousarray(here[:, c]), cut) for c in range(w.shape[1])], 1) if w.shape[1] else 0
    length = np.diff(offsets)
    n = np.maximum(2 * length - 3, 1)
    return total / n[:, None] * SCALE + w[-1]


def decide(found: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of margins, by loss-weighted decoding."""
    loss = np.logaddexp(0, -found[:, None, :] * words[None]).sum(2)
    order = np.argsort(loss, 1, kind="stable")
    best = order[:, 0]
    likely = np.exp(-(loss - loss.min(1, keepdims=True)))
    score = likely[np.arange(len(best)), best] / likely.sum(1)
    wrong = (np.where(found >= 0, 1, -1) != words[best]).sum(1)
    apart = int(((words.shape[1] - words @ words.T) / 2 + np.eye(len(words)) * 1e9).min()) if len(words) > 1 else 1
    return best, score, (wrong > (apart - 1) // 2) | (score < 0.5)


def learn(docs: DataFrame, fold: int = 4, held: int = 2, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and weights from rows whose remainder by ``fold`` is not ``held``."""
    own = columns(docs, "doc_id", "text", "lang").filter("lang IS NOT NULL").filter(remainder(F.col("doc_id"), fold) != held)
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().toLocalIterator()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1, 0), np.float32)
    if len(langs) > MOST:
        raise ValueError(f"{len(langs)} languages are beyond {MOST}")
    # Rates are by language: about twice the sample passes, and the least hashes of it are taken.
    place = F.xxhash64("doc_id", "text")
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 2 * sample / counts[lang]))])
    some = own.filter("text IS NOT NULL").filter(F.pmod(place, F.lit(1_000_003)) / F.lit(1_000_003.0) < F.element_at(rates, F.col("lang")))
    ranked = some.withColumn("place", place).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    chosen = ranked.filter(F.col("n") <= sample).select("place", "lang", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in X.slices(whole, "text"):
                data, offsets = X.buffers(part.column("text"))
                found = [shares(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "place": part.column("place"), "lang": part.column("lang"),
                    "at": pa.array([at.tobytes() for at, _ in found], pa.binary()), "x": pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary()),
                })

    made = chosen.mapInArrow(read, "place long, lang string, at binary, x binary").toLocalIterator()
    rows = sorted((r["place"], langs.index(r["lang"]), bytes(r["at"]), bytes(r["x"])) for r in made)
    return langs, train([(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), k) for _, k, at, x in rows], code(len(langs)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w = shared.value
        words = code(len(langs))
        for whole in batches:
            for part in X.slices(whole, "text"):
                letter = part.column("letter").to_numpy(zero_copy_only=False)
                if langs:
                    best, score, unsure = decide(margins(*X.buffers(part.column("text")), w), words)
                else:
                    best, score, unsure, letter = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows), np.ones(part.num_rows, bool), np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "lang_pred": pa.array([langs[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)], pa.string()),
                    "score": pa.array(np.where(letter, score, 0.0)),
                    "ambiguous": pa.array(np.where(letter, unsure, True)),
                })

    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return own.mapInArrow(read, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
