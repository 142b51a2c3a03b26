"""Op 4: packing of token ids into sequences, best fit decreasing.

A document is the ids of its text by a public word BPE and an end id.  Documents
longer than a sequence are first cut into full windows, which are sequences by
themselves; what is left of them, and all other documents, are pieces.  Pieces of
a pool are placed from the longest down, each into the open sequence with the
least room that holds it, which a segment tree over room finds.

A task packs its own partition, pool by pool, so nothing is shuffled and memory
is bounded by a pool; sequence ids hold the partition's number.

Tokenizing.  Texts of ASCII and Latin-1 letters are cut into words by the
tokenizer's own pattern, and each different word is encoded once; other texts,
and those that may hold a special token, go to the tokenizer whole.  Both give
the same ids; where the words of texts and their ids can't be told apart, the texts go
to the tokenizer whole, too.  A null text is empty: its only id is the end.  Rows with
the same doc_id are documents of their own; an empty table gives none.  A text is
tokenized whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as X
from ..plans.tables import columns

LENGTH, END, POOL, PIECES = 2048, 1, 1 << 22, 1 << 18
VOCABULARY = "word_bpe_49k.json"
_LETTERS, _NUMBERS = "a-zß-öø-ÿ", "0-9²³¹¼-¾"
#: Characters whose lower case and class the pattern below knows.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*\Z")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_NUMBERS}{_LETTERS}]+")


class Encoder:
    """Ids of texts; remembers the first ``most`` different words, others for the texts at hand."""

    def __init__(self, path: str | None = None, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.bounds, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), 0

    def _learn(self, new: list[str]) -> bool:
        """Encodes new words together; False where their ids don't show where each ends."""
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._forget([w for w in new if w in self.known])
                return False
            n, at = len(self.known), self.used
            while at + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.ids[at : at + len(ids)] = ids
            self.bounds[n + 1 : n + 1 + len(part)] = ends + at
            self.used = at + len(ids)
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
        return True

    def _forget(self, words: list[str]) -> None:
        """Takes out the words that were learned last."""
        for w in words:
            del self.known[w]
        self.used = int(self.bounds[len(self.known)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end."""
        cut: list[list[str] | None] = [None if "<|" in t or not _PLAIN.match(t) else _WORD.findall(t.lower()) for t in texts]
        seen = set().union(*(x for x in cut if x is not None))
        new = [w for w in seen if w not in self.known]
        room = max(0, self.most - len(self.known))
        if not self._learn(new):
            room, cut = len(new), [None] * len(texts)
        out = []
        for text, found in zip(texts, cut, strict=True):
            if found is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
            begin, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            to = np.cumsum(n)
            out.append(self.ids[np.arange(to[-1] if len(to) else 0) + np.repeat(begin - (to - n), n)])
        self._forget(new[room:])
        return out


@cache
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


class Room:
    """Open sequences by the room left in them; a segment tree tells the least room that is enough."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``need``, no longer open."""
        count, k = self.count, need + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, and the number of sequences."""
    room, n = Room(length), 0
    sequence, offset = [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = room.take(sizes[k])
        if found is None:
            found, n = (length, n), n + 1
        left, sequence[k] = found
        offset[k] = length - left
        if left > sizes[k]:
            room.put(left - sizes[k], sequence[k])
    return sequence, offset, n


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, pool: int = POOL, ids: bool = True, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``ids``, its ids.

    ``pool`` is the number of ids that a task packs together (``PIECES`` pieces at most).
    """

    def flush(pieces: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        whole = [p for p in pieces if p[2] == length]
        rest = [p for p in pieces if p[2] < length]
        sequence, offset, n = best_fit([p[2] for p in rest], length)
        made = list(range(first, first + len(whole))) + [first + len(whole) + s for s in sequence]
        cols = list(zip(*(whole + rest), strict=True))
        table = {c: pa.array(cols[k], pa.int64()) for k, c in enumerate(("doc_id", "start", "length", "ids_crc32", "doc_tokens"))}
        table |= {"sequence_id": pa.array(made, pa.int64()), "offset": pa.array([0] * len(whole) + offset, pa.int64())}
        if ids:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in cols[5]])]).astype(np.int32)
            table["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(cols[5]).view(np.int32)))
        return pa.RecordBatch.from_pydict(table), first + len(whole) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, held = encoder(path), [], 0
        first = TaskContext.get().partitionId() << 40
        for whole in batches:
            # Small parts: words that stay are kept among those that go, and hold their pages.
            for part in X.slices(whole, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, found in zip(part.column("doc_id").to_pylist(), encode.encode(texts), strict=True):
                    found = np.append(found, np.uint32(end)).astype("<u4")
                    for a in range(0, len(found), length):
                        own = found[a : a + length]
                        pieces.append((doc_id, a, len(own), zlib.crc32(own.tobytes()), len(found), own if ids else None))
                    held += len(found)
                    # Pieces of few ids are bounded by their number.
                    if held >= pool or len(pieces) >= PIECES:
                        out, first = flush(pieces, first)
                        pieces, held = [], 0
                        yield out
                        del out
                        X.trimmed()
        if pieces:
            out, pieces = flush(pieces, first)[0], []
            yield out
            del out
        X.trimmed()

    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, _PIECE + (", ids array<int>" if ids else ""))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
