"""Op 6: numbers of word pieces by a linear longest-match automaton.

Pieces are the byte strings of a public vocabulary (without its word-end mark);
every byte is one.  A word is cut greedily: the longest piece that it begins
with, then the longest that the rest begins with, and so on.  The automaton is
the trie of all pieces with failure links: where no edge goes on, the pieces
that are certain by then are popped, and their number is known beforehand, so no
piece is built and no byte is read twice.

Each different word of a block of texts is run once, all words in step.  A word of
over ``LONG`` bytes runs as parts that first assume the root; where the part before
ends elsewhere, a part is run again from there until both runs are in one state, and
what they popped by then is set right.  So long unbroken runs cost what their length is.
Words are runs of bytes other than space and the controls 9 to 13, lower-cased in A-Z.
A null or empty text has no words.  Rows with the same doc_id are rows of their own;
an empty table gives none.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as X
from ..plans.tables import columns

VOCABULARY, LONG, PART = "word_bpe_49k.json", 2048, 256


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary's byte strings and all single bytes."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    letters = byte_of_letter()
    found = {bytes(letters[c] for c in w.removesuffix("</w>")) for w in words if all(c in letters for c in w.removesuffix("</w>"))}
    return sorted((found | {bytes([b]) for b in range(256)}) - {b""})


@dataclass
class Matcher:
    """edges: sorted node * 256 + byte, to: their nodes; fail and popped by node; the root is 0."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of pieces of each word data[start:end]; no word is empty."""
        long = np.flatnonzero(ends - starts > LONG)
        if not len(long):
            n, node = self._run(data, starts, ends)
            return n + self._popped(node)
        out, short = np.empty(len(starts), np.int64), np.flatnonzero(ends - starts <= LONG)
        n, node = self._run(data, starts[short], ends[short])
        out[short] = n + self._popped(node)
        out[long] = [self._long(data, int(a), int(b)) for a, b in zip(starts[long], ends[long], strict=True)]
        return out

    def _popped(self, node: np.ndarray) -> np.ndarray:
        """Pieces that the ends of words pop."""
        n, node = np.zeros(len(node), np.int64), node.copy()
        lane = np.flatnonzero(node)
        while len(lane):
            n[lane] += self.popped[node[lane]]
            node[lane] = self.fail[node[lane]]
            lane = lane[node[lane] != 0]
        return n

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces popped within each word, and the node at its end; ``path`` gets both after each byte."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        begin, size = starts[order], length[order]
        n, node = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))
            lane, byte = np.arange(live), data[begin[:live] + step].astype(np.int64)
            while len(lane):
                key = node[lane] * 256 + byte
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[at] == key
                node[lane[on]] = self.to[at[on]]
                lane, byte = lane[~on], byte[~on]
                n[lane] += self.popped[node[lane]]
                node[lane] = self.fail[node[lane]]
            if path is not None:
                path[order[:live], step, 0], path[order[:live], step, 1] = node[:live], n[:live]
        out, last = np.empty_like(n), np.empty_like(node)
        out[order], last[order] = n, node
        return out, last

    def _long(self, data: np.ndarray, start: int, end: int) -> int:
        """Number of pieces of one long word."""
        total, node = 0, 0
        # So many parts at a time as a path of them takes 16 MB.
        for a in range(start, end, PART << 12):
            starts = np.arange(a, min(a + (PART << 12), end), PART)
            ends = np.minimum(starts + PART, end)
            path = np.zeros((len(starts), PART, 2), np.int64)
            n, last = self._run(data, starts, ends, path)
            for k, (b, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                own, begun = 0, node
                for step in range(e - b) if begun else ():
                    pops, node = self._step(node, int(data[b + step]))
                    own += pops
                    if node == path[k, step, 0]:
                        # From here on both runs are one.
                        total, node = total + own + int(n[k] - path[k, step, 1]), int(last[k])
                        break
                else:
                    total, node = (total + own, node) if begun else (total + int(n[k]), int(last[k]))
        return total + int(self._popped(np.array([node]))[0])

    def _step(self, node: int, byte: int) -> tuple[int, int]:
        """Pieces that a byte pops, and the node after it."""
        n = 0
        while True:
            key = node * 256 + byte
            at = int(np.searchsorted(self.edges, key))
            if at < len(self.edges) and self.edges[at] == key:
                return n, int(self.to[at])
            n, node = n + int(self.popped[node]), int(self.fail[node])


def matcher(vocabulary: list[bytes]) -> Matcher:
    """The automaton of a vocabulary that holds every byte."""
    child: list[dict[int, int]] = [{}]
    is_piece = [False]
    for p in vocabulary:
        at = 0
        for b in p:
            if b not in child[at]:
                child[at][b] = len(child)
                child.append({})
                is_piece.append(False)
            at = child[at][b]
        is_piece[at] = True
    fail, popped, todo = [0] * len(child), [0] * len(child), deque([0])
    while todo:
        u = todo.popleft()
        for b, v in child[u].items():
            if is_piece[v]:
                fail[v], popped[v] = 0, 1
            else:
                z, n = fail[u], popped[u]
                while b not in child[z]:
                    n += popped[z]
                    z = fail[z]
                fail[v], popped[v] = child[z][b], n
            todo.append(v)
    flat = sorted((u * 256 + b, v) for u, own in enumerate(child) for b, v in own.items())
    edges, to = np.array(flat, np.int64).T
    return Matcher(np.ascontiguousarray(edges), np.ascontiguousarray(to), np.array(fail), np.array(popped))


def token_counts(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens and longest_word (tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(matcher(vocabulary or pieces()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for part in X.slices(whole, "text", 8 << 20):
                data, offsets = X.buffers(part.column("text"))
                starts, ends, h, bounds = X.words(data, offsets, fold=X.LOWER)
                _, first, which = np.unique(h, return_index=True, return_inverse=True)
                n = own.counts(X.LOWER[data], starts[first], ends[first])[which] if len(h) else np.zeros(0, np.int64)
                most = np.zeros(part.num_rows, np.int64)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    most[some] = np.maximum.reduceat(n, bounds[:-1][some])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_words": pa.array(np.diff(bounds)),
                    "n_tokens": pa.array(X.sums(n, bounds)), "longest_word": pa.array(most),
                })

    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(read, "doc_id long, n_bytes long, n_words long, n_tokens long, longest_word long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
