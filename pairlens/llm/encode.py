"""Problem 7: encoding of a corpus with a public byte-level BPE vocabulary, by speculation and verification.

A word's greedy longest-match tokens are proposed; they are its exact encoding if every adjacent pair of them is
compatible, that is, if the merges of the pair's joined bytes give just these two tokens. Pairs are tested for a whole batch
at once, and only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pairlens.operators.skew import spread
from pairlens.sources.tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words whose tokens a worker remembers; beyond it the memory is emptied, which costs time but changes nothing.
KNOWN_WORDS = 400_000
#: Bytes of the longest word that is remembered.
KNOWN_BYTES = 200
# Fixed value: the pattern that splits text into words before the merges of this vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(path: str | None = None) -> str:
    """The file of ranks: ``path``, else the setting PAIRLENS_TOKENIZERS, else the installed public vocabularies."""
    if path:
        return path
    folder = os.environ.get("PAIRLENS_TOKENIZERS")
    if not folder:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    return os.path.join(folder, VOCABULARY)


class Encoder:
    """Exact byte-level BPE by ranks, where a token's id is its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.ranks))
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for k, v in self.ranks.items():
            self.bytes[v] = k
        # Longest token that starts with a given two bytes: bounds the greedy look-up.
        self.reach: dict[bytes, int] = {}
        for k in self.ranks:
            self.reach[k[:2]] = max(self.reach.get(k[:2], 0), len(k))
        self.fits = np.empty(0, np.int64)
        self.fails = np.empty(0, np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(WORD_PATTERN)
        # A token that its own merges don't give can never be in an encoding.
        self.reachable = np.zeros(self.size, bool)
        for k, v in self.ranks.items():
            self.reachable[v] = self.merge(k) == [v]

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding of one word: always the leftmost pair of least rank is merged, in n log n steps."""
        ranks, n = self.ranks, len(word)
        if n < 2:
            return [ranks[word]] if n else []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i] = stop
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                k = after[i]
                if (q := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (q, i, end[k]))
            if before[i] >= 0:
                b = before[i]
                if (q := ranks.get(word[b:stop])) is not None:
                    heapq.heappush(heap, (q, b, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest-match tokens."""
        ranks, reach, out, i, n = self.ranks, self.reach, [], 0, len(word)
        if (whole := ranks.get(word)) is not None:
            return [whole]
        while i < n:
            for k in range(min(reach.get(word[i : i + 2], 1), n - i), 0, -1):
                if (t := ranks.get(word[i : i + k])) is not None:
                    out.append(t)
                    i += k
                    break
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) encodes to itself; new pairs are merged once and remembered."""
        new = np.unique(codes)
        new = new[~(_in_sorted(new, self.fits) | _in_sorted(new, self.fails))]
        if len(new):
            ok = np.fromiter((self.merge(self.bytes[c // self.size] + self.bytes[c % self.size]) == [c // self.size, c % self.size] for c in new.tolist()), bool, len(new))
            self.fits = np.union1d(self.fits, new[ok])
            self.fails = np.union1d(self.fails, new[~ok])
        return _in_sorted(codes, self.fits)

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of different words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.propose(b) for b in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), bool)
        np.logical_or.at(bad, of[~self.reachable[flat]], True)
        inner = np.flatnonzero(of[:-1] == of[1:]) if len(flat) > 1 else np.empty(0, np.int64)
        if len(inner):
            fine = self.compatible(flat[inner] * self.size + flat[inner + 1])
            np.logical_or.at(bad, of[inner[~fine]], True)
        return {w: tuple(self.merge(b) if wrong else p) for w, b, p, wrong in zip(words, raw, proposed, bad.tolist())}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null and empty texts give the empty list."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in set(chain.from_iterable(split)) if w not in known]
        if new:
            found = self.learn(new)
            known.update((w, t) for w, t in found.items() if len(w) <= KNOWN_BYTES)
            rest = {w: t for w, t in found.items() if len(w) > KNOWN_BYTES}
            if rest:
                return [list(chain.from_iterable(known[w] if w in known else rest[w] for w in ws)) for ws in split]
        look = known.__getitem__
        return [list(chain.from_iterable(map(look, ws))) for ws in split]


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(``doc_id``, ``ids``): the token ids of each ``text``, without special tokens; other columns are ignored.

    Null and empty texts give the empty list. The strings of special tokens are ordinary text. ``path`` is looked up on the
    machine of the worker, so it must name the vocabulary there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(path))
        for b in batches:
            ids = enc.encode_batch(b.column("text").to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def p7_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_documents(table(spark, data_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
