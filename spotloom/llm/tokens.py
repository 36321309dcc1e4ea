"""Encoding with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are entries as a whole, all distinct ones of
a batch at once; a pre-token that is none is split into its bytes, held in a linked list, and merged lowest rank first with
a heap. Both give the ids of
ordinary byte-pair encoding, since a pre-token that is an entry is always merged into it or kept apart by rank alone,
which the build step checks entry by entry.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts a text into pre-tokens, part of the vocabulary's definition.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of texts that are encoded together.
CHARACTERS = 4_000_000


class PerfectHash:
    """A minimal perfect hash in levels: a key whose place in a level's bit field no other key has stays there, the rest
    go on to the next, smaller field. A key's number is the count of set bits before its own, so numbers are dense. The
    number's own key is compared at look-up, so strangers are recognised. Everything is an array: it is built at once on
    the driver and sent to the tasks as it is, and whole columns of keys are looked up together.
    """

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        first = _hashes(keys)
        if len(np.unique(first)) != len(keys):
            raise ValueError("two keys are equal, or have one hash")
        self.sizes: list[int] = []
        fields: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            size = max(64, int(spread * len(left)))
            at = _mix(first[left], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            fields.append(alone)
            left = left[~alone[at]]
        self.bits = np.concatenate(fields) if fields else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits) - self.bits
        self.first = np.zeros(len(keys), np.uint64)
        self.own: list[bytes] = [b""] * len(keys)
        self.place = np.zeros(len(keys), np.int64)
        number = self._numbers(first)
        self.first[number], self.place[number] = first, np.arange(len(keys))
        for n, k in zip(number.tolist(), keys, strict=True):
            self.own[n] = k

    def _numbers(self, first: np.ndarray) -> np.ndarray:
        """Each hash's number, or -1 where no level has it alone."""
        out = np.full(len(first), -1)
        todo, base = np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            at = base + _mix(first[todo], level, size)
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo, base = todo[~hit], base + size
        return out

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Each key's place in the list that the hash was built from, or -1."""
        first = _hashes(keys)
        number = self._numbers(first)
        hit = np.flatnonzero(number >= 0)
        hit = hit[self.first[number[hit]] == first[hit]]
        own = self.own
        hit = [i for i, n in zip(hit.tolist(), number[hit].tolist(), strict=True) if own[n] == keys[i]]
        out = np.full(len(keys), -1)
        out[hit] = self.place[number[hit]]
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _mix(h: np.ndarray, level: int, size: int) -> np.ndarray:
    h = h ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding of one pre-token: a heap of the adjacent pairs over a linked list of parts."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end = list(range(1, n + 1))  # a part reaches from its start to its end; 0 where it was merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue  # one of the two parts has grown or gone since
        end[i], end[mid] = to, 0
        if to < n:
            prev[to] = i
            if (r := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def load_ranks(name: str, path: str = TOKENIZERS) -> dict[bytes, int]:
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of texts. It is plain data, built once where the job is put together, so that tasks need no vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # a whole pre-token is its own id only if its bytes merge into it
        words = [w for w in ranks if merge_bytes(w, ranks) == [ranks[w]]]
        self.ids = np.array([ranks[w] for w in words], np.int32)
        self.table = PerfectHash(words)

    def words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, number of ids of each): by the perfect hash where a piece is an entry, else by
        merging its bytes."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        at = self.table.find(raw)
        many = np.ones(len(raw), np.int64)
        misses = np.flatnonzero(at < 0).tolist()
        merged = [merge_bytes(raw[i], self.ranks) for i in misses]
        many[misses] = [len(m) for m in merged]
        out = np.empty(int(many.sum()), np.int32)
        start = np.cumsum(many) - many
        out[start[at >= 0]] = self.ids[at[at >= 0]]
        for i, m in zip(start[misses].tolist(), merged, strict=True):
            out[i : i + len(m)] = m
        return out, many

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each). Each distinct pre-token of the texts is looked up once."""
        cut = _cutter()
        known: dict[str, int] = {}
        codes: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                codes += [known.setdefault(p, len(known)) for p in cut(t)]
            ends.append(len(codes))
        ids, many = self.words(list(known))
        code = np.array(codes, np.int64)
        n = many[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        # the ids of a piece lie together: positions run on within a piece and jump between pieces
        start = (np.cumsum(many) - many)[code]
        at = np.repeat(start - upto[:-1], n) + np.arange(upto[-1])
        return ids[at], np.diff(upto[ends])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


@lru_cache(1)
def _cutter():
    import regex

    return regex.compile(PATTERN).findall


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> Encoder:
    return Encoder(load_ranks(name, path))


def encode_corpus(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of each whole text, without special tokens; strings of special tokens are text.

    A null text and an empty text have no ids: both give an empty list. Every row gives one row, repeated keys included.
    The vocabulary is read from ``path`` once, on the driver, and sent with its hash to the tasks: a vocabulary is of
    fixed size. No row is shuffled.
    """
    schema = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32()))])
    shared = texts.sparkSession.sparkContext.broadcast(encoder(vocabulary, path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for batch in batches:
            column = batch.column(1).to_pylist()
            # texts are taken together up to a number of characters, so that a batch of long ones stays small
            at = 0
            while at < len(column):
                to, size = at, 0
                while to < len(column) and (to == at or size < CHARACTERS):
                    size += len(column[to] or "")
                    to += 1
                ids, many = enc.encode_all(column[at:to])
                ends = np.concatenate([[0], np.cumsum(many)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], schema=schema)
                at = to

    out = texts.selectExpr(f"cast(`{key}` as bigint) as k", f"`{text}` as t").mapInArrow(work, "k bigint, ids array<int>")
    return out.withColumnRenamed("k", key)
