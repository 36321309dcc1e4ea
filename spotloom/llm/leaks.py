"""Evaluation passages inside training text.

The corpus becomes a positional inverted index that is kept, distributed by document: each row is the postings of one part
of the corpus, every term with the places at which it stands in the part's running text. It is written once, and any number
of searches read it without the texts. A phrase is looked up by intersecting its terms' lists, each moved back by the term's
place in the phrase, from the rarest term on; most phrases end at an empty list. Proximity starts from the places of an
item's rarest terms, of which any match must hold one. The items are sent to the parts in blocks of bounded size; postings
are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm.canonical import fold_signs, reading_state, use_state, word_patterns
from spotloom.session import durable

#: Consecutive words that make a leak, and about how many words of documents and of items one part and one block take.
WORDS = 10
PART_TOKENS = 1_000_000
BLOCK_TOKENS = 2_000_000

_PLAIN = re.compile(r"[a-z0-9]+")
_HIGH = re.compile("[\U00010000-\U0010ffff]").search

INDEX = "part bigint, docs array<bigint>, starts array<int>, terms array<string>, ends array<int>, places array<int>"


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits, as they read, in one case."""
    if text.isascii() and text.isprintable():
        return _PLAIN.findall(text.lower())
    folded = fold_signs(text)
    low, full = _terms()
    return (full if _HIGH(folded) else low)(folded)


@lru_cache(1)
def _terms():
    return tuple(re.compile(p).findall for p in word_patterns())


def positional_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of a corpus, a row per part: (part, docs, starts, terms, ends, places).

    ``docs`` are the part's documents and ``starts`` their first places; the places of term i are ``places`` from
    ``ends[i]`` up to ``ends[i + 1]``, ascending. A place is left free after each document. All words of whole texts are
    held; null texts and null ids are not. A part ends at PART_TOKENS words, or with the one document that is longer.
    """
    corpus = docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).where("t is not null and d is not null")
    state = docs.sparkSession.sparkContext.broadcast(reading_state())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_state(state.value)
        made = 0
        ids: list[int] = []
        starts: list[int] = []
        codes: list[int] = []
        known: dict[str, int] = {}

        def part() -> pa.RecordBatch:
            code = np.array(codes, np.int32)
            place = np.flatnonzero(code >= 0)
            order = place[np.argsort(code[place], kind="stable")]
            ends = np.searchsorted(code[order], np.arange(len(known) + 1))
            number = (TaskContext.get().partitionId() << 32) + made
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            cols = [pa.array([number], pa.int64()), one(ids, pa.int64()), one(starts, pa.int32()), one(list(known), pa.string()), one(ends, pa.int32()), one(order, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, ["part", "docs", "starts", "terms", "ends", "places"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                starts.append(len(codes))
                codes += [known.setdefault(w, len(known)) for w in words_of(t)]
                codes.append(-1)
                if len(codes) > PART_TOKENS:
                    yield part()
                    made += 1
                    ids, starts, codes, known = [], [], [], {}
        if ids:
            yield part()

    return corpus.mapInArrow(build, INDEX)


class Part:
    """One part of the index, seen through the terms of a block of items."""

    def __init__(self, row: dict[str, pa.Array], terms: pa.Array):
        self.docs, self.starts = (row[c].to_numpy(zero_copy_only=False) for c in ("docs", "starts"))
        ends = row["ends"].to_numpy(zero_copy_only=False)
        self.places = row["places"].to_numpy(zero_copy_only=False)
        at = pc.index_in(row["terms"], value_set=terms)
        own = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        term = at.drop_null().to_numpy(zero_copy_only=False)
        self.lo, self.hi = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        self.lo[term], self.hi[term] = ends[own], ends[own + 1]
        self.sizes = self.hi - self.lo

    def list(self, term: int) -> np.ndarray:
        return self.places[self.lo[term] : self.hi[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Places at which the terms stand one after another: lists intersected from the rarest on."""
        at = None
        for k in np.argsort(self.sizes[terms], kind="stable"):
            own = self.list(terms[k]) - k
            at = own if at is None else at[_among(at, own)]
            if not len(at):
                return at
        return at

    def near(self, terms: np.ndarray, need: int, span: int) -> np.ndarray:
        """Places of the first terms at which ``span`` consecutive words of a document hold ``need`` of the distinct terms.

        ``terms``: rarest first. A match lacks at most len(terms) - need of them, so it holds one of one more than that.
        """
        first = [self.list(t) for t in terms[: len(terms) - need + 1]]
        at = np.unique(np.concatenate(first)) if first else np.empty(0, np.int64)
        if not len(at) or (self.sizes[terms] > 0).sum() < need:
            return at[:0]
        d = np.searchsorted(self.starts, at, "right") - 1
        lo = np.maximum(at - span + 1, self.starts[d])
        hi = np.minimum(at + span, np.r_[self.starts[1:], 2**31 - 1][d])
        spans = [(own := self.list(t), np.searchsorted(own, lo), np.searchsorted(own, hi)) for t in terms]
        seen = np.sum([b > a for _, a, b in spans], axis=0)
        keep = [i for i in np.flatnonzero(seen >= need).tolist() if _fits([own[a[i] : b[i]] for own, a, b in spans], need, span)]
        return at[keep]

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.unique(self.docs[np.searchsorted(self.starts, places, "right") - 1])


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's values stand in the sorted b."""
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return b[i] == a


def _fits(spots: list[np.ndarray], need: int, span: int) -> bool:
    """Whether a window of ``span`` holds a place of ``need`` of the lists."""
    flat = np.concatenate(spots)
    who = np.repeat(np.arange(len(spots)), [len(s) for s in spots])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order].tolist(), who[order].tolist()
    have: dict[int, int] = {}
    lo = 0
    for hi in range(len(flat)):
        have[who[hi]] = have.get(who[hi], 0) + 1
        while flat[hi] - flat[lo] >= span:
            have[who[lo]] -= 1
            if not have[who[lo]]:
                del have[who[lo]]
            lo += 1
        if len(have) >= need:
            return True
    return False


class Block:
    """Items of a bounded number of characters, as lists of term numbers."""

    def __init__(self, items: list[tuple[int, str]]):
        known: dict[str, int] = {}
        self.items = [(i, np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int32)) for i, t in items]
        self.terms = pa.array(list(known), pa.string())

    def phrases(self, width: int) -> tuple[np.ndarray, list[list[int]]]:
        """All phrases of ``width`` words, and the items in which each stands."""
        seen: dict[tuple[int, ...], set[int]] = {}
        for i, ids in self.items:
            for k in range(len(ids) - width + 1):
                seen.setdefault(tuple(ids[k : k + width].tolist()), set()).add(i)
        return np.array(list(seen), np.int32).reshape(len(seen), width), [sorted(x) for x in seen.values()]


def _item_blocks(items: DataFrame, item: str, text: str) -> Iterator[Block]:
    """The items in blocks of a bounded number of characters, so that what is sent to each task is bounded."""
    held, size = [], 0
    for r in items.select(F.col(item).cast("bigint"), text).where(f"`{text}` is not null and `{item}` is not null").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size > 5 * BLOCK_TOKENS:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _parts(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[Part]:
    for b in batches:
        for i in range(b.num_rows):
            yield Part({c: b.column(c)[i].values for c in ("docs", "starts", "terms", "ends", "places")}, terms)


def _search(index: DataFrame, blocks: Iterator[tuple[Block, object]], look) -> DataFrame:
    out = None
    for block, query in blocks:
        shared = index.sparkSession.sparkContext.broadcast((block.terms, query))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, query = shared.value
            for part in _parts(batches, terms):
                rows = sorted(look(part, query))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "item_id"])

        found = index.mapInArrow(work, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()


def find_phrases(index: DataFrame, items: DataFrame, width: int = WORDS, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents of the index that hold ``width`` or more consecutive words of the item, in order.

    Case, what stands between words, invisible characters and look-alikes do not matter. Null and empty texts leak
    nothing, items of fewer words cannot leak. Copies of documents are found each by itself; repeated rows once.
    """

    def look(part: Part, query) -> set[tuple[int, int]]:
        phrases, owners = query
        hits = set()
        for k in np.flatnonzero((part.sizes[phrases] > 0).all(1)) if len(phrases) else ():
            places = part.phrase(phrases[k])
            if len(places):
                hits |= {(int(d), i) for d in part.documents(places) for i in owners[k]}
        return hits

    return _search(index, ((b, b.phrases(width)) for b in _item_blocks(items, item, item_text)), look)


def term_counts(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How often each of a bounded number of terms stands in the corpus: one row per part and term is added up."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for part in _parts(batches, shared.value):
            total += part.sizes
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def find_near(index: DataFrame, items: DataFrame, share: float = 0.8, stretch: float = 1.5, least: int = 5, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents in which ``share`` of the item's distinct words stand close together, in any order:
    within as many consecutive words as the item has, times ``stretch``. A looser sign of a leak than a phrase.

    All words of the item count. The search starts from its rarest words, by their number in the whole corpus; as a match
    may lack the others only up to a number, nothing is missed. Items of fewer than ``least`` distinct words match nothing.
    """

    def queries():
        for block in _item_blocks(items, item, item_text):
            rarity = term_counts(index, block.terms)
            query = []
            for i, ids in block.items:
                own = np.unique(ids)
                if len(own) >= least:
                    order = own[np.argsort(rarity[own], kind="stable")]
                    query.append((i, order, math.ceil(share * len(own) - 1e-9), math.ceil(stretch * len(ids) - 1e-9)))
            yield block, query

    def look(part: Part, query) -> set[tuple[int, int]]:
        return {(int(d), i) for i, terms, need, span in query for d in part.documents(part.near(terms, need, span))}

    return _search(index, queries(), look)


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WORDS, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``find_phrases`` over an index made of ``docs`` and kept for all blocks of items."""
    return find_phrases(durable(positional_index(docs, doc, text)), items, width, item, item_text)


def find_proximity(docs: DataFrame, items: DataFrame, share: float = 0.8, stretch: float = 1.5, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``find_near`` over an index made of ``docs`` and kept for all blocks of items."""
    return find_near(durable(positional_index(docs, doc, text)), items, share, stretch, item=item, item_text=item_text)
