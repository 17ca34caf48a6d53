"""Benchmark decontamination by SimHash over item-sized windows.

Words are the lower-cased alphanumeric runs of a text. An item is its bag of
word shingles (``k`` words; an item of fewer words is one shingle of all), each
shingle weighing its number of occurrences. A document is contaminated by an
item if one of its windows of as many words as the item has a weighted Jaccard
similarity (sum of minima over sum of maxima) of at least ``threshold``.

1. Windows. Every window position of every whole text is considered, in the sizes of
   the items. A window can only reach the threshold for some item if its shingles
   that the item also has number at least threshold / (1 + threshold) * (their
   sizes together); running counts of such shingles rule out the other windows
   without loss, and windows next to each other with the same such shingles count
   as the first of them. This decides which windows are fingerprinted, not which
   items they are compared with.
2. SimHash. 64 bits from the window's weighted shingles; the bit sums of all windows
   of a text are differences of one running sum. Fingerprints within ``radius``
   bits are found by a multi-index: the bits are cut into blocks of width
   64 / blocks, and two fingerprints within the radius agree to within
   radius // blocks bits in some block, so probing each block's values to that
   distance finds all of them.
3. Exact check. The items found so whose size is the window's are verified by the
   weighted similarity.

Items and their shingles reach the tasks in blocks of at most ``ITEM_BLOCK``
items, so the memory of a task is bounded; each block is one pass over the
documents (a benchmark has a stated size: one block here). Each row is judged
where it is read: nothing of the documents is shuffled, so a hot source or
group of copies stays spread as the input is.

Defined results: null texts count as empty; items without words match nothing;
empty documents or benchmarks give no matches; repeated items each match;
repeated documents each give their rows; of windows equally similar, the first
is reported; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, whole_text
from .simhash_dedup import simhash

K, THRESHOLD = 5, 0.8
#: Two windows of similarity 0.8 differ in about 64 * arccos(0.89) / pi = 10 bits; the radius is that and five standard deviations.
RADIUS, BLOCKS = 24, 8
ITEM_BLOCK = 20_000
#: Windows that are looked up at once, and how far apart they begin at most to share their bit sums.
AT_ONCE, RUN = 256, 1 << 14

_WORD = re.compile(r"[^\W_]+")
MATCH = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def fingerprint(shingles: list[str]) -> np.uint64:
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    return np.uint64(simhash(hashes) & 0xFFFFFFFFFFFFFFFF)


class Items:
    """Benchmark items compiled for scanning."""

    def __init__(self, items: Iterable[tuple[int, str]], k: int, threshold: float, radius: int, blocks: int):
        self.threshold, self.radius, self.blocks, self.width = threshold, radius, blocks, 64 // blocks
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, int, int, Counter]] = []  # (item_id, words, shingle length, bag of shingles)
        self.by_length: dict[int, dict[tuple, list[int]]] = {}  # shingle length -> shingle -> numbers of items
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(k, len(ids))
            bag = Counter(tuple(ids[i : i + size]) for i in range(len(ids) - size + 1))
            for shingle in bag:
                self.by_length.setdefault(size, {}).setdefault(shingle, []).append(len(self.items))
            self.items.append((item_id, len(ids), size, bag))
        word_of = {i: w for w, i in self.vocabulary.items()}
        bags = ([" ".join(word_of[i] for i in s) for s in bag.elements()] for *_, bag in self.items)
        self.prints = np.array([fingerprint(b) for b in bags], np.uint64)
        # per block its distinct values, where their items begin in the third array, the items
        self.index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(blocks):
            values = self.block(self.prints, b)
            order = np.argsort(values, kind="stable")
            distinct, first = np.unique(values[order], return_index=True)
            self.index.append((distinct, np.append(first, len(order)), order))
        self.ball = np.array([sum(1 << x for x in c) for r in range(radius // blocks + 1) for c in combinations(range(self.width), r)], np.uint64)

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def within_all(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, number of the item): all pairs within the radius, found
        through the blocks, once each."""
        pairs = [np.empty((0, 2), np.int64)]
        for b, (values, starts, items) in enumerate(self.index):
            probes = (self.block(prints, b)[:, None] ^ self.ball[None, :]).ravel()
            at = np.searchsorted(values, probes)
            hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == probes)
            first, many = starts[at[hit]], starts[at[hit] + 1] - starts[at[hit]]
            turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(hit // len(self.ball), many), items[np.repeat(first, many) + turn]], axis=1))
        met = np.unique(np.concatenate(pairs), axis=0)
        near = np.bitwise_count(prints[met[:, 0]] ^ self.prints[met[:, 1]]) <= self.radius
        return met[near, 0], met[near, 1]

    def scan(self, text: str) -> Iterator[tuple[int, int, int, float, int]]:
        """(item_id, start, words, similarity, distance): the best window of each matching item."""
        words = words_of(text)
        if not words or not self.items:
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids)
        for size, shingles in self.by_length.items():
            if len(known) < size:
                continue
            # runs of known words: a shingle of an item has no other words
            ends = known[size - 1 :]
            at = known[: len(known) - size + 1][ends - known[: len(known) - size + 1] == size - 1]
            hits: dict[int, list[int]] = {}
            for s in at.tolist():
                for item in shingles.get(tuple(ids[s : s + size].tolist()), ()):
                    hits.setdefault(item, []).append(s)
            lengths: dict[int, list[np.ndarray]] = {}
            for item, starts in hits.items():
                length = min(self.items[item][1], len(ids))  # a text shorter than the item is one window
                lengths.setdefault(length, []).append(self.windows(item, np.array(starts), length, len(ids)))
            for length, kept in lengths.items():
                starts = np.unique(np.concatenate(kept))
                if len(starts):
                    yield from self.verified(starts, length, size, words, ids)

    def windows(self, item: int, starts: np.ndarray, length: int, n: int) -> np.ndarray:
        """Where windows of that length begin that can reach the threshold for the
        item, whose shingles begin at ``starts`` in the text of n words."""
        _, _, size, bag = self.items[item]
        own, other = sum(bag.values()), length - size + 1
        # shared weight s gives s / (own + other - s): at least threshold only from here on
        least = self.threshold / (1 + self.threshold) * (own + other) - 1e-9
        # the number of shared shingles changes only where a window takes in or leaves one
        first = np.unique(np.clip(np.concatenate([starts, starts - other + 1, starts + 1, starts - other]), 0, n - length))
        count = np.searchsorted(starts, first + other) - np.searchsorted(starts, first)
        return first[count >= least]

    def verified(self, starts: np.ndarray, length: int, size: int, words: list[str], ids: np.ndarray) -> Iterator[tuple[int, int, int, float, int]]:
        """Of the windows of that length at ``starts``, the best for each item that is
        within the radius and verified."""
        other = length - size + 1
        best: dict[int, tuple] = {}
        for lo in range(0, len(starts), AT_ONCE):
            part = starts[lo : lo + AT_ONCE]
            prints = window_prints(words, part, size, other)
            last, window = -1, Counter()
            for w, item in zip(*(x.tolist() for x in self.within_all(prints))):  # by window, so of equals the first stays
                item_id, n, own, bag = self.items[item]
                if own != size or min(n, len(ids)) != length:
                    continue
                s = int(part[w])
                if w != last:
                    last, window = w, Counter(tuple(ids[i : i + size].tolist()) for i in range(s, s + other))
                similarity = weighted_jaccard(bag, window)
                if similarity >= self.threshold - 1e-12 and (item not in best or similarity > best[item][3]):
                    best[item] = (item_id, s, length, similarity, int(np.bitwise_count(prints[w] ^ self.prints[item])))
        yield from best.values()


def window_prints(words: list[str], starts: np.ndarray, size: int, other: int) -> np.ndarray:
    """SimHash of the windows of ``other`` shingles at the sorted ``starts``: a bit is 1
    if it is set in over half of the shingles."""
    out = np.empty(len(starts), np.uint64)
    # windows that overlap share their shingles' running bit sums, a bounded number at a time
    ends = np.flatnonzero((np.diff(starts) >= other) | (starts[1:] // RUN != starts[:-1] // RUN)) + 1
    for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(starts)]):
        begin, end = int(starts[lo]), int(starts[hi - 1]) + other
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(begin, end)), "<u8", end - begin)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        at = starts[lo:hi] - begin
        out[lo:hi] = np.packbits((sums[at + other] - sums[at]) * 2 > other, axis=1, bitorder="little").view("<u8").ravel()
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def item_blocks(benchmark: DataFrame, k: int, threshold: float, radius: int, blocks: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``ITEM_BLOCK`` items, dealt by hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    n = max(1, -(-rows.count() // ITEM_BLOCK))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Items([(r["item_id"], r["text"]) for r in part], k, threshold, radius, blocks)


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance): one row per
    document and item that contaminates it, with the best window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = None
    for items in item_blocks(benchmark, k, threshold, radius, blocks):

        def scan(parts, items=items):
            for part in parts:
                ids, texts = part.column(0), part.column(1)
                out = [(i.as_py(), *m) for i, t in zip(ids, texts) for m in items.scan(t.as_py())]
                names = ["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"]
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

        part = rows.mapInArrow(scan, MATCH)
        found = part if found is None else found.union(part)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The documents that no item contaminates, as they are."""
    for items in item_blocks(benchmark, k, threshold, radius, blocks):
        hit = F.pandas_udf(lambda texts, items=items: pd.Series([next(items.scan(t), None) is not None for t in texts], dtype=bool), "boolean")
        docs = docs.where(~hit(whole_text()))
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
