"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

Words are counted over all texts; two are near if one inserted, deleted or
replaced letter turns one into the other. Such an edit adds at most one letter to a
word's letter counts and takes at most one away, so the counts of near words are
at most 2 apart in L1; of words of one length exactly one up and one down (or
none), of words that differ by a letter in length one up and none down.

1. A k-d tree per word length, over letter counts, cuts the words into cells of
   about ``CELL``. It is fitted on about ``SAMPLE`` words (those of the smallest
   hashes), which decides how even the cells are and nothing else: every word is
   posted to its cell.
2. A word searches the trees of its own length and of the next one. A child whose
   box needs more letters added or taken than one edit can is pruned; the word is
   posted as a probe to every cell that remains. Of two cells of one length only the
   lower one's words probe the other, so a pair meets once.
3. Cells are dealt in blocks of at most ``LETTERS`` letters, probes likewise; every
   block meets every part of the probes, so one crowded cell (anagrams by the
   thousand have the same counts and can't be split) is many bounded tasks.
4. In a block a k-d tree of its own, down to ``LEAF`` words, is searched in the same
   way; what is left is verified on the letters in order.
5. Per word: the number of near words, and its form, the commonest of them if that
   is at least ``RATIO`` times as common. Forms are followed to the last by pointer
   doubling: counts double at every step, so a path has some 40 steps at most.

Defined results: null texts hold no words; a null doc_id takes no letter out;
repeated rows count again; words longer than any in the sample get one cell per
length, in blocks; of equally common near words the smallest in code-point order is the form;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import read

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST = 5
RAREST = 3
RATIO = 2
#: One in so many runs of a document loses a letter.
SLIP = 97
SAMPLE = 50_000
CELL = 16_384
LETTERS = 2_000_000
LEAF = 24
#: Letters compared at once.
STEP = 4_000_000
#: Dimension of a letter's byte (Latin-1): a to z, then the accented ones.
DIMENSION = np.zeros(256, np.int64)
DIMENSION[97:123] = np.arange(26)
DIMENSION[0xC0:0x100] = np.arange(26, 90)


def words(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (word, n): runs of letters, A to Z lower-cased, some
    without the letter that a checksum of document and run picks."""
    lowered = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    # one letter more than the shortest word could be cut to it
    hashed = runs.where(F.length("run") >= SHORTEST).withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word")
    return hashed.select(word).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def codes(texts: list[str]) -> np.ndarray:
    """Words of one length as a matrix of Latin-1 bytes."""
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), -1)


def counts(letters: np.ndarray) -> np.ndarray:
    """The letter counts of every row."""
    n, length = letters.shape
    places = DIMENSION[letters] + 90 * np.arange(n)[:, None]
    return np.bincount(places.ravel(), minlength=90 * n).reshape(n, 90).astype(np.int16 if length < 1 << 15 else np.int32)


class Tree:
    """A k-d tree: ``nodes`` holds (dimension, cut, left, right), leaves (-1, leaf, 0, 0);
    left are counts up to the cut. ``rows`` are the rows of each leaf."""

    def __init__(self, x: np.ndarray, size: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.rows: list[np.ndarray] = []
        self._grow(x, np.arange(len(x)), size)

    def _grow(self, x: np.ndarray, rows: np.ndarray, size: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, len(self.rows), 0, 0))
        spread = x[rows].astype(np.float32).var(axis=0) if len(rows) > size else np.zeros(1)
        if not spread.max() > 0:
            self.rows.append(rows)
            return at
        d = int(spread.argmax())
        values = x[rows, d]
        cut = min(int(np.median(values)), int(values.max()) - 1)
        left = self._grow(x, rows[values <= cut], size)
        right = self._grow(x, rows[values > cut], size)
        self.nodes[at] = (d, cut, left, right)
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to."""
        out = np.zeros(len(x), np.int64)
        for leaf, rows in self.search(x, 0, 0):
            out[rows] = leaf
        return out

    def search(self, x: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): the rows of x for which the leaf's box can hold counts of
        at most ``up`` letters more and ``down`` letters less."""
        zero = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)), zero, zero, {}, {})]
        while stack:
            node, rows, more, less, low, high = stack.pop()
            if not len(rows):
                continue
            d, cut, left, right = self.nodes[node]
            if d < 0:
                yield cut, rows
                continue
            v = x[rows, d].astype(np.int32)
            # what the box already needs in this dimension is not counted twice
            l2 = less + np.maximum(v - cut, 0) - (np.maximum(v - high[d], 0) if d in high else 0)
            m2 = more + np.maximum(cut + 1 - v, 0) - (np.maximum(low[d] - v, 0) if d in low else 0)
            a, b = l2 <= down, m2 <= up
            stack.append((left, rows[a], more[a], l2[a], low, high | {d: cut}))
            stack.append((right, rows[b], m2[b], less[b], low | {d: cut + 1}, high))


def _by_length(texts: list[str]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def fit(vocabulary: DataFrame) -> dict[int, Tree]:
    """A tree per word length, on about SAMPLE words: those whose hash falls below a
    share of its range (words are distinct, so their number is SAMPLE give or take
    its square root)."""
    total = vocabulary.count()
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(SAMPLE / max(total, 1) * (1 << 40))
    sample = sorted(r.word for r in vocabulary.where(share).select("word").collect())
    size = max(16, CELL * len(sample) // max(total, 1))
    trees = {}
    for length, rows in _by_length(sample).items():
        if len(rows) > size:
            trees[length] = Tree(counts(codes([sample[i] for i in rows])), size)
            trees[length].rows = []
    return trees


def posts(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, cell, probe, home, word, n): each word once as a member, and as a probe
    of every cell that can hold a near word; ``home`` marks probes of the own cell."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(trees)  # about SAMPLE / 8 nodes at most

    def emit(parts):
        for part in parts:
            texts = part.column(0).to_pylist()
            out = []  # (length, cells, probe, home, rows)
            for length, rows in _by_length(texts).items():
                x = counts(codes([texts[i] for i in rows]))
                every = [(0, np.arange(len(rows)))]
                own, longer = shared.value.get(length), shared.value.get(length + 1)
                cell = own.place(x) if own else np.zeros(len(rows), np.int64)
                out.append((length, cell, False, False, rows))
                for leaf, found in own.search(x, 1, 1) if own else every:
                    for home, some in ((True, found[cell[found] == leaf]), (False, found[cell[found] < leaf])):
                        out.append((length, np.full(len(some), leaf), True, home, rows[some]))
                for leaf, found in longer.search(x, 1, 0) if longer else every:
                    out.append((length + 1, np.full(len(found), leaf), True, False, rows[found]))
            if out:
                rows = np.concatenate([o[-1] for o in out])
                each = lambda i: np.repeat([o[i] for o in out], [len(o[-1]) for o in out])  # noqa: B023, E731
                cells = pa.array(np.concatenate([o[1] for o in out]).astype(np.int32))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(each(0).astype(np.int32)), cells, pa.array(each(2)), pa.array(each(3)), taken.column(0), taken.column(1)],
                    ["length", "cell", "probe", "home", "word", "n"],
                )

    return vocabulary.select("word", "n").mapInArrow(emit, "length int, cell int, probe boolean, home boolean, word string, n long")


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a differ from which rows of b in exactly one place."""
    out = np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        out += a[:, i, None] != b[None, :, i]
    return out == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of b are a row of a with one letter more: a common beginning and a
    common end that cover the shorter word."""
    begin = np.zeros((len(a), len(b)), np.int32)
    end = np.zeros((len(a), len(b)), np.int32)
    for done, places, shift in ((begin, range(a.shape[1]), 0), (end, range(a.shape[1] - 1, -1, -1), 1)):
        alike = np.ones((len(a), len(b)), bool)
        for i in places:
            alike &= a[:, i, None] == b[None, :, i + shift]
            if not alike.any():
                break
            done += alike
    return begin + end >= a.shape[1]


def _meet(members: pa.Table, probes: pa.Table) -> pa.Table:
    """Near pairs between a block of a cell and a part of its probes, in both directions."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if members.num_rows and probes.num_rows:
        have, ask = members["word"].to_pylist(), probes["word"].to_pylist()
        home = probes["home"].to_numpy()
        names, asks = np.array(have, object), np.array(ask, object)
        letters = codes(have)
        tree = Tree(counts(letters), LEAF)
        for length, rows in _by_length(ask).items():
            same = length == letters.shape[1]
            asked = codes([ask[i] for i in rows])
            near = _one_replaced if same else _one_inserted
            for leaf, found in tree.search(counts(asked), 1, int(same)):
                here = tree.rows[leaf]
                step = max(1, STEP // len(here))
                for lo in range(0, len(found), step):
                    a, b = np.nonzero(near(asked[found[lo : lo + step]], letters[here]))
                    a, b = rows[found[lo + a]], here[b]
                    # two words of one cell meet twice, from either side
                    once = ~home[a] | (asks[a] < names[b])
                    left.append(a[once])
                    right.append(b[once])
    p, m = probes.take(np.concatenate(left)), members.take(np.concatenate(right))
    both = lambda one, two: pa.chunked_array([*one.chunks, *two.chunks], one.type)
    return pa.table({"word": both(p["word"], m["word"]), "near": both(m["word"], p["word"]), "near_n": both(m["n"], p["n"])})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (word, n), one row per word -> (word, near, near_n), both ways."""
    posted = materialize(posts(vocabulary, fit(vocabulary)), "spelling-posts")
    # one row per cell that has members and probes
    cells = posted.groupBy("length", "cell").agg(F.count_if(~F.col("probe")).alias("m"), F.count_if("probe").alias("p")).where("m > 0 and p > 0")
    parts = lambda n: F.ceil(F.col(n) * F.col("length") / LETTERS).cast("int")
    cuts = materialize(cells.select("length", "cell", parts("m").alias("b"), parts("p").alias("c")), "spelling-cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    dealt = posted.join(cuts, ["length", "cell"])
    # aliases, as both sides come from one table
    deal = lambda rows, block, part: rows.select(
        block.alias("block"), part.alias("part"), *[F.col(c).alias(c) for c in ("length", "cell", "home", "word", "n")]
    ).groupBy("length", "cell", "block", "part")
    members = deal(dealt.where(~F.col("probe")), own("b"), every("c"))
    probes = deal(dealt.where("probe"), every("b"), own("c"))
    return members.cogroup(probes).applyInArrow(_meet, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form), no cycles -> (word, root): forms followed to the last.
    Every round doubles the distance; rows at their root only wait."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        at = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (word, n) -> (word, form, root, n, n_near, form_n)."""
    met = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    common = -F.col("best.minus_n") >= RATIO * F.col("n")
    formed = materialize(
        vocabulary.join(met, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.minus_n")).alias("form_n")
        ),
        "spelling-forms",
    )
    last = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(materialize(words(docs), "spelling-words"))
