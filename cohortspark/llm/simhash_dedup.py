"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits from the XXH64 hashes of word shingles. Two texts are
linked when their fingerprints differ in at most ``max_distance`` bits;
documents joined by a path of links form one class.

Finding the links of the distinct fingerprints (general pigeonhole: with m
parts and thresholds t1..tm that sum to max_distance - m + 1, any two
fingerprints within max_distance agree to within t_i in some part i; a
threshold of -1 leaves a part out):

1. the 64 x 64 bit covariances, summed over all fingerprints, group
   correlated bits into one part each;
2. a histogram of every part (a fixed number of hash cells, so its size is
   bounded whatever the data) gives an upper bound on the candidates that a
   fingerprint meets in a part at each threshold;
3. per fingerprint, dynamic programming allocates the thresholds with the
   smallest total; the fingerprint probes those parts at those radii and every
   candidate is verified on all 64 bits;
4. a fingerprint whose cheapest allocation would still meet more than
   ``max_candidates`` candidates (near copies by the thousand, which share
   every part) takes an exact way for crowds: it is posted under every value
   within half the distance of it. Two fingerprints within the distance meet
   under a common value, those that meet are within the distance, and at most
   65 distinct fingerprints (distance 2) can meet under one value, so linking
   each to one of them loses nothing and no pairs are expanded.

A link between a crowd fingerprint and another is found by the other's
probes. So each fingerprint costs a bounded number of rows, and all links are
kept.

Defined results: null text counts as empty; a text without words has
fingerprint 0 and links like any other; repeated rows and repeated doc_ids
each keep their row; a null doc_id keeps its row and is never a class id
unless all of its class are null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text
from .graph import components

BITS = 64
#: Unpacked at once: shingles whose 64 bits are counted in one numpy step.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words: of
    the whole sequence; no words: none. Words: runs without 0x20, 0x09-0x0D."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(k, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, stops)), np.uint64, len(stops))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; fp is the fingerprint as a
    signed long."""

    def compute(parts):
        for part in parts:
            texts = part.column(2).cast(pa.large_binary())
            out = np.fromiter((simhash(shingle_hashes(t.as_py(), k)) for t in texts), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(fps: DataFrame, parts: int) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of nearly equal size, correlated bits
    together. Only a 65 x 64 table of sums per task leaves the executors."""

    def sums(batches_):
        total = np.zeros((BITS + 1, BITS), np.int64)
        n = 0
        for part in batches_:
            x = _bits(part.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total[:BITS] += np.rint(x.T @ x).astype(np.int64)
            total[BITS] += x.sum(axis=0).astype(np.int64)
            n += len(x)
        rows = [(r * BITS + c, int(total[r, c])) for r in range(BITS + 1) for c in range(BITS)] + [((BITS + 1) * BITS, n)]
        yield pa.RecordBatch.from_pydict({"cell": [c for c, _ in rows], "v": [v for _, v in rows]})

    cells = {r["cell"]: r["v"] for r in fps.mapInArrow(sums, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    n = max(1, cells.get((BITS + 1) * BITS, 0))
    table = np.array([cells.get(i, 0) for i in range((BITS + 1) * BITS)], float).reshape(BITS + 1, BITS) / n
    mean = table[BITS]
    cov = table[:BITS] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    like = np.abs(cov / np.outer(spread, spread))
    sizes = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    free, groups = set(range(BITS)), []
    for size in sizes:
        rest = sorted(free)
        group = [max(rest, key=lambda b: (like[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            b = max(sorted(free), key=lambda x: (like[x, group].sum(), -x))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    u = fps.view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for i, b in enumerate(group):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _ball(width: int, radius: int, at_least: int = 0) -> np.ndarray:
    """Masks of ``width`` bits with at_least..radius ones."""
    return np.array([sum(1 << b for b in c) for r in range(max(0, at_least), radius + 1) for c in combinations(range(width), r)], np.uint64)


class Allocation:
    """Thresholds per fingerprint from bounded part histograms."""

    def __init__(self, groups: list[list[int]], max_distance: int, cell_bits: int, max_candidates: int, counts: np.ndarray | None = None):
        self.groups, self.radius, self.cell_bits, self.most, self.counts = groups, max_distance, cell_bits, max_candidates, counts
        self.sum = max_distance - len(groups) + 1
        if self.sum < -len(groups):
            raise ValueError("too many parts for this distance")

    def cells(self, values: np.ndarray) -> np.ndarray:
        """The histogram cell of each part value (several values may share one)."""
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.cell_bits)).astype(np.int64)

    def plan(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, thresholds by part) of the cheapest allocation of each fingerprint."""
        m, n = len(self.groups), len(fps)
        cost = np.zeros((m, self.radius + 2, n))  # at threshold - 1
        for i, g in enumerate(self.groups):
            v = _values(fps, g)
            for t in range(self.radius + 1):
                ring = _ball(len(g), t, t)
                cost[i, t + 1] = cost[i, t] + len(ring)
                for mask in ring:
                    cost[i, t + 1] += self.counts[i][self.cells(v ^ mask)]
        # best[s]: cheapest way for the parts so far with thresholds that sum to s - parts
        best, ways = [np.zeros(n)], []
        for i in range(m):
            grown = [np.full(n, np.inf) for _ in range(len(best) + self.radius + 1)]
            way = [np.zeros(n, np.int64) for _ in grown]
            for s, b in enumerate(best):
                for t in range(self.radius + 2):
                    c = b + cost[i, t]
                    better = c < grown[s + t]
                    grown[s + t] = np.where(better, c, grown[s + t])
                    way[s + t] = np.where(better, t, way[s + t])
            best = grown
            ways.append(way)
        s = np.full(n, self.sum + m)
        total, chosen = best[self.sum + m], np.zeros((n, m), np.int64)
        for i in reversed(range(m)):
            chosen[:, i] = np.array(ways[i])[s, np.arange(n)]
            s = s - chosen[:, i]
        return total, chosen - 1


def links(fps: DataFrame, max_distance: int = 2, parts: int = 3, cell_bits: int = 18, max_candidates: int = 256) -> DataFrame:
    """``fps`` (fp: distinct longs) -> (a, b): links that join exactly the
    fingerprints joined by paths of differences of at most ``max_distance``."""
    if max_distance < 1:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    alloc = Allocation(bit_groups(fps, parts), max_distance, cell_bits, max_candidates)

    def cell_counts(batches_):
        total = np.zeros((parts, 1 << cell_bits), np.int64)
        for part in batches_:
            f = part.column(0).to_numpy(zero_copy_only=False)
            for i, g in enumerate(alloc.groups):
                total[i] += np.bincount(alloc.cells(_values(f, g)), minlength=1 << cell_bits)
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["cell", "v"])

    # at most parts * 2^cell_bits counts, whatever the data
    found = fps.mapInArrow(cell_counts, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    counts = np.zeros(parts << cell_bits, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    alloc.counts = counts.reshape(parts, 1 << cell_bits)
    whole = _ball(BITS, (max_distance + 1) // 2)
    near = np.bitwise_count(whole).astype(np.int64)

    def keys(part_no: int, values: np.ndarray) -> np.ndarray:
        return (values | np.uint64(part_no << 58)).view(np.int64)

    def posted(batches_):
        """kind 0: in a part's index; 1: a probe of it; 2: under a value near a crowd fingerprint."""
        for part in batches_:
            for at in range(0, part.num_rows, 4096):
                f = part.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                cost, chosen = alloc.plan(f)
                crowd = cost > max_candidates
                out = []
                for i, g in enumerate(alloc.groups):
                    v = _values(f, g)
                    seen = alloc.counts[i][alloc.cells(v)] <= max_candidates  # else no probe comes here
                    out.append((0, keys(i, v[seen]), f[seen], None))
                    for t in range(max_distance + 1):
                        own = ~crowd & (chosen[:, i] == t)
                        ball = _ball(len(g), t)
                        out.append((1, keys(i, (v[own, None] ^ ball[None, :]).reshape(-1)), np.repeat(f[own], len(ball)), None))
                c = f[crowd]
                out.append((2, (c.view(np.uint64)[:, None] ^ whole[None, :]).reshape(-1).view(np.int64), np.repeat(c, len(whole)), np.tile(near, len(c))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _, _ in out])),
                        pa.array(np.concatenate([k for _, k, _, _ in out])),
                        pa.array(np.concatenate([x for _, _, x, _ in out])),
                        pa.array(np.concatenate([np.zeros(len(k), np.int64) if d is None else d for _, k, _, d in out])),
                    ],
                    ["kind", "key", "fp", "d"],
                )

    posts = materialize(fps.mapInArrow(posted, "kind int, key long, fp long, d long"), "simhash-posts")
    index = posts.where("kind = 0").select("key", F.col("fp").alias("b"))
    probes = posts.where("kind = 1").select("key", F.col("fp").alias("a"))
    verified = probes.join(index, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")
    met = posts.where("kind = 2").groupBy("key").agg(F.collect_list(F.struct("d", "fp")).alias("all")).where(F.size("all") > 1)
    first = met.select(F.array_min("all").alias("c"), F.explode("all").alias("o"))
    crowd = first.where(F.col("c.d") + F.col("o.d") <= max_distance).select(F.col("c.fp").alias("a"), F.col("o.fp").alias("b")).where("a <> b")
    return verified.union(crowd)


def classified(docs: DataFrame, k: int, max_distance: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): one row per document; root
    names its class by a fingerprint."""
    rows = materialize(fingerprints(docs, k), "simhash-fps")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    joined = components(links(classes.select("fp"), max_distance))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the
    smallest doc_id that paths of links reach."""
    return classified(docs, k, max_distance).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """One document of each class, as it is: the one with the smallest doc_id
    (null last), of those the one with the smallest text hash; of rows that
    agree in both, one."""
    rows = materialize(classified(docs, k, max_distance).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "simhash-members")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "n")).alias("b")).select("b.*")
    best = materialize(best, "simhash-kept")
    at = lambda d, kept: d["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (F.xxhash64(F.coalesce(d["text"].cast("string"), F.lit(""))) == kept["text_hash"])
    single, repeated = best.where("n = 1"), best.where("n > 1")
    out = docs.join(single, at(docs, single), "left_semi")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, at(docs, repeated), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keys = [F.col("doc_id").cast("long").alias("k1"), F.xxhash64(whole_text()).alias("k2")]
    return out.unionByName(again.groupBy(*keys).agg(F.first(row).alias("row")).select("row.*"))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"), 3, 2).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
