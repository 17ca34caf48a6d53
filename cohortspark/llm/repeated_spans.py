"""Exact repeated byte strings of at least ``length`` bytes, across documents.

A byte is removed if a ``length``-byte string that covers it also starts
anywhere else, in the same document or another; matches never cross documents.

1. Anchors. The anchor of a start s is the smallest (of equals the first) hash of
   a ``GRAM``-byte string within the window text[s : s + length]. It depends on
   the window alone, so equal windows have equal anchors at equal offsets.
   Neighbouring starts share an anchor: each document becomes runs of starts.
   Runs whose anchor occurs once in the corpus hold no repeated window.
2. Refinement. Starts of one anchor are told apart in three rounds, by ever
   shorter intervals: whole runs, blocks of ``STEP`` offsets from the anchor,
   single windows. The text that an interval's windows span together decides at
   once: if it repeats, all its windows repeat. The text that they have in common
   rules out at once: if it does not repeat, none does. Only intervals between
   the two go to the next round, one representative of each equal text.
3. Removal. A document's repeated starts are merged to spans.

Texts are compared by 128-bit hashes. Each round is an aggregation of hashes with
partial sums, so a string that a third of all documents share is one row per
task; no pairs are expanded. The texts are written once, compressed, in buckets
by row, and are never shuffled.

Defined results: null text counts as empty; texts shorter than ``length`` keep
all bytes; exact copies lose all bytes that such strings cover in every copy;
repeated rows count as documents of their own; null doc_ids keep their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bucketed, read, whole_text

LENGTH = 400
GRAM = 64
STEP = 32
#: Texts hashed at a time in the anchor step, bytes.
PIECE = 1 << 22


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each ``gram``-byte string (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    n, factor = 1, 0x9E3779B97F4A7C15
    while n < gram:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` neighbours."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchor_runs(text: bytes, length: int, gram: int):
    """(first start, last start, anchor position, anchor hash) of each run, in order."""
    starts, w = len(text) - length + 1, length - gram + 1
    for base in range(0, max(0, starts), PIECE):
        own = min(PIECE, starts - base)
        data = np.frombuffer(text, np.uint8, own + length - 1, base)
        h = gram_hashes(data, gram)
        least = window_minima(h, w)
        cut = np.flatnonzero((least[1:] != least[:-1]) | (h[: own - 1] == least[:-1])) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [own]]) - 1
        for a, b in zip(first.tolist(), last.tolist()):
            value = least[a]
            # the anchor is in every window of the run
            m = b + int(np.argmax(h[b : a + w] == value))
            yield base + a, base + b, base + m, int(value.astype(np.int64))


def _key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _texts(parts, size: int = 20_000):
    """(row of other columns, text) of batches whose last column is the packed text."""
    for part in parts:
        others = [part.column(i).to_pylist() for i in range(part.num_columns - 1)]
        for i in range(part.num_rows):
            yield [c[i] for c in others], zstandard.decompress(part.column(part.num_columns - 1)[i].as_py())


def _emit(parts, schema: pa.Schema, rows_of, size: int = 20_000):
    """Batches of about ``size`` rows from rows_of(columns, text)."""
    held: list[tuple] = []
    for columns, text in _texts(parts):
        for row in rows_of(columns, text):
            held.append(row)
            if len(held) >= size:
                yield _frame(held, schema)
                held = []
    yield _frame(held, schema)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, packed), bucketed by row: every text, compressed."""

    def pack(parts):
        for part in parts:
            raw = (t.as_py() for t in part.column(2).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([zstandard.compress(t, 3) for t in raw], pa.binary())], ["row", "doc_id", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return bucketed(rows.mapInArrow(pack, "row long, doc_id long, packed binary"), "row", "spans-texts")


RUNS = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32()), ("anchor", pa.int64()), ("key", pa.binary())])
BLOCKS = pa.schema([("row", pa.int64()), ("m", pa.int32()), ("j", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.binary()), ("key", pa.binary()), ("whole", pa.bool_())])
WINDOWS = pa.schema([("row", pa.int64()), ("s", pa.int32()), ("single", pa.bool_()), ("key", pa.binary())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def repeated_starts(texts: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """``texts`` (row, doc_id, packed) -> (row, lo, hi): intervals of all starts whose
    window starts anywhere else, too."""

    def runs_of(columns, text):
        for a, b, m, anchor in anchor_runs(text, length, gram):
            yield columns[0], a, b, m, anchor, _key(text[a : b + length] + (m - a).to_bytes(4, "little"))

    runs = materialize(texts.select("row", "packed").mapInArrow(lambda parts: _emit(parts, RUNS, runs_of), _ddl(RUNS)), "spans-runs")
    # the small sides of the joins are written first: next to a plain read of one
    # row per key, Spark can split a hot key of the other side
    common = materialize(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "spans-anchors")
    runs = materialize(runs.join(common, "anchor", "left_semi"), "spans-shared-runs")

    # round 1: whole runs
    place = F.struct("row", "a", "b", "m")
    alike = materialize(runs.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min(place).alias("p")), "spans-run-classes")
    found = runs.join(alike.where("n > 1").select("anchor", "key"), ["anchor", "key"], "left_semi").select("row", F.col("a").alias("lo"), F.col("b").alias("hi"))
    unlike = alike.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("anchor")
    unlike = materialize(unlike, "spans-open-anchors")
    open_runs = alike.join(unlike, "anchor", "left_semi").select("p.*")

    # round 2: blocks of offsets from the anchor
    def blocks_of(columns, text):
        row, wanted = columns
        for r in wanted:
            a, b, m = r["a"], r["b"], r["m"]
            for j in range((m - b) // step, (m - a) // step + 1):
                near, far = j * step, j * step + step - 1  # offsets of the block
                lo, hi = max(a, m - far), min(b, m - near)
                whole = lo == m - far and hi == m - near
                core = _key(text[m - near : m - far + length] + j.to_bytes(4, "little"))
                key = _key(text[lo : hi + length] + j.to_bytes(4, "little")) if whole else _key(f"{row}:{m}:{lo}".encode())
                yield row, m, j, lo, hi, core, key, whole

    asked = open_runs.groupBy("row").agg(F.collect_list(F.struct("a", "b", "m")).alias("wanted"))
    met = asked.join(texts.select("row", "packed"), "row").select("row", "wanted", "packed")
    blocks = materialize(met.mapInArrow(lambda parts: _emit(parts, BLOCKS, blocks_of), _ddl(BLOCKS)), "spans-blocks")
    classes = materialize(blocks.groupBy("core", "key").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("p")), "spans-block-classes")
    found_blocks = blocks.join(classes.where("n > 1").select("core", "key"), ["core", "key"], "left_semi").select("row", "lo", "hi")
    unlike_blocks = classes.groupBy("core").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("core")
    unlike_blocks = materialize(unlike_blocks, "spans-open-cores")
    open_blocks = classes.join(unlike_blocks, "core", "left_semi").select("p.*", (F.col("n") == 1).alias("single"))

    # round 3: windows
    def windows_of(columns, text):
        row, wanted = columns
        for r in wanted:
            for s in range(r["lo"], r["hi"] + 1):
                yield row, s, r["single"], _key(text[s : s + length])

    asked = open_blocks.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "single")).alias("wanted"))
    met = asked.join(texts.select("row", "packed"), "row").select("row", "wanted", "packed")
    windows = materialize(met.mapInArrow(lambda parts: _emit(parts, WINDOWS, windows_of), _ddl(WINDOWS)), "spans-windows")
    twice = materialize(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "spans-twice")
    found_windows = windows.where("single").join(twice, "key", "left_semi").select("row", F.col("s").alias("lo"), F.col("s").alias("hi"))
    return found.union(found_blocks).union(found_windows)


def covered(intervals: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans (first, past the last) that windows of these starts cover."""
    spans: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    return [(a, b) for a, b in spans]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): one row per document;
    spans: array of [first byte, past the last byte] removed; kept: the remaining
    bytes."""
    if not 0 < step <= gram <= length or gram & (gram - 1):
        raise ValueError("gram must be a power of two, at least step and at most length")
    texts = packed_texts(docs)
    starts = repeated_starts(texts, length, gram, step)
    by_row = starts.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))

    def cut(columns, text):
        doc_id, starts = columns
        spans = covered([(s["lo"], s["hi"]) for s in starts or ()], length)
        ends = [0, *(x for span in spans for x in span), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
        yield doc_id, len(text), len(text) - len(kept), len(spans), [list(s) for s in spans], kept

    joined = texts.join(by_row, "row", "left").select("doc_id", "starts", "packed")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"
    return joined.mapInArrow(lambda parts: _emit(parts, RESULT, cut, 2_000), ddl)


def op5_repeated_spans(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
