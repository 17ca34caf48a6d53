"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped (each space becomes U+2581, one in front) and cut into units
at every place that no piece of the model spans (two neighbouring characters
that are neighbours in no piece); units are then encoded on their own without
any loss. Each distinct unit is encoded once:

1. its substrings of at most the longest piece's length are exploded;
2. an equi-join with the piece table (bounded by the model file, broadcast)
   leaves the edges of its lattice;
3. edges are grouped by unit (the rows of a unit are together already, so no
   further shuffle or sort) and a higher-order ``aggregate`` folds them to the best
   path.

The fold is the model's own. For a unigram model it is Viterbi: the best sum of
scores up to each position, left to right. A BPE model defines its result by
merges (always the pair with the best score, of equals the leftmost), which no
sum of scores gives; there the fold takes, from the same lattice, the first edge
in that order that spans exactly two current symbols, until none is left. Both
give the ids that the library gives. Units longer than a bit mask (62
characters) are folded from the same edges in a pandas function.

Documents come in bundles of up to ``BUNDLE`` characters. A bundle keeps its
documents as numbers of its distinct units, so what is shuffled is each distinct
unit of a bundle and its encoding, not every word; texts are never shuffled. A
unit that nearly all bundles hold is dealt in groups of ``GROUP`` bundles. The
bundles are written bucketed by their number, so the join that brings the
encodings back moves only these. A bundle is written as one row of its distinct
units and rows of ``PART`` characters of its documents, so that no worker or
executor handles it as one large row.

Decoding joins pieces, byte pieces as bytes (invalid UTF-8 becomes U+FFFD), and
turns U+2581 into a space; it gives the text back, except that a U+2581 of the
text itself is a space afterwards.

Defined results: null and empty texts have no pieces; characters without a piece
become byte pieces (or the unknown id if the model has none); special strings in
a text are ordinary text; repeated rows and null doc_ids are encoded each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bucketed, read, whole_text

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BUNDLE = 14_000_000
#: Characters cut at a time.
SLICE = 250_000
#: Characters of the documents of one row of a bundle.
PART = 2_000_000
#: Arrow batches of texts that are read into bundles.
TEXT_BATCH = "4m"
#: Units of the documents put together at a time.
UNITS = 200_000
GROUP = 4096
#: Number of a unit in its bundle, below the bundle's number in one long.
UNIT_BITS = 25
MASK_CHARS = 62
#: The unigram model's penalty for an unknown character, below the lowest score.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Model:
    kind: int
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    add_prefix: bool = True

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        """The pieces that a text can be cut into."""
        return {p: (i, self.scores[i]) for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def neighbours(self) -> frozenset[str]:
        """Two-character strings within pieces."""
        return frozenset(p[i : i + 2] for p in self.table for i in range(len(p) - 1))

    @cached_property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    @cached_property
    def byte_ids(self) -> list[int]:
        """Ids of the 256 byte pieces; empty without byte fallback."""
        at = {p: i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        names = [f"<0x{b:02X}>" for b in range(256)]
        return [at[n] for n in names] if all(n in at for n in names) else []

    def single(self, char: str) -> list[int]:
        """Ids of a character on its own: its piece, or else its bytes."""
        return [self.table[char][0]] if char in self.table else self.fallback(char)

    def fallback(self, text: str) -> list[int]:
        """Ids of characters that no piece covers."""
        return [self.byte_ids[b] for b in text.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def escape(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.add_prefix else text

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of every code point (0: in no piece of two characters or more) and
        whether a class may follow another within a piece."""
        of = {c: i + 1 for i, c in enumerate(sorted({c for two in self.neighbours for c in two}))}
        classes = np.zeros(0x110000, np.uint16)
        classes[[ord(c) for c in of]] = list(of.values())
        follows = np.zeros((len(of) + 1, len(of) + 1), bool)
        for two in self.neighbours:
            follows[of[two[0]], of[two[1]]] = True
        return classes, follows

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The units of escaped texts, end to end, and how many each text has."""
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        classes, follows = self.classes
        kind = classes[points]
        first = np.ones(len(points), bool)
        first[1:] = ~follows[kind[:-1], kind[1:]]
        doc_starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        first[doc_starts] = True
        starts = np.flatnonzero(first)
        sizes = np.ones(len(points), np.int32)
        for least in (0x80, 0x800, 0x10000):
            sizes += points >= least
        ends = np.cumsum(sizes, dtype=np.int64)
        offsets = np.concatenate([ends[starts] - sizes[starts], ends[-1:]]).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer("".join(texts).encode())) if len(starts) else pa.array([], pa.string())
        counts = np.zeros(len(texts), np.int64)
        counts[lengths > 0] = np.diff(np.searchsorted(starts, [*doc_starts, len(points)]))
        return units, counts

    def decoder(self):
        """A function of an array of ids: the text's bytes."""
        size = np.array([len(p) for p in self.decoded], np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(self.decoded), np.uint8)

        def text_of(ids: np.ndarray) -> bytes:
            out = _gather(flat, start[ids], size[ids]).tobytes()
            return out[1:] if self.add_prefix and out.startswith(b" ") else out

        return text_of

    @cached_property
    def decoded(self) -> list[bytes]:
        text = {NORMAL, USER_DEFINED, UNUSED}
        plain = [p.replace(SPACE, " ").encode() if t in text else b"" for p, t in zip(self.pieces, self.types)]
        for b, i in enumerate(self.byte_ids):
            plain[i] = bytes([b])
        plain[self.unknown] = " ⁇ ".encode()  # the library's surface of an unknown piece
        return plain

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): one row per piece that a text can be cut into."""
        rows = pa.table({"piece": list(self.table), "id": pa.array([i for i, _ in self.table.values()], pa.int32()), "score": [s for _, s in self.table.values()]})
        return spark.createDataFrame(rows)


def parse_model(data: bytes) -> Model:
    pieces, scores, types, kind, add_prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only identity normalisation with escaped, kept white space is supported")
            add_prefix = bool(spec.get(3, 1))
    if kind not in (UNIGRAM, BPE) or USER_DEFINED in types:
        raise ValueError("only unigram and BPE models without user-defined pieces are supported")
    return Model(kind, tuple(pieces), tuple(scores), tuple(types), add_prefix)


@lru_cache(maxsize=4)
def load_model(path: str) -> Model:
    with open(path, "rb") as f:
        return parse_model(f.read())


# -- bundles of documents ------------------------------------------------------


@dataclass
class _Bundle:
    docs: list[tuple] = field(default_factory=list)  # (doc_id, bytes, digest, units)
    units: list[pa.DictionaryArray] = field(default_factory=list)  # of each slice
    ends: list[tuple[int, int]] = field(default_factory=list)  # (documents, characters) up to the end of each slice
    size: int = 0

    def add(self, doc_ids: list, texts: list[str], model: Model) -> None:
        units, counts = model.cut([model.escape(t) for t in texts])
        self.units.append(units.dictionary_encode())
        for doc_id, text, n in zip(doc_ids, texts, counts.tolist()):
            digest = hashlib.sha256(text.replace(SPACE, " ").encode("utf-8", "replace")).digest()
            self.docs.append((doc_id, len(text.encode("utf-8", "replace")), digest, n))
        self.size += sum(map(len, texts))
        self.ends.append((len(self.docs), self.size))

    def rows(self, number: int, part: int = PART):
        """A row of the distinct units, then rows of documents of about ``part``
        characters, with their units as numbers."""
        found, self.units = pa.chunked_array(self.units).unify_dictionaries(), []
        dictionary, chunks = found.chunk(0).dictionary, [c.indices.to_numpy() for c in found.chunks]
        n = len(dictionary)
        # numbered by falling frequency: the high bytes are nearly all 0 then
        order = np.argsort(-sum(np.bincount(c, minlength=n) for c in chunks), kind="stable")
        number_of = np.empty(n, np.int32)
        number_of[order] = np.arange(n)
        yield self._row(number, units=pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), dictionary.take(pa.array(order))))
        first, lo, done = 0, 0, 0
        for i, (hi, size) in enumerate(self.ends):
            if size - done < part and i + 1 < len(self.ends):
                continue
            ids, sizes, digests, counts = zip(*self.docs[lo:hi])
            codes = number_of[np.concatenate(chunks[first : i + 1])]
            yield self._row(
                number,
                doc_ids=pa.array([ids], pa.list_(pa.int64())),
                n_bytes=pa.array([sizes], pa.list_(pa.int64())),
                digests=pa.array([b"".join(digests)], pa.binary()),
                n_units=pa.array([counts], pa.list_(pa.int32())),
                codes=pa.array([codes.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
            )
            first, lo, done = i + 1, hi, size

    @staticmethod
    def _row(number: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"doc_ids": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "digests": pa.binary(), "n_units": pa.list_(pa.int32()), "codes": pa.binary(), "units": pa.list_(pa.string())}
        return pa.RecordBatch.from_pydict({"bundle": pa.array([number], pa.int64())} | {name: columns.get(name, pa.nulls(1, kind)) for name, kind in kinds.items()})


BUNDLE_ROW = "bundle long, doc_ids array<long>, n_bytes array<long>, digests binary, n_units array<int>, codes binary, units array<string>"


def _slices(parts, size: int):
    """(doc_ids, texts) of consecutive documents, up to about ``size`` characters."""
    for part in parts:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def bundles(docs: DataFrame, model: Model, size: int = BUNDLE) -> DataFrame:
    """The documents in bundles, written once, bucketed by bundle: one row of a
    bundle has its units, the others its documents."""

    def pack(parts):
        made, number = 0, TaskContext.get().partitionId() << 12
        held = _Bundle()
        for doc_ids, texts in _slices(parts, min(SLICE, size)):
            held.add(doc_ids, texts, model)
            if held.size >= size:
                yield from held.rows(number + made)
                held, made = _Bundle(), made + 1
        if held.docs:
            yield from held.rows(number + made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(pack, BUNDLE_ROW)
    with arrow_batches(docs.sparkSession, TEXT_BATCH):
        return bucketed(rows, "bundle", "sentencepiece-bundles")


# -- the lattice ---------------------------------------------------------------


EDGES = "unit string, at array<long>, edges array<struct<start:int,stop:int,id:int,score:double>>"


def _by_unit(parts):
    """Rows (uid, unit, at, start, stop, id, score), each unit's together with the one
    that carries unit and at in front -> one row per unit with its edges, best
    score first, then by start."""
    held = None

    def grouped(rows: pa.Table) -> pa.RecordBatch:
        uid, first = rows.column("uid").to_numpy(), np.flatnonzero(rows.column("unit").is_valid().to_numpy(zero_copy_only=False))
        segment = np.repeat(np.arange(len(first)), np.diff([*first, len(uid)]))
        if first[0] != 0 or (uid != uid[first][segment]).any():
            raise RuntimeError("the rows of a unit are not together")
        edge = np.ones(len(uid), bool)
        edge[first] = False
        start, stop, ids, score = (rows.column(c).to_numpy()[edge] for c in ("start", "stop", "id", "score"))
        order = np.lexsort((start, -score, segment[edge]))
        counts = np.bincount(segment[edge], minlength=len(first))
        fields = [pa.array(start[order].astype(np.int32)), pa.array(stop[order].astype(np.int32)), pa.array(ids[order].astype(np.int32)), pa.array(score[order])]
        edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "stop", "id", "score"]))
        heads = rows.take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([heads.column("unit").combine_chunks(), heads.column("at").combine_chunks(), edges], ["unit", "at", "edges"])

    for part in parts:
        rows = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
        starts = np.flatnonzero(rows.column("unit").is_valid().to_numpy())
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield grouped(rows.slice(0, cut).combine_chunks())
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield grouped(held.combine_chunks())


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (unit, at) -> (unit, at, edges): the pieces among the substrings of
    each unit, best first. For BPE without the single characters, which its fold
    starts from whether they are pieces or not.

    The rows of a unit leave the explodes and the broadcast join together and in
    order, so they are grouped where they are, without a further sort (checked:
    anything else fails)."""
    pieces = F.broadcast(model.frame(units.sparkSession))
    least = 2 if model.kind == BPE else 1
    n, s, w = F.length("unit"), F.col("s"), F.col("w")
    # position -1 has no text: its one row carries unit and at
    numbered = units.select(F.monotonically_increasing_id().alias("uid"), "unit", "at")
    starts = numbered.select("uid", "unit", "at", F.explode(F.sequence(F.lit(-1), F.greatest(n - least, F.lit(-1)))).alias("s"))
    widths = F.explode(F.sequence(F.lit(least), F.when(s < 0, F.lit(least)).otherwise(F.least(F.lit(max(model.longest, least)), n - s))))
    each = starts.select("uid", "unit", "at", "s", widths.alias("w"))
    head = s < 0
    cut = each.select("uid", "s", "w", F.when(~head, F.substring("unit", s + 1, w)).alias("piece"), F.when(head, F.col("unit")).alias("unit"), F.when(head, F.col("at")).alias("at"))
    met = cut.join(pieces, "piece", "left").where(head | F.col("id").isNotNull())
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    rows = met.select("uid", "unit", "at", s.alias("start"), (s + w).alias("stop"), zero("id", "int").alias("id"), zero("score", "double").alias("score"))
    return rows.mapInArrow(_by_unit, EDGES)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


TOKENS = "array<struct<start:int,stop:int,id:int>>"


def merge_fold(edges: Column, unit: Column) -> Column:
    """BPE: tokens of a unit of at most ``MASK_CHARS`` characters. The state is the
    set of symbol boundaries, as a bit mask."""
    ends = lambda e: _bit(e["start"]).bitwiseOR(_bit(e["stop"]))
    inner = lambda e: _bit(e["stop"]) - _bit(e["start"] + 1)
    masks = F.transform(edges, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id"), ends(e).alias("ends"), inner(e).alias("inner")))
    usable = lambda state, e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)

    def step(state, _):
        first = F.get(F.filter(state["edges"], lambda e: usable(state["mask"], e)), F.lit(0))
        merged = F.coalesce(state["mask"].bitwiseAND(F.bitwise_not(first["inner"])), state["mask"])
        # an edge of which a boundary is gone can never be used again
        after = lambda mask: F.struct(mask.alias("mask"), F.filter(state["edges"], lambda e: mask.bitwiseAND(e["ends"]) == e["ends"]).alias("edges"))
        return F.get(F.transform(F.array(merged), after), F.lit(0))  # binds the mask, so that it is worked out once

    def path(state):
        kept = F.filter(state["edges"], lambda e: state["mask"].bitwiseAND(e["inner"]) == 0)
        return F.transform(kept, lambda e: F.struct(e["start"], e["stop"], e["id"]))

    start = F.struct((_bit(F.length(unit) + 1) - 1).alias("mask"), masks.alias("edges"))
    # a unit of n characters has n - 1 merges at most
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(unit) - 1, F.lit(1))), start, step, path)).cast(TOKENS)


def viterbi_fold(edges: Column, unit: Column, unknown: int, penalty: float) -> Column:
    """Unigram: tokens of the best sum of scores (of equals, the longest last
    piece). The state holds the best way to each position so far."""
    way = "struct<score:double,prev:int,id:int>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("prev"), F.lit(-1).alias("id")).cast(way))

    def step(best, j):
        one = F.struct((F.get(best, j - 1)["score"] + penalty).alias("score"), (1 - j).alias("near"), F.lit(unknown).alias("id"))
        ends = F.filter(edges, lambda e: e["stop"] == j)
        ways = F.transform(ends, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("near"), e["id"].alias("id")))
        single = F.exists(ends, lambda e: e["start"] == j - 1)
        top = F.array_max(F.when(single, ways).otherwise(F.concat(ways, F.array(one))))
        told = F.transform(F.array(top), lambda t: F.struct(t["score"].alias("score"), (-t["near"]).alias("prev"), t["id"].alias("id")))
        return F.concat(best, told.cast(f"array<{way}>"))

    def path(best):
        def back(state, _):
            at = F.get(best, state["at"])
            token = F.struct(at["prev"].alias("start"), state["at"].alias("stop"), at["id"].alias("id"))
            tokens = F.when(state["at"] > 0, F.concat(F.array(token), state["tokens"])).otherwise(state["tokens"])
            return F.struct(F.greatest(at["prev"], F.lit(0)).alias("at"), tokens.alias("tokens"))

        none = F.struct(F.length(unit).alias("at"), F.array().cast(TOKENS).alias("tokens"))
        return F.aggregate(F.sequence(F.lit(1), F.length(unit)), none, back, lambda state: F.filter(state["tokens"], lambda t: t["id"] != unknown))

    return F.aggregate(F.sequence(F.lit(1), F.length(unit)), first, step, path)


def merge_long(unit: str, edges: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """BPE by a heap over the edges (order, start, stop, id) of one long unit."""
    n = len(unit)
    spans = {(s, e): (o, i) for o, s, e, i in edges}
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(left: int) -> None:
        if 0 <= left and stop[left] < n and (found := spans.get((left, stop[stop[left]]))):
            heapq.heappush(heap, (found[0], left, stop[left], stop[stop[left]]))

    alive = [True] * n
    for i in range(n):
        offer(i)
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        if not (alive[left] and stop[left] == middle and alive[middle] and stop[middle] == end):
            continue
        stop[left], alive[middle] = end, False
        if end < n:
            before[end] = left
        offer(left)
        offer(before[left])
    return [(i, stop[i], spans[i, stop[i]][1]) for i in range(n) if alive[i] and (i, stop[i]) in spans]


def viterbi_long(unit: str, edges: list[tuple[float, int, int, int]], unknown: int, penalty: float) -> list[tuple[int, int, int]]:
    n = len(unit)
    ending: dict[int, list[tuple[int, float, int]]] = {}
    for order, s, e, i in sorted(edges, key=lambda x: x[1]):
        ending.setdefault(e, []).append((s, -order, i))
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]
    for j in range(1, n + 1):
        ways = [(best[s][0] + score, -s, i) for s, score, i in ending.get(j, ())]
        if not any(-s == j - 1 for _, s, _ in ways):
            ways.append((best[j - 1][0] + penalty, 1 - j, unknown))
        score, near, i = max(ways)
        best.append((score, -near, i))
    out, at = [], n
    while at > 0:
        _, s, i = best[at]
        out.append((s, at, i))
        at = s
    return [t for t in reversed(out) if t[2] != unknown]


#: Positions of a long unit that are exploded together.
STRIDE = 512


def long_tokens(units: DataFrame, model: Model) -> DataFrame:
    """Tokens of the units longer than ``MASK_CHARS``: their positions are exploded
    in strides, so that no row holds all substrings of a long unit."""
    unit, n, w = F.col("unit"), F.length("unit"), model.longest
    stride = F.explode(F.sequence(F.lit(0), (n - 1) - F.pmod(n - 1, F.lit(STRIDE)), F.lit(STRIDE)))
    blocks = units.select("unit", "part", stride.alias("base")).select("unit", "part", "base", F.substring(unit, F.col("base") + 1, STRIDE + w - 1).alias("text"), n.alias("n"))
    each = blocks.select("unit", "part", "base", "text", F.explode(F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.col("n") - F.col("base")) - 1)).alias("s"))
    piece = each.select("unit", "part", "base", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(w), F.length("text") - F.col("s")))).alias("w"), "text")
    pieces = F.broadcast(model.frame(units.sparkSession))
    met = piece.select("unit", "part", (F.col("base") + F.col("s")).alias("start"), "w", F.substring(F.col("text"), F.col("s") + 1, F.col("w")).alias("piece")).join(pieces, "piece")
    edges = met.groupBy("unit", "part").agg(F.collect_list(F.struct((-F.col("score")).alias("order"), "start", (F.col("start") + F.col("w")).alias("stop"), "id")).alias("edges"))
    penalty = min(model.scores) - UNKNOWN_PENALTY

    @F.pandas_udf(TOKENS)
    def fold(unit: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for u, es in zip(unit, edges):
            rows = [(e["order"], e["start"], e["stop"], e["id"]) for e in es]
            found = merge_long(u, rows) if model.kind == BPE else viterbi_long(u, rows, model.unknown, penalty)
            out.append([{"start": s, "stop": e, "id": i} for s, e, i in found])
        return pd.Series(out)

    found = edges.select("unit", "part", fold("unit", "edges").alias("tokens"))
    return units.join(found, ["unit", "part"], "left").select("unit", "part", "at", F.coalesce("tokens", F.array().cast(TOKENS)).alias("tokens"))


def unit_tokens(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (unit, part, at) -> (unit, at, tokens): the best path of each."""
    short = lattice(units.where(F.length("unit") <= MASK_CHARS).select("unit", "at"), model)
    if model.kind == BPE:
        best = merge_fold(F.col("edges"), F.col("unit"))
    else:
        best = viterbi_fold(F.col("edges"), F.col("unit"), model.unknown, min(model.scores) - UNKNOWN_PENALTY)
    short = short.select("unit", "at", best.alias("tokens"))
    return short.union(long_tokens(units.where(F.length("unit") > MASK_CHARS), model).select("unit", "at", "tokens"))


# -- and back to the documents ---------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    """int32 arrays, by byte planes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays), 3)


def _spread(raw: bytes | np.ndarray) -> np.ndarray:
    """The int32 numbers of four byte planes."""
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1) if isinstance(raw, bytes) else raw
    return planes.T.copy().view(np.int32).reshape(-1)


def _gather(table: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """table[start : start + count] of each, concatenated."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def packed(tokens: DataFrame, model: Model) -> DataFrame:
    """``tokens`` (unit, at, tokens) -> (bundle, n, blob): the ids of many units of a
    bundle in one row."""

    def pack(parts):
        for part in parts:
            ids, counts = [], []
            found = part.column(2)
            offsets = found.offsets.to_numpy()
            start, stop, piece = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i, unit in enumerate(part.column(0).to_pylist()):
                lo, hi, at, own = offsets[i], offsets[i + 1], 0, len(ids)
                for t in range(lo, hi):
                    if start[t] > at:
                        for c in unit[at : start[t]]:
                            ids += model.single(c)
                    ids.append(piece[t])
                    at = stop[t]
                for c in unit[at:]:
                    ids += model.single(c)
                counts.append(len(ids) - own)
            ids, counts = np.array(ids, np.int32), np.array(counts, np.int64)
            starts = np.cumsum(counts) - counts
            where = part.column(1)
            key = where.values.to_numpy()[where.offsets[0].as_py() : where.offsets[-1].as_py()]
            row = np.repeat(np.arange(part.num_rows), np.diff(where.offsets.to_numpy()))
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            bundle = key >> UNIT_BITS
            cut = np.flatnonzero(np.diff(bundle)) + 1
            out = {"bundle": [], "n": [], "blob": []}
            for k, r in zip(np.split(key, cut), np.split(row, cut)):
                if len(k):
                    out["bundle"].append(int(k[0] >> UNIT_BITS))
                    out["n"].append(len(k))
                    out["blob"].append(_squeeze(k & ((1 << UNIT_BITS) - 1), counts[r], _gather(ids, starts[r], counts[r])))
            yield pa.RecordBatch.from_arrays([pa.array(out["bundle"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["blob"], pa.binary())], list(out))

    return tokens.select("unit", "at", "tokens").mapInArrow(pack, "bundle long, n int, blob binary")


ENCODED = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, model: Model, size: int = BUNDLE) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_sha256, round_trip, ids): one row per
    document: UTF-8 length, its piece ids, their digest (as little-endian 32-bit
    numbers) and whether decoding gives the text back (U+2581 as space)."""
    table = bundles(docs, model, size)
    numbered, texts = table.where("units is not null"), table.where("codes is not null")
    parts = max(1, -(-numbered.count() // GROUP))
    key = F.shiftleft("bundle", UNIT_BITS)
    each = numbered.select("bundle", F.posexplode("units").alias("n", "unit"))
    units = each.groupBy("unit", F.pmod(F.col("bundle"), F.lit(parts)).alias("part")).agg(F.collect_list(key.bitwiseOR(F.col("n").cast("long"))).alias("at"))
    blobs = packed(unit_tokens(units, model), model).groupBy("bundle").agg(F.collect_list(F.struct("n", "blob")).alias("blobs"))

    def encodings(blobs: pa.Scalar):
        """(ids, first, count) of a bundle: the ids of its units end to end, and where
        each unit's are."""
        numbers, counts, ids = [], [], []
        for b in blobs.as_py() or ():
            n, flat = b["n"], zstandard.decompress(b["blob"])
            numbers.append(_spread(flat[: 4 * n]))
            counts.append(_spread(flat[4 * n : 8 * n]))
            ids.append(_spread(flat[8 * n :]))
        length = np.zeros(1 + max((int(x.max()) for x in numbers), default=0), np.int64)
        start = np.zeros_like(length)
        if not ids:
            return np.empty(0, np.int32), start, length
        at, many = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
        length[at], start[at] = many, np.cumsum(many) - many
        return np.concatenate(ids), start, length

    def unpack(parts_):
        text_of = model.decoder()
        bundle = None
        for part in parts_:
            for r in range(part.num_rows):
                row = {name: part.column(i)[r] for i, name in enumerate(part.schema.names)}
                if bundle != row["bundle"]:  # the rows of a bundle follow each other, as a rule
                    found, start, length = encodings(row["blobs"])
                    bundle = row["bundle"]
                codes = np.frombuffer(row["codes"].as_buffer(), np.uint8).reshape(4, -1)
                doc_ids, n_bytes, n_units = row["doc_ids"].values, row["n_bytes"].values, row["n_units"].values.to_numpy()
                digests = row["digests"].as_py()
                ends = np.cumsum(n_units)
                lo = 0
                while lo < len(n_units):
                    first = int(ends[lo] - n_units[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, first + UNITS, "right")))
                    own = _spread(codes[:, first : int(ends[hi - 1])])
                    sizes = np.concatenate([[0], np.cumsum(length[own])])
                    offsets = sizes[np.concatenate([[0], ends[lo:hi] - first])]
                    pieces = _gather(found, start[own], length[own])
                    docs_ids = [pieces[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                    same = [hashlib.sha256(text_of(p)).digest() == digests[32 * i : 32 * i + 32] for i, p in enumerate(docs_ids, lo)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.slice(lo, hi - lo),
                            n_bytes.slice(lo, hi - lo),
                            pa.array(np.diff(offsets).astype(np.int64)),
                            pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in docs_ids], pa.string()),
                            pa.array(same, pa.bool_()),
                            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pieces)),
                        ],
                        ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "round_trip", "ids"],
                    )
                    lo = hi

    joined = texts.select("bundle", "doc_ids", "n_bytes", "digests", "n_units", "codes").join(blobs, "bundle", "left")
    return joined.mapInArrow(unpack, ENCODED)


def decode(ids: Column, model: Model) -> Column:
    """The text of an array of piece ids (null: null)."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        text_of = model.decoder()
        return pd.Series([None if r is None else text_of(np.asarray(r, np.int64)).decode("utf-8", "replace") for r in rows], dtype=object)

    return text(ids)


def default_model() -> Model:
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), default_model()).drop("ids")
