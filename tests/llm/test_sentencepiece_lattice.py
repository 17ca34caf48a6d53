"""Ids equal to the library's, for both kinds of model; exact round trips."""

import random
import struct
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from cohortspark.llm import sentencepiece_lattice as L
from cohortspark.llm.common import arrow_batches
from helpers import awkward, frame, words

public_tokenizers = pytest.importorskip("public_tokenizers")


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_bytes(kind, pieces):
    """A model file of the given pieces (text, score, type)."""
    out = b"".join(field(1, field(1, p) + field(2, float(s)) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, kind) + (field(35, 1) if any(t == L.BYTE for *_, t in pieces) else b"")
    return out + field(2, trainer) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1))


def encoded(spark, docs, model, size=L.BUNDLE):
    rows = L.encode(docs, model, size).collect()
    assert all(r.round_trip for r in rows) or L.UNKNOWN in {model.types[i] for r in rows for i in r.ids}
    return Counter((r.doc_id, r.n_bytes, tuple(r.ids)) for r in rows)


def expected(rows, library):
    return Counter((d, len((t or "").encode()), tuple(library.encode(t or ""))) for d, t, *_ in rows)


TEXTS = ["", " ", "  two  spaces ", "\u2581lower one eighth", "line\nline\r\n\ttab", "<s> </s> <unk> <0x41>", "é e\u0301 ﷽ 🙂👍🏽 \x00",
         "the" * 60 + " " * 70 + "x" * 200, "ñ" * 65, "abcdefghij" * 200, "in the inn, then thin"]


def test_public_bpe_model_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = awkward() + [(500 + i, t, "en", "z", None) for i, t in enumerate(TEXTS)]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = L.load_model(path)
    want = expected(rows, library)
    assert encoded(spark, frame(spark, rows, extra=True), model) == want
    # many bundles, several groups of them
    assert encoded(spark, frame(spark, rows), model, 500) == want


def test_groups_of_bundles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP", 2)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = awkward()
    assert encoded(spark, frame(spark, rows), L.load_model(path), 300) == expected(rows, sentencepiece.SentencePieceProcessor(model_file=path))


def test_no_row_of_a_bundle_holds_it_whole(spark):
    """Written as one row of units and rows of at most about PART characters."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(3)
    texts = ["", words(rng, 100_000, 3000), "", *(words(rng, 50_000, 3000) for _ in range(17)), ""]
    rows = [(i, t, "en", "z", None) for i, t in enumerate(texts)]
    docs, model, total = frame(spark, rows).coalesce(1), L.load_model(path), sum(map(len, texts))
    assert total > 2 * L.PART
    made = L.bundles(docs, model).collect()
    assert len({r.bundle for r in made}) == 1 and sum(r.units is not None for r in made) == 1
    sizes = [sum(r.n_bytes) for r in made if r.codes is not None]
    assert len(sizes) > 1 and sum(sizes) == total and max(sizes) < L.PART + max(map(len, texts)) + L.SLICE
    assert encoded(spark, docs, model) == expected(rows, sentencepiece.SentencePieceProcessor(model_file=path))


def test_texts_reach_the_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.nbytes]})

    docs = spark.range(60).coalesce(1).select(L.F.repeat(L.F.lit("x"), 1 << 18).alias("text"))
    with arrow_batches(spark, L.TEXT_BATCH):
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 60 << 18 and max(got) < 5 << 20
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, "1m"):
        1 / 0
    L.bundles(frame(spark, awkward()), L.default_model())
    assert spark.conf.get(key) == before


def test_unigram_model_equals_the_library(spark):
    letters = "abcdehint, \u2581"
    pieces = [("<unk>", 0.0, L.UNKNOWN), ("<s>", 0.0, L.CONTROL), ("</s>", 0.0, L.CONTROL)]
    pieces += [(c, -8.0 - i / 8, L.NORMAL) for i, c in enumerate(letters.replace(" ", ""))]
    more = ["\u2581the", "the", "in", "\u2581in", "inn", "then", "th", "hin", "\u2581t", "an", "\u2581\u2581", "abc", "bcd", "de", "abcde", "tt"]
    pieces += [(p, -3.0 - i / 4, L.NORMAL) for i, p in enumerate(more)]
    data = model_bytes(L.UNIGRAM, pieces)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), L.parse_model(data)
    assert model.kind == L.UNIGRAM and not model.byte_ids
    texts = [t for t in TEXTS if not any(ord(c) > 127 and c != "\u2581" for c in t) and "\x00" not in t]
    texts += ["abcde" * 30, "then thin inn the inthe", "bcdabcabcde tttt", "athe inn"]
    rows = [(i, t, "en", "z", None) for i, t in enumerate(texts)]
    # the library joins neighbouring unknown characters; here each is its own piece
    merge = lambda ids: tuple(i for k, i in enumerate(ids) if i or not k or ids[k - 1])
    got = Counter((d, n, merge(ids)) for d, n, ids in encoded(spark, frame(spark, rows), model).elements())
    assert got == Counter((d, n, merge(ids)) for d, n, ids in expected(rows, library).elements())


def test_decoding(spark):
    model = L.default_model()
    docs = frame(spark, awkward())
    both = L.encode(docs, model).select("doc_id", L.decode(L.F.col("ids"), model).alias("text")).collect()
    assert Counter((r.doc_id, r.text) for r in both) == Counter((r[0], r[1] or "") for r in awkward())
    broken = spark.createDataFrame([([3 + 0xFF, 3 + 0x41],), (None,)], "ids array<int>")
    assert [r[0] for r in broken.select(L.decode(L.F.col("ids"), model)).collect()] == ["\ufffdA", None]


def test_empty_table_and_unsupported_models(spark):
    assert L.encode(frame(spark, awkward()).limit(0), L.default_model()).collect() == []
    with pytest.raises(ValueError):
        L.parse_model(model_bytes(3, [("<unk>", 0.0, L.UNKNOWN)]))
    with pytest.raises(ValueError):
        L.parse_model(model_bytes(L.BPE, [("<unk>", 0.0, L.UNKNOWN), ("x", 0.0, L.USER_DEFINED)]))
