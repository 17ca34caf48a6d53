"""Counts equal to the library's, whatever the chunks."""

import random
from collections import Counter

import pytest
import tokenizers
from cohortspark.llm import token_counts as T
from helpers import awkward, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

POOL = ["Hello", "WORLD's", " ", "\n", "\t", "ça", "é", "e\u0301", "12", "3", "<|startoftext|>", "<|endoftext|>", "<|start", "oftext|>", "don't", "'LL", "Σ", "ΟΔΟΣ",
        "İ", "ǅ", "漢字", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "...", "!!", "#", "ﬁ", "ſ", "\x00", "🙂", "👍🏽", "ß", "\u212b", "\u2126", "٣", "²", "½",
        "_", "a" * 70, "thenthe" * 20, "\u0300", "\r\n", "\x0b", "\u3000", "\u2028"]


def test_random_texts_in_chunks_of_any_size():
    library = tokenizers.Tokenizer.from_file(PATH)
    run = T.compiled(PATH)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(POOL) for _ in range(rng.randrange(25)))
        size = rng.choice([1, 2, 3, 7, 50])
        maps = [run.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        assert run.total(maps) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


TIGHT = ["abc", "Word", "12", "7", "'s", "'", "''ll", "<|startoftext|>", "<|endoftext|>", "<|", "<", "|>", "-", "=+/", "漢字", "、", "。", "かな", "が", "か\u3099", "ハ\u309a", "각", "\u1100\u1161\u11a8", "가\u11a8",
         "é", "e\u0301", "\u0301", "İ", "ß", "²", "٣", "〇", "！", "（", "🙂", "\u200d", "{", "_", "x" * 40, "=" * 30]


def test_texts_without_white_space_in_chunks(monkeypatch):
    """Ends are cut at boundaries, and counts stay those of the whole text."""
    library = tokenizers.Tokenizer.from_file(PATH)
    run = T.compiled(PATH)
    monkeypatch.setattr(T, "ENDS", 4)
    rng = random.Random(6)
    cut = 0
    for _ in range(4000):
        text = "".join(rng.choice(TIGHT) for _ in range(rng.randrange(1, 40)))
        size = rng.choice([9, 17, 40, 90])
        maps = [run.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        cut += sum(m[0] for m in maps)
        assert run.total(maps) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert cut > 2000


def test_ends_of_long_unspaced_texts_are_short():
    run = T.compiled(PATH)
    rng = random.Random(7)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "漢字仮名交文、。々〆ヵ東京都"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        closed, head, n, tail = run.chunk_map(text)
        assert closed and n > 1000 and len(head) < 400 and len(tail) < 400


def test_composition_is_associative():
    run = T.compiled(PATH)
    rng = random.Random(4)
    for _ in range(300):
        a, b, c = (run.chunk_map("".join(rng.choice(POOL) for _ in range(rng.randrange(1, 6)))) for _ in range(3))
        assert run.compose(run.compose(a, b), c) == run.compose(a, run.compose(b, c))


def test_forgetting_compiled_strings_changes_nothing(monkeypatch):
    run = T.compiled(PATH)
    texts = ["several words that are counted twice several"] * 2
    want = [run.total([run.chunk_map(t)]) for t in texts]
    monkeypatch.setattr(T, "KEPT", 2)
    assert [run.total([run.chunk_map(t)]) for t in texts] == want


@pytest.mark.parametrize("chunk", [1000, 65_536])
def test_documents(spark, chunk):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = awkward() + [(900, "x" * 150_000 + " y" + "z" * 100, "en", "a", 1)]
    got = T.token_counts(frame(spark, rows, extra=True), PATH, chunk).collect()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert Counter(map(tuple, got)) == Counter((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows)


def test_empty_table_and_other_tokenizers(spark, tmp_path):
    assert T.token_counts(frame(spark, awkward()).limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        T.compiled(public_tokenizers.path("byte_bpe_50k.json"))
