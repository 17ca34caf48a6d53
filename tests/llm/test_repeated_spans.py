"""Removed spans against a scan of every substring."""

import hashlib
import random
from collections import Counter

import pytest
from cohortspark.llm import repeated_spans as R
from helpers import awkward, frame


def brute(docs, length):
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = Counter()
    for doc_id, t in docs:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(t, covered) if not c)
        spans = sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))
        out[doc_id, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows_of(found):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found)


@pytest.mark.parametrize("alphabet,length,gram,step", [("ab", 16, 8, 4), ("abcdefgh", 24, 8, 5), ("abcdefgh", 40, 8, 8), ("a", 12, 4, 3), ("abé", 9, 1, 1)])
def test_matches_brute_force(spark, alphabet, length, gram, step):
    rng = random.Random(length)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(250))) for _ in range(20)]
    docs = list(enumerate(base))
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        docs.append((100 + i, a[: rng.randrange(len(a) + 1)] + b[rng.randrange(len(b) + 1) :] + rng.choice(["", "z" * 50, "é", "xyz"])))
    docs += [(None, None), (5, "a" * 120), (6, base[3]), (6, base[3]), (7, "")]
    found = R.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length, gram, step).collect()
    assert rows_of(found) == brute([(d, (t or "").encode()) for d, t in docs], length)
    for r in found:
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_awkward_documents_at_the_real_length(spark):
    rows = awkward()
    shared = rows[9][1][1000:1700]  # 700 characters of the long document
    rows += [(700 + i, f"left {i} {shared} right {i}", "en", "hot", None) for i in range(30)] + [(800, rows[9][1][5000:5400], "en", "x", 1), (801, rows[9][1][6000:6399], "en", "x", 1)]
    found = R.without_repeats(frame(spark, rows, extra=True)).collect()
    assert rows_of(found) == brute([(r[0], (r[1] or "").encode()) for r in rows], 400)


def test_passages_of_over_50_words_are_judged_by_their_bytes(spark):
    rng = random.Random(51)
    vocabulary = ["".join(rng.choice("abcdeäéß") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def passage(size):  # over 50 words, of exactly so many bytes
        text = prose(51)
        while len(text.encode()) < size:
            text += " " + rng.choice(vocabulary)
        return text if len(text.encode()) == size else passage(size)

    docs, size_of = [(i, prose(rng.randrange(150, 300))) for i in range(8)], {}
    for size in (380, 399, 400, 401, 700):
        for _ in range(2):
            shared = passage(size)
            for left, right in ("()", "[]"):  # no byte beside the passage is shared
                size_of[len(docs)] = size
                docs.append((len(docs), prose(rng.randrange(20, 150)) + left + shared + right + prose(rng.randrange(20, 150))))
    found = R.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: s if (s := size_of.get(i, 0)) >= 400 else 0 for i, _ in docs}
    assert rows_of(found) == brute([(i, t.encode()) for i, t in docs], 400)


def test_text_cut_in_pieces_gives_the_same_runs(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abc") for _ in range(3000)) + b"a" * 500
    whole = list(R.anchor_runs(text, 64, 16))
    assert [a for a, *_ in whole] == [0, *[b + 1 for _, b, *_ in whole[:-1]]] and whole[-1][1] == len(text) - 64
    anchor = {s: (m, h) for a, b, m, h in whole for s in range(a, b + 1)}
    monkeypatch.setattr(R, "PIECE", 257)
    assert {s: (m, h) for a, b, m, h in R.anchor_runs(text, 64, 16) for s in range(a, b + 1)} == anchor


def test_empty_table_and_parameters(spark):
    assert R.without_repeats(frame(spark, awkward()).limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.without_repeats(frame(spark, awkward()), 400, 48, 16)
