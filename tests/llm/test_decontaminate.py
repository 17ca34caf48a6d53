"""Planted passages, the guarantee of the blocks, and a brute-force scan."""

import random
from collections import Counter

import numpy as np
from cohortspark.llm import decontaminate as D
from helpers import awkward, frame, words

ITEM = "item_id long, text string"


def brute(docs, items, k=5, threshold=0.8):
    """Documents and items with a window of the item's size that is as similar."""
    out = set()
    for doc_id, text in docs:
        doc = D.words_of(text or "")
        for item_id, item in items:
            own = D.words_of(item or "")
            size = min(k, len(own))
            if not own or len(doc) < size:
                continue
            bag = Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
            n = min(len(own), len(doc))
            for s in range(len(doc) - n + 1):
                window = Counter(tuple(doc[i : i + size]) for i in range(s, s + n - size + 1))
                if D.weighted_jaccard(bag, window) >= threshold:
                    out.add((doc_id, item_id))
                    break
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.choice([1, 3, 4, 5, 6, 20, 40]), 60)) for i in range(25)] + [(90, None), (91, "  "), (92, "a b a b a b a b a b a b")]
    docs = [(i, words(rng, rng.randrange(1, 90), 60)) for i in range(60)]
    for i in range(60):
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "other"
        at = rng.randrange(40)
        text = (words(rng, at, 60) + " " + ", ".join(item).upper() + "; " + words(rng, 10, 60)).strip()
        docs.append((100 + i, text))
    docs += [(900, "x a b a b a b a b a b a b y"), (901, None), (902, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, ITEM)
    got = D.contaminations(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert all(r.similarity >= 0.8 - 1e-9 and r.distance <= D.RADIUS for r in got)
    clean = {r.doc_id for r in D.without_contaminated(d, b).collect()}
    assert clean == {i for i, _ in docs} - {r.doc_id for r in got}


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(5)
    items = D.Items([(i, f"a{i % 280} b{i} c{i} d{i} e{i} f{i}"[: 12 if i > 290 else 99]) for i in range(300)], 5, 0.8, 17, 8)
    v = items.prints[rng.integers(300, size=200)]
    for i in range(200):
        for _ in range(rng.integers(0, 20)):
            v[i] ^= np.uint64(1) << np.uint64(rng.integers(64))
    distance = np.bitwise_count(items.prints[None, :] ^ v[:, None])
    got = list(zip(*(x.tolist() for x in items.within_all(v))))
    assert got == [tuple(x) for x in np.argwhere(distance <= 17).tolist()]


def test_window_prints_are_those_of_the_shingles(monkeypatch):
    monkeypatch.setattr(D, "RUN", 16)
    rng = random.Random(2)
    text = words(rng, 120, 30).split()
    starts = np.array(sorted(rng.sample(range(100), 40)))
    for size, other in ((5, 12), (2, 1), (1, 20)):
        got = D.window_prints(text, starts, size, other)
        assert got.tolist() == [int(D.fingerprint([" ".join(text[i : i + size]) for i in range(s, s + other)])) for s in starts.tolist()]


def test_every_planted_item_is_caught(spark):
    from cohortspark.llm.common import read

    sf = "/root/testdata/sf0.01"
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark").collect()
    found = {(r.doc_id, r.item_id) for r in D.op1_decontaminate(spark, sf).collect()}
    plain = lambda t: " " + " ".join(D.words_of(t)) + " "
    texts = [(i.item_id, plain(i.text)) for i in items]
    planted = {(d.doc_id, i) for d in docs.collect() for i, t in texts if t in plain(d.text)}
    assert planted and planted <= found


def test_awkward_rows_and_blocks_of_items(spark, monkeypatch):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    bench = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, rows[4][1]), (2, None)], ITEM)
    monkeypatch.setattr(D, "ITEM_BLOCK", 1)
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in D.contaminations(docs, bench).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (2, 1), (2, 1)]
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert D.contaminations(docs, bench.limit(0)).count() == 0 and D.without_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert D.contaminations(docs.limit(0), bench).count() == 0
