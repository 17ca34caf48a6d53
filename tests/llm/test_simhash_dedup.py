"""Fingerprints, links and classes against brute force."""

import random

import numpy as np
import pytest
import xxhash
from cohortspark.llm import simhash_dedup as S
from cohortspark.llm.graph import components
from helpers import awkward, frame


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    """Smallest index reachable, per fingerprint."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_documents_match_brute_force(spark):
    rng = random.Random(4)
    rows = awkward()
    base = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    for i in range(120):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "Changed"
        rows.append((1000 + i, " ".join(words), "en", "hot", None))
    got = S.near_duplicates(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    prints = {r[1]: fingerprint(r[1], 3) for r in rows}
    distinct = sorted(set(prints.values()))
    root = dict(zip(distinct, classes(distinct, 2)))
    least = {}
    for r in rows:
        if r[0] is not None:
            k = root[prints[r[1]]]
            least[k] = min(least.get(k, 1 << 60), r[0])
    want = sorted(((r[0], prints[r[1]], least.get(root[prints[r[1]]])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("distance,parts,most", [(1, 2, 4), (2, 3, 4), (2, 3, 0), (2, 3, 10**6), (2, 4, 16), (3, 3, 8)])
def test_links_join_what_brute_force_joins(spark, distance, parts, most):
    """Crowds of fingerprints around a few centres, chains and strangers; with no
    candidates allowed all take the way for crowds, with many none does."""
    rng = random.Random(distance * 100 + parts)
    values = [rng.getrandbits(64) for _ in range(60)]
    for centre in values[:4]:
        for _ in range(60):
            v = centre
            for _ in range(rng.randrange(1, 6)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    prints = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = S.links(fps, distance, parts=parts, cell_bits=10, max_candidates=most)
    assert links.where("bit_count(a ^ b) > %d" % distance).count() == 0
    found = {r.node: r.root for r in components(links).collect()}
    group, want = {}, classes(prints, distance)
    for v, w in zip(signed, want):
        group.setdefault(found.get(v, v), set()).add(w)
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want))


def test_allocation_covers_every_pair(spark):
    """Whatever the histogram, the thresholds of a plan sum to distance - parts + 1."""
    rng = np.random.default_rng(1)
    a = S.Allocation([list(range(22)), list(range(22, 43)), list(range(43, 64))], 2, 8, 9, rng.integers(0, 1000, (3, 256)))
    cost, t = a.plan(rng.integers(-(2**62), 2**62, 500))
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1 and t.max() <= 2 and (cost > 0).all()


def test_one_of_each_keeps_rows_as_they_are(spark):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    named = {(r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert len(got) == len({(c, f) if c is None else c for _, f, c in named})
    assert sum(r.doc_id == 1 for r in got) == 1 and not any(r.doc_id == 2 and r.text == rows[0][1] for r in got)
    assert {(r.text, r.lang, r.source) for r in got} <= {r[1:4] for r in rows}
    # repeated rows alone leave one row
    assert S.one_of_each(frame(spark, [rows[1]] * 3)).count() == 1


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (5, 4), (1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len(got) == 303 and len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def test_empty_tables(spark):
    docs = frame(spark, awkward()).limit(0)
    assert S.near_duplicates(docs).collect() == [] and S.one_of_each(docs).collect() == []
