"""Trees, proofs and tampering against a direct construction; hot partitions, ties, arities."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import merkle_manifest as M
from cohortspark.llm.running import running
from helpers import awkward, frame


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels(leaves, arity=2):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity=2):
    out = []
    for level in tree[:-1]:
        lo = i - i % arity
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + arity])))
        i //= arity
    return out


def want(rows, arity=2):
    """One tuple per row as the query returns it, with the tampered rule."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in names:
        parts[p].sort(key=lambda t: t[:3])
        trees[p] = levels([t[2] for t in parts[p]], arity)
    top = levels([trees[p][-1][0] for p in names], arity)
    out = []
    for k, p in enumerate(names):
        for i, (_, _, own, (doc_id, text, lang, source, n)) in enumerate(parts[p]):
            steps = path(trees[p], i, arity) + path(top, k, arity)
            x = own
            if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                x = leaf(doc_id, text, lang, source, n + 1)
            for a, b in steps:
                x = h(a + x + b)
            out.append((doc_id, own, trees[p][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return out


def run(spark, monkeypatch, rows, extra=False):
    monkeypatch.setattr(M, "read", lambda spark, sf, table: frame(spark, rows, extra))
    return [tuple(r) for r in M.op12_merkle_manifest(spark, "").collect()]


same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)


def test_awkward_rows_one_hot_partition(spark, monkeypatch):
    rng = random.Random(3)
    rows = awkward() + [(1000 + i, f"t{i}", "hot", "s", rng.randrange(9)) for i in range(700)]
    rows += [(5000, "copy", "hot", "s", 4)] * 40 + [(-3, "ß", "", "", 1), (-4, "one leaf", "alone", "s", 1)]
    got = run(spark, monkeypatch, rows, extra=True)
    assert same(got, want(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 257])
def test_one_partition_of_any_size(spark, monkeypatch, n):
    rows = [(i, f"t{i}", "en", None, i) for i in range(n)]
    assert same(run(spark, monkeypatch, rows), want(rows))


def test_one_row_per_partition(spark, monkeypatch):
    rows = [(i, "t", f"l{i:03}", None, None) for i in range(37)]
    assert same(run(spark, monkeypatch, rows), want(rows))


def test_blocks_of_leaves_change_nothing(spark, monkeypatch):
    """Ancestors posted to many blocks, groups of one level, other arities."""
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "FEW", 0)
    rows = [(i, f"t{i}", "en" if i % 4 else "de", None, i) for i in range(150)]
    assert same(run(spark, monkeypatch, rows), want(rows))
    monkeypatch.setattr(M, "GROUP", 3)
    table = frame(spark, rows).select(
        F.col("lang").alias("part"), F.col("doc_id").alias("id"), M.leaf_hash([F.col(c) for c in M.COLUMNS]).alias("leaf"), F.lit(None).cast("binary").alias("payload")
    )
    got = M.proofs(table, 3).select("id", M.lower_hex(F.col("root")), M.lower_hex(M.fold(F.col("leaf"), F.col("path"))), F.size("path"))
    for doc_id, root, folded, steps in got.collect():
        assert root == folded == want(rows, 3)[0][3]
        assert steps == (6 if doc_id % 4 else 5)  # 112 leaves: 5 levels of three, 38: 4; one above


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(M, "read", lambda spark, sf, table: frame(spark, awkward()).limit(0))
    got = M.op12_merkle_manifest(spark, "")
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_running_sums_over_slices(spark):
    """A third of the rows in one group, null groups, repeated rows."""
    rng = random.Random(1)
    rows = [(None if i % 10 == 0 else "hot" if i % 3 == 0 else f"g{rng.randrange(30)}", rng.randrange(50), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").withColumn("row", F.monotonically_increasing_id())
    got = running(df, ["g"], ["o", "row"], ["v"], ["o", "v"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.o, r.row)):
        before = groups.setdefault(r.g, [])
        assert r.before_v == sum(before)
        before.append(r.v)
    assert all(r.total_v == sum(groups[r.g]) for r in got) and len(got) == 3000
    firsts = {g: min((r.o, r.row, r.v) for r in got if r.g == g) for g in groups}
    assert all((r.lead.o, r.lead.v) == (firsts[r.g][0], firsts[r.g][2]) for r in got)
