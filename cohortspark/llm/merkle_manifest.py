"""Merkle manifest of a dataset, with every row's proof by pointer jumping.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else the length in
UTF-8 bytes, a colon and the value. The leaves of a partition (here: a language)
in the order of the ids are the bottom of a tree; runs of ``arity`` consecutive
nodes are hashed (their lowercase hex digests concatenated) into one node of the
level above, until one is left, the partition's subroot. The subroots, in the order of
the partition names, are hashed into the root in the same way.

1. Places: running counts over range-partitioned slices give each leaf its place in
   its partition, whatever share of the rows that holds.
2. Trees: ``STEPS`` levels at a time, over groups of at most arity^STEPS nodes; a
   group's levels are built by higher-order functions. Every node below the
   subroot gets its segment: the other members of its run, left and right of it.
3. Proofs: every node knows the segment from it up to an ancestor, at first its
   parent. A round joins the nodes to the table itself at the ancestors and
   concatenates both segments, which doubles the distance, until the subroot is
   reached: log2(height) rounds. In round k only nodes on levels divisible by
   2^(k+1) go on, so beside the leaves a round moves a small part of the tree.
   A node high up is the ancestor of very many leaves: where the ancestors of a
   round are counted to be ``FEW``, they are broadcast and the leaves stay where
   they are; else they are posted once per ``BLOCK`` leaves, and joined on the block,
   too, so that no key is hot.
4. The path from subroot to root, found the same way over the subroots, is
   appended, in the same two ways.

Intermediate tables are written once each to the shared folder. Digests are kept as
32 bytes.

Defined results: null ids come first, null partitions before all others, and both
are rows like others; repeated rows and ids are leaves of their own (ties in the
order of their leaf hashes); empty and very long texts are hashed whole; a lone
leaf is its subroot, and a lone subroot the root, with an empty proof; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import read
from .running import running

ARITY = 2
#: So many ancestors or partition paths, of at most some 60 levels each, are broadcast;
#: more are posted once per block of so many leaves, so no join key has more rows.
FEW, BLOCK = 10_000, 1 << 12
#: A group of nodes that is built at once has at most this many.
GROUP = 256
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A column as it enters the leaf's hash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def lower_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The leaf of a row, as 32 bytes."""
    return digest(F.concat(*[field(c) for c in columns]))


def _height(n: str, arity: int) -> Column:
    """Levels above the leaves: the powers of the arity that are smaller than column n."""
    powers = [1]
    while powers[-1] * arity < 1 << 62:
        powers.append(powers[-1] * arity)
    return F.expr(f"size(filter(array({', '.join(map(str, powers))}), p -> p < {n}))")


def _power(level: Column, arity: int) -> Column:
    """arity^level; pow is exact for whole numbers up to 2^53."""
    return F.pow(F.lit(arity), level).cast("long")


def _parents(nodes: Column, arity: int) -> Column:
    """The level above an array of digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / arity).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.transform(F.slice(nodes, i * arity + 1, arity), lower_hex), "")))


def _with_segments(nodes: Column, arity: int) -> Column:
    """Array of (place, left, right): the members of a node's run before and after it."""
    join = lambda digests: F.aggregate(digests, F.unhex(F.lit("")), lambda a, d: F.concat(a, d))

    def one(_: Column, i: Column) -> Column:
        at = i % arity
        return F.struct(
            i.alias("place"),
            join(F.slice(nodes, i - at + 1, at)).alias("left"),
            join(F.slice(nodes, i + 2, arity - 1 - at)).alias("right"),
        )

    return F.transform(nodes, one)


def trees(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """``leaves`` (tree, idx, n, hash, payload) -> the nodes below the subroots, some
    levels per table, as (tree, height, level, idx, left, right, payload), and the
    subroots (tree, subroot). ``n`` is the number of leaves of the tree, idx a
    leaf's place from 0; ``payload`` stays with the leaf and is null above."""
    steps = max(s for s in range(1, 63) if s == 1 or arity**s <= GROUP)
    fan = arity**steps
    level, tables, tops = 0, [], []
    rows = leaves.select("tree", _height("n", arity).alias("height"), "idx", "hash", "payload")
    kind = rows.schema["payload"].dataType
    while True:
        # a written table each: (tree, height, block) with the levels of its nodes
        groups = rows.groupBy("tree", "height", F.floor(F.col("idx") / fan).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "hash", "payload"))).alias("members")
        )
        rise = F.least(F.lit(steps), F.col("height") - level)
        bottom = F.transform("members", lambda m: m["hash"])
        up = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.array(bottom),
            lambda done, j: F.when(j <= rise, F.concat(done, F.array(_parents(F.element_at(done, -1), arity)))).otherwise(done),
        )
        built = materialize(
            groups.select("tree", "height", "block", F.transform("members", lambda m: m["payload"]).alias("payloads"), up.alias("levels")),
            "merkle-levels",
        )
        # the last entry of levels is the top of the group; nodes below it get segments
        below = F.slice(F.col("levels"), 1, F.size("levels") - 1)
        flat = F.flatten(
            F.transform(
                below,
                lambda nodes, j: F.transform(
                    _with_segments(nodes, arity),
                    lambda s: F.struct(
                        (j + level).cast("int").alias("level"),
                        (F.col("block") * _power(F.lit(steps) - j, arity) + s["place"]).alias("idx"),
                        s["left"].alias("left"),
                        s["right"].alias("right"),
                        # a conditional lookup: only the bottom level has payloads
                        F.when(j == 0, F.get(F.col("payloads"), s["place"])).otherwise(F.lit(None).cast(kind)).alias("payload"),
                    ),
                ),
            )
        )
        tables.append(built.select("tree", "height", F.inline(flat)))
        top = F.element_at(F.element_at("levels", -1), 1)
        tops.append(built.where(F.col("height") <= level + steps).select("tree", top.alias("subroot"), F.when(F.col("height") == 0, F.col("payloads")[0]).alias("payload")))
        level += steps
        rows = built.where(F.col("height") > level).select("tree", "height", F.col("block").alias("idx"), top.alias("hash"), F.lit(None).cast(kind).alias("payload"))
        if rows.isEmpty():
            break
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.union(t)
    return tables, subroots


def _block(arity: int) -> Column:
    """The block of the first leaf below a node."""
    return F.floor(F.col("idx") * _power(F.col("level"), arity) / BLOCK)


def jump(tables: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """Nodes with segments -> the leaves (tree, idx, payload, path): ``path`` is the
    array of (left, right) from the leaf up to below the subroot."""
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.union(t)
    step = F.array(F.struct("left", "right")).alias("path")
    active = materialize(nodes.select("tree", "height", "level", "idx", "payload", (F.col("level") + 1).alias("up"), step), "merkle-jump")
    # one row per height: at most 62
    heights = active.where("level = 0").agg(F.max("height")).first()[0] or 0
    stride = 1
    while stride < heights:
        going = active.where(F.col("level") % (2 * stride) == 0)
        over = F.col("up") < F.col("height")
        asks = going.where(over).withColumn("to", F.floor(F.col("idx") / _power(F.col("up") - F.col("level"), arity)))
        ancestors = active.where(F.col("level") % (2 * stride) == stride).select(
            *[F.col(c).alias(f"_{c}") for c in ("tree", "level", "idx", "up", "path")]
        )
        same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_level")) & (F.col("to") == F.col("_idx"))
        if ancestors.count() <= FEW:
            ancestors = F.broadcast(ancestors)
        else:  # an ancestor is posted to every block that holds leaves below it
            width = _power(F.col("_level"), arity)
            blocks = F.sequence(F.floor(F.col("_idx") * width / BLOCK), F.floor(((F.col("_idx") + 1) * width - 1) / BLOCK))
            ancestors = ancestors.withColumn("_block", F.explode(blocks))
            asks = asks.withColumn("block", _block(arity))
            same = same & (F.col("block") == F.col("_block"))
        met = asks.join(ancestors, same).select("tree", "height", "level", "idx", "payload", F.col("_up").alias("up"), F.concat("path", "_path").alias("path"))
        active = materialize(met.union(going.where(~over).select(*met.columns)), "merkle-jump")
        stride *= 2
    return active.where("level = 0").select("tree", "idx", "payload", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda a, s: digest(F.concat(lower_hex(s["left"]), lower_hex(a), lower_hex(s["right"]))))


def proofs(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """``rows`` (part string, id, leaf binary, payload) -> (part, id, leaf, payload,
    path, subroot, root): every row with its proof. ``path`` holds, level by level
    from the leaf up to the root, the digests left and right of the node."""
    kept = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves").withColumn("one", F.lit(1).cast("long"))
    placed = running(kept, ["part"], ["id", "leaf", "row"], ["one"])
    leaves = placed.select(F.col("part").alias("tree"), F.col("before_one").alias("idx"), F.col("total_one").alias("n"), F.col("leaf").alias("hash"), F.struct("id", "leaf", "payload").alias("payload"))
    tables, tops = trees(leaves, arity)
    tops = materialize(tops, "merkle-subroots")
    lower = jump(tables, arity).select(F.col("tree").alias("part"), "idx", "payload", "path")
    # partitions of one row have no node below their subroot
    alone = tops.where(F.col("payload").isNotNull()).select(F.col("tree").alias("part"), F.lit(0).cast("long").alias("idx"), "payload", F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path"))
    below = lower.union(alone)

    # the same over the subroots, as one tree
    second = running(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("part"), "subroot", F.lit(1).cast("long").alias("one")), ["tree"], ["part"], ["one"])
    tables, top = trees(second.select("tree", F.col("before_one").alias("idx"), F.col("total_one").alias("n"), F.col("subroot").alias("hash"), F.struct("part", "subroot").alias("payload")), arity)
    root = top.select(F.col("subroot").alias("root"), "payload").first()  # one row: the root
    if root is None:
        return below.select("part", "payload.*", "path", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"))
    paths = jump(tables, arity).select("payload.part", "payload.subroot", F.col("path").alias("rest"))
    if root["payload"] is not None:  # one partition
        paths = tops.select(F.col("tree").alias("part"), "subroot", F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("rest"))
    paths = paths.withColumnRenamed("part", "_part")
    same = F.col("part").eqNullSafe(F.col("_part"))
    if tops.count() <= FEW:
        paths = F.broadcast(paths)
    else:  # a large partition's row is posted once per block of its leaves
        blocks = below.groupBy("part").agg(F.floor(F.max("idx") / BLOCK).alias("last"))
        paths = paths.join(blocks, same).select("_part", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("_block"), "subroot", "rest")
        same = same & (F.floor(F.col("idx") / BLOCK) == F.col("_block"))
    return below.join(paths, same).select("part", "payload.*", F.concat("path", "rest").alias("path"), "subroot", F.lit(bytes(root["root"])).alias("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), F.lit(False))
    other = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    rows = docs.select(
        F.col("lang").cast("string").alias("part"),
        F.col("doc_id").cast("long").alias("id"),
        leaf_hash([F.col(c) for c in COLUMNS]).alias("leaf"),
        F.when(tampered, leaf_hash([other.get(c, F.col(c)) for c in COLUMNS])).alias("payload"),
    )
    folded = fold(F.coalesce("payload", "leaf"), F.col("path"))
    told = proofs(rows).withColumn("folded", folded)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(lower_hex(s["left"]), lower_hex(s["right"]))), "")
    return told.select(
        F.col("id").alias("doc_id"),
        *[lower_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(siblings, 256).alias("proof_sha256"),
        lower_hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
