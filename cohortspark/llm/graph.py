"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): one row per node of an edge; two
    nodes have one root exactly if a path joins them.

    Each round every node hooks to the neighbour (or itself) that is smallest
    in an order dealt anew from a hash of the round, nodes are replaced by
    their hooks, and loops and repeated edges go. A random order contracts a
    constant share of the remaining nodes, so a chain of n links needs about
    log n rounds. Hooks come from a partial min aggregate, joins are on the
    node with one row per node on one side (which AQE can split), and what a
    round leaves is written to the shared folder: no lineage grows and a lost
    executor costs one round at most. Loops, repeated edges and an empty table
    are fine.
    """
    spark = edges.sparkSession

    def frozen(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)

    def both_ways(df: DataFrame) -> DataFrame:
        turned = df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        return df.select("a", "b").where("a <> b").union(turned.where("a <> b")).distinct()

    left = frozen(both_ways(edges), "cc-edges")
    names = left.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    turn = 0
    while not left.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        hooks = frozen(
            left.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(F.col("m"), order("a"))["n"].alias("to")),
            "cc-hooks",
        )
        names = frozen(
            names.join(hooks.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")),
            "cc-names",
        )
        one = left.join(hooks, "a").select("b", F.col("to").alias("x"))
        two = one.join(hooks.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = frozen(two.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
    return names if turn else spark.createDataFrame([], "node long, root long")
