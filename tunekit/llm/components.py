"""Connected components of an edge table, by repeated contraction.

Every round sends each node to the neighbour (or itself) that comes first under a hash of the node and the round,
contracts the edges accordingly and writes both tables to the shared folder, so a lost executor costs one round at
most.  The random order shrinks long chains by a constant factor a round.  No neighbour list is ever gathered:
rounds are aggregations with map-side combining and joins that Spark can split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.sources.session import through_table


def _canonical(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; equal roots mean the same component.

    The root is some node of the component, not the smallest one.  Edges with a null end and self-loops say nothing
    and are left out; repeated edges count once.  An empty table gives an empty table.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    level = through_table(ends.select(*_canonical("a", "b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not level.isEmpty():
        turn = len(maps)

        def rank(node: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("n"))

        both = level.select("a", "b").union(level.select("b", "a"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        up = first.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("up"))
        up = through_table(up, "parents")
        maps.append(up)
        ups_a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        ups_b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        next_level = level.join(ups_a, "a").join(ups_b, "b").where("ua <> ub").select(*_canonical("ua", "ub"))
        level = through_table(next_level.distinct(), "edges")
    if not maps:
        return level.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("up").alias("root"))
    for up in reversed(maps[:-1]):
        above = roots.select(F.col("node").alias("up"), "root")
        roots = up.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots
