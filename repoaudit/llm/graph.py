"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repoaudit.session import freeze

#: Short rows of a partition.
ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; the label is the least node that
    it reaches.

    Alternates two steps until nothing changes: each node hands its least neighbour to its
    larger neighbours, then to its smaller ones. The edges end as stars around the least node
    of each component. A step is an aggregate that combines before the shuffle and a join,
    whose hot keys Spark splits; no component is gathered in a task. Loops, repeated edges and
    an empty table are allowed; null ends are ignored.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = freeze(
        edges.where("a IS NOT NULL AND b IS NOT NULL")
        .select(high.alias("u"), low.alias("v"))
        .distinct()
    )
    before = _state(edges)
    parts = parts_for(before[0])  # a step makes at most one edge of an edge, and one of a node
    edges = edges.coalesce(parts)
    nodes = freeze(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().coalesce(parts))
    edges = edges.where("u <> v")
    while True:  # the number of rounds grows with the logarithm of the longest path
        edges = freeze(_small_star(_large_star(edges).coalesce(parts).distinct()).coalesce(parts).distinct().coalesce(parts))
        now = _state(edges)
        if now == before:
            break
        before = now
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select(
        "node", F.coalesce("label", "node").alias("label")
    ).coalesce(parts)


def parts_for(rows: int) -> int:
    """Partitions for so many short rows. A shuffle leaves a file per partition that it reads, and a
    frozen table one per partition that it has, so small tables are kept in few."""
    return max(1, -(-rows // ROWS))


def compact(df: DataFrame) -> DataFrame:
    """A frozen table of short rows in no more partitions than its rows need."""
    return df.coalesce(parts_for(df.count()))


def _state(edges: DataFrame) -> tuple:
    """Few numbers that change when the edges do."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = edges.select(ends.alias("_e")).select("_e.u", "_e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v")
