"""Dependency graphs: what a payload needs, cycles, and chains of predictors.

Levels are joins with a checkpoint between them, so neither a recursion limit nor a row limit ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.session import shared_dir


def _saved(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, needs, depth) of everything that a node depends on, each once at its least depth; itself at depth 0.

    nodes has id; edges has id and parent. A cycle ends where all of it has been seen.
    """
    steps = edges.select(F.col("id").alias("needs"), F.col("parent")).distinct()
    seen = front = _saved(nodes.select(F.col("id").alias("node"), F.col("id").alias("needs"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        further = front.join(steps, "needs").select("node", F.col("parent").alias("needs")).distinct()
        front = _saved(further.join(seen.select("node", "needs"), ["node", "needs"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def cyclic(edges: DataFrame) -> DataFrame:
    """The nodes (id) from which a cycle is reached: those that are left when nodes without open parents go, again and again."""
    left = _saved(edges.select("id", "parent").distinct())
    n = left.count()
    while n:
        left = _saved(left.join(left.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id", "parent"))
        if (now := left.count()) == n:
            break
        n = now
    return left.select("id").distinct()


def violations(nodes: DataFrame, edges: DataFrame, frame: str, parents: int = 1) -> DataFrame:
    """(id, rule) of each broken rule of a payload graph: repeated_id, missing_parent, other_frame, many_parents, cycle."""
    known = nodes.select(F.col("id").alias("parent"), F.col(frame).alias("parent_frame"))
    both = edges.select("id", "parent").join(nodes.select("id", F.col(frame).alias("own_frame")), "id").join(known, "parent", "left")
    found = [
        ("repeated_id", nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")),
        ("missing_parent", both.where("parent_frame is null")),
        ("other_frame", both.where("parent_frame <> own_frame")),
        ("many_parents", edges.groupBy("id").agg(F.count_distinct("parent").alias("n")).where(F.col("n") > parents)),
        ("cycle", cyclic(edges)),
    ]
    out = None
    for rule, rows in found:
        own = rows.select("id").distinct().withColumn("rule", F.lit(rule))
        out = own if out is None else out.unionByName(own)
    return out


def predictors(position: Column, reset: int) -> Column:
    """Positions that a frame's prediction goes back through, from its group's first frame up to itself."""
    return F.sequence(F.floor(position / reset) * reset, position)
