"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import written


def _ordered(edges: DataFrame) -> DataFrame:
    pair = edges.where(F.col("a") != F.col("b"))
    return pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _applied(frame: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """``column`` replaced by what ``hook`` maps it to, where it does."""
    step = hook.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
    moved = frame.join(step, frame[column] == F.col("_from"), "left")
    return moved.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (``a``, ``b``); the root is the smallest node.

    Each round hooks every node to its smallest neighbour, shortens the chains of hooks by
    doubling and contracts the edges, so that the edges left shrink quickly; the loop ends
    when none is left. Hot nodes are safe: the hooks are partial aggregates, and the joins
    leave their skewed side for Spark to split.
    """
    edges = written(edges.select("a", "b"))
    left, hooks = written(_ordered(edges)), []
    while not left.isEmpty():
        hook = written(left.groupBy("a").agg(F.min("b").alias("b")))
        for _ in range(len(hooks) + 1):
            hook = written(_applied(hook, "b", hook))
        hooks.append(hook)
        left = written(_ordered(_applied(_applied(left, "a", hook), "b", hook)))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for hook in hooks:
        nodes = _applied(nodes, "root", hook)
    return written(nodes)
