"""Connected components by randomised contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, settle


def _step(edges: DataFrame, order) -> DataFrame:
    """(node, rep): each node goes to the smallest, by ``order``, of itself and its neighbours."""
    pair = lambda c: F.struct(order(F.col(c)).alias("o"), F.col(c).alias("n"))
    both = edges.select(F.col("a").alias("node"), F.least(pair("a"), pair("b")).alias("least")).unionByName(edges.select(F.col("b").alias("node"), F.least(pair("a"), pair("b")).alias("least")))
    return both.groupBy("node").agg(F.min("least").alias("least")).select("node", F.col("least.n").alias("rep"))


def components(edges: DataFrame) -> DataFrame:
    """(node, rep) for every node of ``edges`` (a, b); nodes share a rep if and only if a path joins them.

    Each round maps every node to a neighbour that is least in a fresh random order and redraws the
    edges between the images, which keeps connectivity and leaves a constant share of the nodes; so
    the rounds grow as the logarithm of the largest component. A hub is one row of a partial minimum
    and one side of a join that splits skewed keys. Loops are allowed; no edges give no rows.
    """
    edges = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    left = edges.count()
    labels, turn, nodes = settle(_step(edges, lambda c: c), "labels", 2 * left), 0, 2 * left
    step = labels
    while True:
        at_a, at_b = step.select(F.col("node").alias("a"), F.col("rep").alias("ra")), step.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        last, edges = edges, settle(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges", left)
        release(last)
        if turn:
            release(step)
        if edges.isEmpty():
            release(edges)
            return labels
        turn, left = turn + 1, edges.count()
        order: Column = lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        step = settle(_step(edges, order), "step", 2 * left)
        onward = step.select(F.col("node").alias("rep"), F.col("rep").alias("next"))
        last, labels = labels, settle(labels.join(onward, "rep", "left").select("node", F.coalesce("next", "rep").alias("rep")), "labels", nodes)
        release(last)
