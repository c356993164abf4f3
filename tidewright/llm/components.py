"""Connected components by contraction: every join and every written table is distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.storage import dropped, written


def _rooted(parent: DataFrame) -> DataFrame:
    """(x, p) with p < x, made to point at roots by pointer jumping."""
    while True:
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        jumped = written(parent.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "roots")
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        parent = jumped.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every node of ``edges`` (a, b): c is the smallest node it is linked with.

    Each round every node with a smaller neighbour takes the smallest one as its parent, trees
    are flattened, and edges are redrawn between the roots; it ends when no edge is left."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), "labels")
    while not edges.isEmpty():
        parent = _rooted(written(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p")), "parents"))

        def at_root(df: DataFrame, column: str, parent: DataFrame = parent) -> DataFrame:
            up = parent.select(F.col("x").alias(column), F.col("p").alias("_p"))
            return df.join(up, column, "left").withColumn(column, F.coalesce("_p", column)).drop("_p")

        moved = at_root(at_root(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        old = (edges, labels)
        edges, labels = written(moved, "edges"), written(at_root(labels, "c").select("v", "c"), "labels")
        dropped(*old)
    return labels
