"""Connected components of an edge table, in rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """a, b (long) -> node, root: the smallest node of each node's component. Nodes without an edge have no row.

    In a round every node points to its smallest neighbour, if that is smaller, and edges are redrawn between
    the nodes pointed to until none is left.  Minima are pre-aggregated, so a hub with very many edges is no hot task."""
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        to = keep(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("to")))
        end = lambda c: F.coalesce(F.col(f"to_{c}"), F.col(c))
        drawn = edges
        for c in ("a", "b"):
            drawn = drawn.join(to.select(F.col("x").alias(f"x_{c}"), F.col("to").alias(f"to_{c}")), F.col(c) == F.col(f"x_{c}"), "left")
        edges = keep(drawn.select(F.least(end("a"), end("b")).alias("a"), F.greatest(end("a"), end("b")).alias("b")).where("a <> b").distinct())
        labels = keep(labels.join(to, F.col("root") == F.col("x"), "left").select("node", F.coalesce("to", "root").alias("root")))
    return labels
