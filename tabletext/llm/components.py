"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletext.llm.common import drop_written, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Each round maps every node to the smallest of itself and its neighbours and contracts the links by that map, so the
    links shrink until none is left. No neighbour list is ever gathered: a node with many links is a sum of minima.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), f"{name}-links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    labels = written(labels, f"{name}-labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        step = written(step, f"{name}-step")
        old = labels, edges
        labels = written(
            labels.join(step, F.col("root") == F.col("a"), "left").select("node", F.coalesce("to", "root").alias("root")),
            f"{name}-labels",
        )
        edges = written(
            edges.join(step, "a")
            .select(F.col("to").alias("x"), "b")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            f"{name}-links",
        )
        for df in (*old, step):
            drop_written(df)
    # the smallest label met is the root of the contraction; the smallest node of the component is its name
    first = labels.groupBy("root").agg(F.min("node").alias("first"))
    return labels.join(first, "root").select("node", F.col("first").alias("root"))
