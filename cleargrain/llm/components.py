"""Connected components by minimum labels with pointer jumping, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.shared import settled


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Each round every node takes the smallest label among its own and its neighbours', then its label's label. Rounds end
    when no label changes. Edges may repeat and may be loops. An empty table of edges gives an empty result.
    """
    both = settled(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges"
    )
    labels = settled(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["x"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("jump"))
        jumped = hooked.join(target, hooked["label"] == target["t"]).select("node", "was", F.least("label", "jump").alias("label"))
        jumped = settled(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
