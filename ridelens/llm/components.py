"""Connected components of an edge list by repeated contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, component): equal component for all nodes of a component.

    Every round each node hooks onto its smallest neighbour (or itself) and the graph of hooks is contracted.
    Node numbers should carry no order of the data (hash them first): then the number of nodes left falls by a
    constant factor a round, whatever the shape. Each round's small tables are written to the shared folder and removed
    once the next round's are.
    Nodes in no edge are not returned. Hubs are aggregated before the shuffle; joins on them rely on AQE's
    skew handling.
    """
    left = materialize(edges.where("a <> b").select("a", "b").union(
        edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    while True:
        hooks = materialize(left.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("component")), "cc-hooks")
        if labels is None:
            labels = hooks
        else:
            step, old = hooks.select(F.col("node").alias("component"), F.col("component").alias("next")), labels
            labels = materialize(labels.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")), "cc-labels")
            discard(old)
        x = hooks.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        y = hooks.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        old = left
        left = materialize(left.join(x, "a").join(y, "b").where("ca <> cb").select(
            F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "cc-edges")
        discard(old)
        if labels is not hooks:
            discard(hooks)
        if left.isEmpty():
            return labels
