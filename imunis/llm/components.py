"""Connected components of a graph given as edges, by joins.

Each round gives every node the least label among its neighbours' and then
follows the labels one step, until nothing changes. Degrees may be as skewed as
they like: neighbours are aggregated map-side and labels are joined from
materialised tables, whose skewed keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imunis.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): component is the least node that is reachable."""
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges", slim=True)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                         .select("node", F.least("node", "b").alias("component")), "labels", slim=True)
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        now = (labels.join(near, "node").join(hop, "component", "left")
               .select("node", F.least("component", "near", F.coalesce("hop", "component")).alias("now"), "component"))
        labels = materialize(now, "labels", slim=True)
        if labels.filter("now <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", F.col("now").alias("component"))
