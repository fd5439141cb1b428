"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest reachable node.

    Each round every node takes the smallest label among its neighbours', then its label's own label,
    which doubles the distance that labels travel. Rounds are stored, so a lost executor costs one
    round at most. Hubs cost little, as labels are reduced map-side per node.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select(
            "node", F.least("component", "near").alias("next"), F.col("component").alias("old")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = stored(step.join(jump, "next", "left").select("node", F.coalesce("far", "next").alias("component"), "old"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
