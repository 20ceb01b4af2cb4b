"""Connected components of links by hooking and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Most labels that are broadcast (16 MB); beyond it they are joined by shuffles.
BROADCAST_LABELS = 1_000_000
#: Links per file.
FILE_ROWS = 250_000


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Each round a node takes the smallest label among its neighbours, then the label
    of its label. Rounds grow with the logarithm of the longest path. A node with
    very many links is pre-aggregated by tasks and split by skewed joins.
    """
    files = max(1, 2 * links.count() // FILE_ROWS)
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = space.write(both.coalesce(files), f"{name}-links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    labels = space.write(first.coalesce(files), f"{name}-0")
    nodes = labels.count()

    def side(frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if nodes <= BROADCAST_LABELS else frame

    total, turn = _total(labels), 0
    while total is not None:
        turn += 1
        near = both.join(side(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(side(near), labels["node"] == near["a"]).select("node", F.least("component", "near").alias("via"))
        hooked = space.write(hooked.coalesce(files), f"{name}-{turn}-hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("via").alias("top"))
        jumped = hooked.join(side(up), hooked["via"] == up["up"], "left").select(
            "node", F.least("via", F.coalesce("top", "via")).alias("component")
        )
        labels = space.write(jumped.coalesce(files), f"{name}-{turn}")
        now = _total(labels)
        space.drop(f"{name}-{turn}-hooked")
        space.drop(f"{name}-{turn - 1}")
        if now == total:
            break
        total = now
    return labels


def _total(labels: DataFrame):
    """The labels' sum, which falls until nothing changes; null without labels."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
