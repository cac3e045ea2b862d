"""Connected components of links between things, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import cut


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable from each id.

    ``nodes`` has ``id``, ``edges`` has ``a`` and ``b``, in either direction, once or more often; edges between nodes
    that aren't listed add them. Null ids are ignored; a node without edges is its own component. Each round takes the
    least label among neighbours, then jumps to that label's label, so paths shorten by doubling; rounds are
    checkpointed and stop when nothing changed. Labels are aggregated before they are shuffled (a node with a third of
    all edges sends one partial minimum per task).
    """
    both = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = cut(both)
    ids = nodes.select("id").where("id IS NOT NULL").unionByName(links.select(F.col("a").alias("id"))).distinct()
    # only nodes with edges take part in the rounds
    labels = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "new", "left").select("id", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")))
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return ids.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
