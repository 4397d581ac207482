"""Connected components of a graph in Spark, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.store import discard, materialize


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of the component.

    In each round a node takes the least label among itself and its neighbours, then the label of its label, so paths
    shorten by powers of two. Labels are aggregated before they are shuffled, so a hub is no hot spot, and every round
    is a written table. A null end is no node.
    """
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    # Both directions come from one evaluation of an edge: where edges depend on the order of rows, two might not agree.
    both = edges.filter("u is not null and v is not null").select(F.inline(ends)).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("_near"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("_low"))
        lower = materialize(lower, "lower")
        jump = lower.select(F.col("node").alias("_at"), F.col("_low").alias("_next"))
        jumped = lower.join(jump, F.col("_low") == F.col("_at"), "left")
        new = materialize(jumped.select("node", "_was", F.least("_low", "_next").alias("root")), "labels")
        changed = new.filter("root != _was").limit(1).count()
        discard(labels, lower)
        labels = new
        if not changed:
            discard(both)
            return labels.select("node", "root")
    raise RuntimeError(f"components have not settled after {rounds} rounds")
