"""Connected components with DataFrame joins; every pass is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vidlake.llm.storage import drop, kept_as, save


def connected_components(edges: DataFrame, passes: int | None = None) -> DataFrame:
    """Components of an undirected graph.

    edges: (a, b). Returns (id, component) for every vertex of an edge; component is
    the smallest id of its component. Loops and repeated edges do nothing; without
    edges there are no rows. Each pass takes the least label of the neighbours and
    then the label's own label, so stars take two passes and chains about a logarithm.
    passes: stop after so many; ids with one label are then joined, but not all that are.
    """
    done = 0
    both = save(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "edges",
    )
    labels = save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near.hint("merge"), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = save(step, "step")
        up = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        moved = step.join(up.hint("merge"), "component").select("id", "was", F.least("component", "up").alias("component"))
        moved = save(moved, "labels")
        drop(step)
        drop(labels)
        labels = moved
        done += 1
        if done == passes or labels.where("component <> was").isEmpty():
            drop(both)
            return kept_as(labels.select("id", "component"), labels)
