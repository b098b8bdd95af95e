"""Connected components of a link table, by repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import forget, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges(a, b): component is the least id that can be reached.

    Each round every node takes the least label among its own and its neighbours', then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Only partial aggregates and joins
    that adaptive execution can split meet a hub's many links. Every round is a table in the shared folder; nothing
    is sent to the driver but whether a label changed. Null ids have no links. No edges: an empty table.
    """
    both = stored(
        edges.select("a", "b")
        .union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a is not null and b is not null")
        .distinct()
    )
    n = both.count()
    first = F.least(F.col("a"), F.min("b")).alias("component")
    labels = stored(both.groupBy("a").agg(first).select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("old")), rows=n)
    for _ in range(max_rounds):
        own = labels.select("id", "component")
        heard = both.join(own.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("heard"))
        nearer = own.join(heard, "id").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        root = own.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = nearer.join(root, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component"), "old")
        jumped = stored(jumped, rows=n)
        changed = jumped.where("component <> old").limit(1).count()
        forget(labels)
        labels = jumped
        if not changed:
            forget(both)
            return labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
