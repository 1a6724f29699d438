"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import materialized

_MAX_ROUNDS = 200


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``: the smallest node reachable.

    Each round every node hooks to its smallest neighbour, hooks are followed
    one step further, and the links are contracted: both ends are replaced by
    what they hooked to, links inside a group and repeated links disappear.  A
    dense group is therefore read in full once only.  Minima are combined
    before the shuffle and each round is written to the shared folder, so a
    hot node is neither collected nor recomputed.
    """
    edges = materialized(links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    labels = materialized(edges.select(F.col("u").alias("node"))
                          .union(edges.select("v")).distinct()
                          .withColumn("root", F.col("node")), "labels")
    for _ in range(_MAX_ROUNDS):
        if edges.limit(1).count() == 0:
            return labels
        # v > u: v can hook to u; u hooks to nothing over this link
        hook = edges.groupBy("v").agg(F.min("u").alias("up"))
        hook = materialized(hook, "hooks")
        far = hook.select(F.col("v").alias("mid"), F.col("up").alias("far"))
        hook = materialized(hook.join(far, F.col("up") == F.col("mid"), "left")
                            .select("v", F.coalesce("far", "up").alias("up")), "hooks")
        labels = materialized(
            labels.join(hook, F.col("root") == F.col("v"), "left")
            .select("node", F.coalesce("up", "root").alias("root")), "labels")
        left = hook.select(F.col("v").alias("lv"), F.col("up").alias("lu"))
        right = hook.select(F.col("v").alias("rv"), F.col("up").alias("ru"))
        ends = (edges.join(left, F.col("u") == F.col("lv"), "left")
                .join(right, F.col("v") == F.col("rv"), "left")
                .select(F.coalesce("lu", "u").alias("x"), F.coalesce("ru", "v").alias("y"))
                .filter("x <> y"))
        edges = materialized(ends.select(F.least("x", "y").alias("u"),
                                         F.greatest("x", "y").alias("v")).distinct(), "edges")
    raise RuntimeError("component labels did not settle")
