"""Connected components by contraction, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (src, dst), both long; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the chains by two jumps and relabels the links
    that are left, so their number falls geometrically. A relabelled graph has a component for each old one, whatever
    the number of jumps. Every step is a partial aggregation or an equality join whose other side has unique keys,
    which adaptive execution splits for a hub. Each round is written to the shared folder. Links with a null end and
    loops are dropped; no links give no rows.
    """
    edges = materialize(
        edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct(),
        "edges",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = materialize(
            both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("up")), "hooks"
        )
        jump = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
        hooks = materialize(hooks.join(jump, "up").select("node", F.col("over").alias("up")), "hooks")
        jump = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
        hooks = materialize(hooks.join(jump, "up").select("node", F.col("over").alias("up")), "hooks")
        renamed = hooks.select(F.col("node").alias("root"), F.col("up"))
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("root"))
        else:
            labels = materialize(labels.join(renamed, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        edges = materialize(
            edges.join(hooks.select(F.col("node").alias("src"), F.col("up").alias("a")), "src")
            .join(hooks.select(F.col("node").alias("dst"), F.col("up").alias("b")), "dst")
            .where("a <> b")
            .select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
            .distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return labels
