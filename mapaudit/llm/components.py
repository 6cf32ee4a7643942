"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapaudit.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of the links: label is the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours (a combining aggregate, so a node
    with very many links sends one row per task) and then jumps to that label's label, so a chain
    halves. Rounds are written tables; nothing is collected but the flag that ends the loop. Links
    holding a null are ignored; repeated links and loops change nothing.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m"))
                 .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = (edges.join(labels.select(F.col("node").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("label").alias("seen")))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("jump"))
        after = cut(
            labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("best"))
            .join(jump, "best")
            .select("node", F.least("best", "jump").alias("label"), (F.least("best", "jump") < F.col("label")).alias("moved")),
            "labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
