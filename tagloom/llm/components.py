"""Connected components of a graph given by links, by labels that shrink and double their reach each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, look_up


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of `links` (u, v): root is the smallest node that can be reached.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so the rounds
    grow with the logarithm of the longest path. Labels and links are written to the shared folder; a node with
    very many links and a label that very many nodes have are looked up without a shuffle (see look_up).
    """
    links = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    both = cut(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"))
    while True:
        # links meet the label of their other end, then the smallest is taken with partial sums first
        seen = look_up(both, labels.select(F.col("node").alias("v"), "root"), ["v"]).groupBy("u").agg(F.min("root").alias("near"))
        step = cut(labels.join(seen, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("low")))
        # a root learns the smallest label that any node under it has seen
        hooks = step.where("low < old").groupBy(F.col("old").alias("node")).agg(F.min("low").alias("hook"))
        step = cut(step.join(hooks, "node", "left").select("node", "old", F.least("low", F.coalesce("hook", "low")).alias("low")))
        new = cut(look_up(step, step.select(F.col("node").alias("low"), F.col("low").alias("root")), ["low"]).select("node", "old", "root"))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
