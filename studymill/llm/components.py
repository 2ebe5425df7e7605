"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, gathered, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge (a, b): the smallest id reachable.

    Labels start as the smallest neighbour; each round takes the smallest label around and then the label's own label,
    so long paths shrink to a fraction in each round. A hot node is a hot join key, which the adaptive skew join splits;
    the minimum is combined before it is shuffled.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = stored(gathered(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component"))), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["u"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        of = labels.select(F.col("id").alias("at"), F.col("component").alias("up"))
        new = stored(gathered(step.join(of, step["to"] == of["at"]).select("id", "was", F.least("to", "up").alias("component"))), "labels")
        done = new.where("was <> component").isEmpty()
        forget(labels)
        labels = new.select("id", "component")
        labels._stored_at = new._stored_at
        if done:
            return labels
