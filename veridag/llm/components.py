"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridag.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each id of the undirected edges (a, b); comp is the smallest id that links reach.

    Each round takes the smallest label among the neighbours, then the label of that label, and is stored; the loop
    ends when a round changes nothing.  Labels never leave the cluster.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        seen = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        of = labels.select(F.col("id").alias("of_id"), F.col("comp").alias("of_comp"))
        jumped = seen.join(of, seen["comp"] == of["of_id"], "left").select("id", "old", F.least("comp", F.coalesce("of_comp", "comp")).alias("comp"))
        jumped = stored(jumped)
        labels = jumped.select("id", "comp")
        if jumped.where("old <> comp").isEmpty():
            return labels
