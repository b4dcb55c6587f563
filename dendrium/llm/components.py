"""Connected components of a graph in tables: smallest labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dendrium.llm.common import release, written


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): a table (node, comp) of all their nodes, comp being the smallest node that can be reached.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label. Labels
    are summed up map-side; every round is a written table, so a lost executor costs one round at most. Labels only fall,
    so the rounds end.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").select(F.col("a").alias("node"), F.col("near").alias("comp"), F.lit(None).cast("long").alias("was"))
        low = seen.union(labels.select("node", "comp", F.col("comp").alias("was"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("was").alias("was"))
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = Observation()
        new = low.join(jump, "comp", "left").select("node", F.least(F.coalesce("far", "comp"), "comp").alias("comp"), "was")
        new = written(new.observe(moved, F.max(F.col("comp") != F.col("was")).alias("any")).select("node", "comp"))
        release(labels)
        labels = new
        if not moved.get["any"]:
            release(both)
            return labels
