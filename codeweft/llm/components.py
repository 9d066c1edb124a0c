"""Connected components of a link table, by minimum labels and pointer jumping in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id that links lead to, for every id that a link names.

    Ids may be of any type that Spark orders. Null ends and self-links are ignored, repeated links do no harm, and an
    empty table gives an empty result. Every round writes its labels to the shared folder: both inputs of each join
    are then plain exchanges, whose hot keys adaptive execution splits, and a lost executor repeats one round at most.
    The number of rounds grows with the logarithm of the longest path; the driver sees two counts a round.
    """
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    links = written(links.union(links.select("b", "a")).distinct())
    labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    changed = labels.limit(1).count()
    while changed:
        seen = links.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component")
        near = written(labels.union(seen).groupBy("id").agg(F.min("component").alias("component")))
        to = near.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = written(near.join(to, "component").select("id", F.col("next").alias("component")))
        moved = jumped.select("id", F.col("component").alias("now")).join(labels, "id").where("now != component")
        changed, labels = moved.limit(1).count(), jumped
    return labels
