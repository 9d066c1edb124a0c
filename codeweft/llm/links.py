"""From the partial results of cells to a row for each class: how many rows it links with, and its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import dealt
from codeweft.llm.components import connected_components

#: What a cell tells of each row that links with another: its class, the linked rows counted with their copies, and a
#: class that stands for its component within the cell.
PARTIAL = "k1 long, k2 long, links long, r1 long, r2 long"


def linked_classes(classes: DataFrame, partial: DataFrame) -> DataFrame:
    """classes(k1, k2, id, n): a class of n equal rows, id being the least of theirs; partial: rows as in PARTIAL.

    Returns (k1, k2, n_links, component_id, stands): the links of each row of the class, to its copies and to others, the
    least id of its component, and whether this class, the first by id (null last) and key, stands for its component.
    """
    counts = partial.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    links = partial.select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    component = connected_components(links).select("id.k1", "id.k2", F.col("component").alias("of"))
    joined = classes.join(counts, ["k1", "k2"], "left").join(component, ["k1", "k2"], "left")
    joined = joined.withColumn("of", F.coalesce("of", F.struct("k1", "k2"))).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    least = joined.groupBy("of").agg(F.min("id").alias("component_id"), F.struct(first["k1"].alias("k1"), first["k2"].alias("k2")).alias("first"))
    stands = (F.struct("k1", "k2") == F.col("first")).alias("stands")
    return joined.select("k1", "k2", "n_links", "of").join(dealt(least), "of").select("k1", "k2", "n_links", "component_id", stands)
