"""Set-based maintenance of keyed tables: differences, upserts, retirement, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.lineage import cut


def difference(old: DataFrame, new: DataFrame, key: str, content_hash: str) -> DataFrame:
    """(key, change) for each key on one side or both: added, removed, changed or same."""
    o = old.select(F.col(key), F.col(content_hash).alias("_old"), F.lit(1).alias("_o"))
    n = new.select(F.col(key), F.col(content_hash).alias("_new"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str] | None = None) -> DataFrame:
    """Old rows replaced by new ones of equal keys (nulls equal), and the rest of both; ``kept`` columns stay as in the old row."""
    kept = kept or []
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    o, n = old.withColumn("_old", F.lit(1)).alias("o"), new.withColumn("_new", F.lit(1)).alias("n")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() if c in kept else F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return o.join(n, on, "full_outer").select(*(pick(c) for c in old.columns))


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and those new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def combined_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each source, target and relationship: the most confident, ties by ``order``. Loops go; confidence is
    held between 0 and 1."""
    sound = edges.where("source_key != target_key").withColumn("confidence", F.least(F.lit(1).cast("decimal(3,2)"), F.greatest(F.lit(0).cast("decimal(3,2)"), F.col("confidence"))))
    keys = ["source_key", "target_key", "relationship"]
    rest = [c for c in edges.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("_c"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order))))
    # combined before the shuffle, so that an edge that many files declare is no hot key
    return sound.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*edges.columns)


def last_of_each(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(key, "_last.*")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a file that no edge touches."""
    used = edges.select(F.col("source_key").alias("node_key")).union(edges.select(F.col("target_key").alias("node_key")))
    return nodes.where("file_path is null").join(used, "node_key", "left_anti")


def retired(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_key, outcome) of nodes that are no longer declared: ``stub`` if an edge still leads to or from it, else ``deleted``."""
    used = edges.select(F.col("source_key").alias("node_key")).union(edges.select(F.col("target_key").alias("node_key"))).distinct().withColumn("_used", F.lit(1))
    return gone.select("node_key").join(used, "node_key", "left").select("node_key", F.when(F.col("_used").isNotNull(), "stub").otherwise("deleted").alias("outcome"))


def missing_files(indexed: DataFrame, live: DataFrame, roots: list[str]) -> DataFrame:
    """Indexed paths below a root that are gone; paths elsewhere are merely out of scope."""
    below = F.lit(False)
    for r in roots:
        below = below | (F.col("file_path") == r) | F.col("file_path").startswith(f"{r}/")
    return indexed.where(below).join(live.select("file_path"), "file_path", "left_anti")


def pruned(rows: DataFrame, used_at: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(used_at) >= as_of - F.make_interval(days=F.lit(days)))


def shared_rows(parts: DataFrame, key: str, source: str, values: Column) -> DataFrame:
    """What several sources contribute to one shared row: its sources and values, both sorted, and a hash of them."""
    out = parts.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("sources"), F.array_sort(F.collect_set(values)).alias("members"))
    return out.withColumn("content_hash", F.sha2(F.concat_ws("|", F.array_join("sources", ","), F.array_join("members", ",")), 256))


def forgotten(shared: DataFrame, source: str) -> DataFrame:
    """Shared rows without the members(name, source) that one source has contributed."""
    return shared.withColumn("members", F.filter("members", lambda m: m["source"] != source))


def duplicate_declarations(rows: DataFrame, identity: Column, owner: str) -> DataFrame:
    """(identity, owners) of what more than one owner declares."""
    found = rows.groupBy(identity.alias("identity")).agg(F.count_distinct(owner).alias("owners"))
    return found.where("owners > 1")


def versions(rows: DataFrame, lineage: str, order: str, key: str) -> DataFrame:
    """Version numbers within each lineage, with the keys of the version before and the one after."""
    w = Window.partitionBy(lineage).orderBy(order)
    return rows.withColumns({"version": F.row_number().over(w), "previous_key": F.lag(key).over(w), "superseded_by": F.lead(key).over(w)})


def modules_ensured(old: DataFrame, assigned: DataFrame) -> DataFrame:
    """old and assigned(module_key, name, root_path, metadata: map of strings): name and root as assigned, entries of the metadata that is
    there kept unless the new one has them, too. A key that is assigned more than once counts once, with its least name and root."""
    new = assigned.groupBy("module_key").agg(F.min(F.struct("name", "root_path")).alias("_at"), F.max_by("metadata", F.struct("name", "root_path")).alias("_new"))
    both = old.join(new, "module_key", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_at.{c}"), F.col(c)).alias(c)
    empty = F.create_map().cast("map<string,string>")
    under, over = F.coalesce("metadata", empty), F.coalesce("_new", empty)
    return both.select("module_key", pick("name"), pick("root_path"), F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over).alias("metadata"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their number in an order, from 1: sorted in ranges, each of which counts on from those before it. Equal rows get numbers of their own."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row a range
    joined = ranged.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return joined.withColumn("number", F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_ahead")
