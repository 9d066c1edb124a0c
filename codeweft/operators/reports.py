"""Counts, histograms, health and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.scoring import evidence_matches, same_evidence


def histogram(rows: DataFrame, by: str, example: str, most: int = 3) -> DataFrame:
    """(by, n, examples): how many rows each value has, and the first ``most`` examples in order."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(example))).where(F.col("_rank") <= most)
    return counts.join(first.groupBy(by).agg(F.array_sort(F.collect_list(example)).alias("examples")), by)


def telemetry(rows: DataFrame, latency: str, size: str) -> DataFrame:
    """One row: runs, mean latency (0 without runs), sum of sizes and the tokens that these stand for."""
    total = F.coalesce(F.sum(size), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 2).alias("mean_latency"), total.alias("characters"), F.ceil(total / 4).alias("tokens"))


def health(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """live(path, content_hash), indexed(path, content_hash) -> (status, n): fresh, changed, missing on disk, not indexed."""
    both = live.select("path", F.col("content_hash").alias("l")).join(indexed.select("path", F.col("content_hash").alias("i")), "path", "full_outer")
    status = F.when(F.col("l").isNull(), "missing").when(F.col("i").isNull(), "not_indexed").when(F.col("l") == F.col("i"), "fresh").otherwise("changed")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, order: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(most)


def evaluated(retrieved: DataFrame, expected: DataFrame, k: int = 8) -> DataFrame:
    """retrieved(scenario, position, identity), expected(scenario, item) -> a row for each scenario that expects something: recall and
    precision among the first k, recall in the whole packet, and the reciprocal of the first relevant position."""
    items = expected.select("scenario", F.lower(F.translate("item", "\\", "/")).alias("item")).distinct()
    pairs = items.join(retrieved, "scenario", "left").withColumn("hit", F.coalesce(evidence_matches(F.col("item"), F.col("identity")), F.lit(False)))
    by_item = pairs.groupBy("scenario", "item").agg(F.max(F.col("hit") & (F.col("position") <= k)).alias("top"), F.max("hit").alias("any"))
    recall = by_item.groupBy("scenario").agg(F.round(F.avg(F.coalesce(F.col("top"), F.lit(False)).cast("int")), 4).alias("recall_at_k"), F.round(F.avg(F.col("any").cast("int")), 4).alias("recall_in_packet"))
    by_source = pairs.where(F.col("position") <= k).groupBy("scenario", "position").agg(F.max("hit").alias("hit"))
    precision = by_source.groupBy("scenario").agg(F.round(F.avg(F.col("hit").cast("int")), 4).alias("precision_at_k"), F.round(1 / F.min(F.when(F.col("hit"), F.col("position"))), 4).alias("rr"))
    out = recall.join(precision, "scenario", "left")
    return out.select("scenario", "recall_at_k", "recall_in_packet", F.coalesce("precision_at_k", F.lit(0.0)).alias("precision_at_k"), F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"))


def evaluated_packets(packets: DataFrame, expected: DataFrame, k: int = 8) -> DataFrame:
    """evaluated() of packets(scenario, identities), whose identities are an array for each position: each expected item meets its packet once, and no row
    is made of a pair."""
    one_form = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    items = expected.select("scenario", one_form(F.col("item")).alias("item")).distinct()
    told = packets.select("scenario", F.transform("identities", lambda at: F.transform(at, one_form)).alias("told"))
    shown = F.size(F.filter(F.slice("told", 1, k), lambda at: F.size(at) > 0))  # a position without identities is none
    pairs = items.join(told, "scenario", "left").withColumn("told", F.coalesce("told", F.array().cast("array<array<string>>"))).withColumns({
        "at": F.filter(F.transform("told", lambda at, i: F.when(F.exists(at, lambda x: F.coalesce(x.contains(F.col("item")) & same_evidence(F.col("item"), x), F.lit(False))), i + 1)), lambda x: x.isNotNull()), "shown": shown,
    })
    top = F.filter("at", lambda x: x <= k)
    rows = pairs.select("scenario", "shown", top.alias("top"), (F.size("at") > 0).alias("any"))
    # of the places among the first k there are few different sets
    judged = rows.groupBy("scenario").agg(F.avg((F.size("top") > 0).cast("int")).alias("recall_at_k"), F.avg(F.col("any").cast("int")).alias("recall_in_packet"), F.max("shown").alias("shown"), F.array_distinct(F.flatten(F.collect_set("top"))).alias("hits"))
    share = F.coalesce(F.when(F.col("shown") > 0, F.round(F.size("hits") / F.col("shown"), 4)), F.lit(0.0))
    first = F.coalesce(F.round(1 / F.array_min("hits"), 4), F.lit(0.0))
    return judged.select("scenario", *(F.round(c, 4).alias(c) for c in ("recall_at_k", "recall_in_packet")), share.alias("precision_at_k"), first.alias("reciprocal_rank"))


def means(results: DataFrame) -> DataFrame:
    names = ("recall_at_k", "recall_in_packet", "precision_at_k", "reciprocal_rank")
    return results.agg(F.count(F.lit(1)).alias("scenarios"), *(F.round(F.coalesce(F.avg(n), F.lit(0.0)), 4).alias(f"mean_{n}") for n in names))


def fresh_nodes(nodes: DataFrame, live: DataFrame, paths: Column) -> DataFrame:
    """Adds fresh: the node has paths, and each of them is live with the hash that the node was read from. live(path, live_hash)."""
    each = nodes.select("node_key", "content_hash", F.explode_outer(paths).alias("path")).join(live, "path", "left")
    same = F.coalesce(F.col("live_hash") == F.col("content_hash"), F.lit(False))
    return nodes.join(each.groupBy("node_key").agg(F.bool_and(same).alias("fresh")), "node_key", "left")


def unresolved_sites(methods: DataFrame, most: int = 3) -> DataFrame:
    """methods(method_key, unresolved) -> one row: calls that lead nowhere known, the methods that have any, and the first ``most`` of these by key."""
    some = methods.where("unresolved > 0").select(F.concat(F.regexp_replace("method_key", "^method:", ""), F.lit(" ("), F.col("unresolved").cast("string"), F.lit(")")).alias("shown"), "unresolved")
    first = some.orderBy("shown").limit(most).agg(F.array_join(F.array_sort(F.collect_list("shown")), " ").alias("examples"))
    total = some.agg(F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.count(F.lit(1)).alias("methods"))
    return total.join(F.broadcast(first))  # one row each


def compared(results: DataFrame) -> DataFrame:
    """results(full_source_estimated_tokens, estimated_context_tokens) of an evaluation -> one row of their sums, and what providers reported, which is
    nothing here."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    unknown = ("provider_reported_input_tokens", "provider_reported_output_tokens", "cached_tokens")
    return results.agg(total("full_source_estimated_tokens").alias("full_source_estimated_tokens"), total("estimated_context_tokens").alias("project_memory_estimated_tokens")).select("*", *(F.lit(None).cast("long").alias(c) for c in unknown))
