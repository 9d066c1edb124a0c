"""A content-addressed cache of extraction results as a table: cache_key, payload (map of strings), artifact_hash, last_used_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import canonical_json
from codeweft.operators.changes import pruned, upserted


def entries(rows: DataFrame, cache_key: Column, payload: Column, at: Column) -> DataFrame:
    """Cache rows for what has just been extracted, sealed with a hash of the canonical payload."""
    return rows.select(cache_key.alias("cache_key"), payload.alias("payload"), F.sha2(canonical_json(payload), 256).alias("artifact_hash"), at.alias("last_used_at"))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    return upserted(cache, new, ["cache_key"])


def hits(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(cache_key, ...) with payload: null where there is no entry, or its seal doesn't hold."""
    sound = cache.where(F.sha2(canonical_json(F.col("payload")), 256) == F.col("artifact_hash")).select("cache_key", "payload")
    return wanted.join(sound, "cache_key", "left")


def touched(cache: DataFrame, used: DataFrame, at: Column) -> DataFrame:
    """The cache with last_used_at set for the keys that were used."""
    marked = cache.join(used.select("cache_key").distinct().withColumn("_used", F.lit(True)), "cache_key", "left")
    return marked.withColumn("last_used_at", F.when(F.col("_used"), at).otherwise(F.col("last_used_at"))).select(*cache.columns)


def kept(cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return pruned(cache, "last_used_at", as_of, days)
