"""Files as rows: which are admitted, what they hash to, and which module they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.text import relative_path, safe_relative_path, under
from codeweft.operators.changes import numbered

MOST_BYTES = 512_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), bytes, content of all files below ``root``, through Spark's own file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    return files.select(relative_path(F.col("path"), base).alias("path"), F.col("length").alias("bytes"), "content")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Equal to a pattern or below it; a pattern of one segment excludes any path that has such a segment."""
    tests = [under(path, F.lit(p)) if "/" in p else F.array_contains(F.split(path, "/"), p) for p in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def accepted(path: Column, extensions: list[str]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return reduce(lambda a, b: a | b, (path.endswith(e) for e in extensions), F.lit(False)) & ~name.startswith(".env")


def admission(files: DataFrame, extensions: list[str], patterns: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds status: excluded, not_accepted, too_large or admitted."""
    p = F.col("path")
    status = F.when(excluded(p, patterns), "excluded").when(~accepted(p, extensions), "not_accepted").when(F.col("bytes") > most_bytes, "too_large").otherwise("admitted")
    return files.withColumn("status", status)


def live_hashes(files: DataFrame) -> DataFrame:
    """(path, live_hash) of files whose path stays below its base."""
    return files.where(safe_relative_path(F.col("path"))).select("path", F.sha2("content", 256).alias("live_hash"))


def unchanged(files: DataFrame, indexed: DataFrame, fingerprint: str) -> DataFrame:
    """Adds skip: the indexed hash and analyzer fingerprint both equal those of now. indexed(path, content_hash, fingerprint)."""
    known = indexed.select("path", F.col("content_hash").alias("_hash"), F.col("fingerprint").alias("_fp"))
    return files.join(known, "path", "left").withColumn("skip", F.coalesce((F.col("_hash") == F.col("content_hash")) & (F.col("_fp") == fingerprint), F.lit(False))).drop("_hash", "_fp")


def module_of(paths: DataFrame, modules: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds module_key: that of the longest configured path that the path equals or lies below, the first of equal ones; else
    the first two segments of the path. The configuration is part of the plan, as one expression."""
    flat = [(key, p.strip("/")) for key, roots in modules for p in roots if p.strip("/")]
    longest = sorted(flat, key=lambda x: -len(x[1]))  # stable: the first of equal length wins
    parts = F.split("path", "/")
    default = F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    found = reduce(lambda e, x: e.when(under(F.col("path"), F.lit(x[1])), x[0]), longest[1:], F.when(under(F.col("path"), F.lit(longest[0][1])), longest[0][0])) if longest else F.lit(None)
    return paths.withColumn("module_key", F.coalesce(found, default))


def module_of_rows(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same with prefixes(module_key, prefix) in a table of any size: each path is exploded into the prefixes that it
    has, and these are joined by equality."""
    parts = F.split("path", "/")
    steps = paths.select("path").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "module_key")
    best = steps.join(prefixes, "prefix").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("path", "module_key")
    default = F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    return paths.join(best, "path", "left").withColumn("module_key", F.coalesce("module_key", default))


def in_path_order(files: DataFrame) -> DataFrame:
    """Files with their number in order of their paths' code points."""
    return numbered(files, [F.col("path")])
