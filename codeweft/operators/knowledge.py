"""Versioned assertions about the graph: their validity, invalidation, review and revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import content_fingerprint
from codeweft.operators.changes import numbered

STATES = ("draft", "active", "stale", "rejected", "archived")


def not_expired(expires_at: Column, as_of: Column) -> Column:
    return expires_at.isNull() | (expires_at > as_of)


def usable(knowledge: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """knowledge(knowledge_key, state, expires_at, source_refs array<string>, source_hashes map) -> the unexpired rows with valid:
    active, and every reference is a node whose hash is the one captured. nodes(node_key, content_hash)."""
    live = knowledge.where(not_expired(F.col("expires_at"), as_of))
    refs = live.select("knowledge_key", F.explode_outer("source_refs").alias("node_key"), "source_hashes")
    seen = refs.join(nodes.select("node_key", "content_hash"), "node_key", "left")
    same = F.col("node_key").isNull() | F.coalesce(F.element_at("source_hashes", F.col("node_key")) == F.col("content_hash"), F.lit(False))
    proved = seen.groupBy("knowledge_key").agg(F.bool_and(same).alias("_same"))
    return live.join(proved, "knowledge_key").withColumn("valid", (F.col("state") == "active") & F.col("_same")).drop("_same")


def invalidated(knowledge: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """(knowledge_key, reason) of active and draft rows that no longer hold. changes(node_key, new_hash), a null hash for a removed
    key. Expiry goes first; then captured hashes in the order of their keys, a removal before a change of the same
    key; then references without a captured hash."""
    open_ = knowledge.where(F.col("state").isin("active", "draft"))
    hashes = open_.select("knowledge_key", F.posexplode_outer(F.array_sort(F.map_entries("source_hashes"))).alias("at", "e")).select("knowledge_key", F.lit(0).alias("step"), "at", F.col("e.key").alias("node_key"), F.col("e.value").alias("hash"))
    loose = open_.select("knowledge_key", "source_hashes", F.posexplode_outer("source_refs").alias("at", "node_key")).select("knowledge_key", F.lit(1).alias("step"), "at", "node_key", F.when(F.map_contains_key(F.coalesce("source_hashes", F.create_map().cast("map<string,string>")), F.coalesce("node_key", F.lit(""))), "captured").alias("hash"))
    hit = hashes.unionByName(loose).join(changes.withColumn("_changed", F.lit(1)), "node_key")
    reason = (
        F.when(F.col("new_hash").isNull(), F.concat(F.lit("removed: "), F.col("node_key")))
        .when((F.col("step") == 0) & (F.col("new_hash") != F.col("hash")), F.concat(F.lit("changed: "), F.col("node_key")))
        .when((F.col("step") == 1) & F.col("hash").isNull(), F.concat(F.lit("changed without capture: "), F.col("node_key")))
    )
    first = hit.withColumn("reason", reason).where("reason is not null").groupBy("knowledge_key").agg(F.min_by("reason", F.struct("step", "at")).alias("reason"))
    out = open_.select("knowledge_key", "expires_at").join(first, "knowledge_key", "left")
    return out.select("knowledge_key", F.when(F.col("expires_at") <= as_of, "expired").otherwise(F.col("reason")).alias("reason")).where("reason is not null")


def reviewed(knowledge: DataFrame) -> DataFrame:
    """Adds review: what a reviewer would find, without promoting anything."""
    proofs = F.size(F.map_keys(F.coalesce("source_hashes", F.create_map().cast("map<string,string>"))))
    return knowledge.withColumn("review", F.when(~F.col("state").isin("active", "draft"), "closed").when(proofs == 0, "unverified").otherwise("evidence"))


def evidence(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(name) -> (name, node_key, how): by key, else by a symbol that only one node has, else by file; ambiguous or unverified
    names have no key. nodes(node_key, symbol_name, file_path, node_type)."""
    by_key = nodes.select(F.col("node_key").alias("name"), F.col("node_key").alias("k"))
    by_symbol = nodes.where("symbol_name is not null").groupBy(F.col("symbol_name").alias("name")).agg(F.min("node_key").alias("s"), F.count(F.lit(1)).alias("n"))
    by_file = nodes.where("node_type = 'file'").select(F.col("file_path").alias("name"), F.col("node_key").alias("f"))
    rows = asked.join(by_key, "name", "left").join(by_symbol, "name", "left").join(by_file, "name", "left")
    how = F.when(F.col("k").isNotNull(), "key").when(F.col("n") == 1, "symbol").when(F.col("n") > 1, "ambiguous").when(F.col("f").isNotNull(), "file").otherwise("unverified")
    rows = rows.withColumn("how", how)
    return rows.select("name", F.when(F.col("how") == "key", F.col("k")).when(F.col("how") == "symbol", F.col("s")).when(F.col("how") == "file", F.col("f")).alias("node_key"), "how")


def recorded(drafts: DataFrame) -> DataFrame:
    """drafts(knowledge_key, kind, title, body, approve, proofs) -> with state, confidence and fingerprint: only proved and approved
    ones are active."""
    sure = F.col("approve") & (F.col("proofs") > 0)
    return drafts.withColumns({"state": F.when(sure, "active").otherwise("draft"), "confidence": F.when(sure, 0.9).when(F.col("proofs") > 0, 0.5).otherwise(0.0), "fingerprint": content_fingerprint(F.col("kind"), F.col("title"), F.col("body"))})


def catalogued(knowledge: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The rows of a catalogue that aren't recorded yet, as drafts."""
    return catalogue.join(knowledge.select("knowledge_key"), "knowledge_key", "left_anti").withColumn("state", F.lit("draft"))


def revised(knowledge: DataFrame, revisions: DataFrame) -> DataFrame:
    """knowledge(knowledge_key, lineage_key, version, state, body), revisions(previous_key, knowledge_key, body): each revision joins its
    lineage as the next version, active, and the row that it revises is archived. Revisions of unknown keys are left out."""
    old = knowledge.select(F.col("knowledge_key").alias("previous_key"), "lineage_key", "version")
    new = revisions.join(old, "previous_key").select("knowledge_key", "lineage_key", (F.col("version") + 1).alias("version"), F.lit("active").alias("state"), "body")
    done = revisions.select(F.col("previous_key").alias("knowledge_key"), F.lit(True).alias("_done")).distinct()
    archived = knowledge.join(done, "knowledge_key", "left").withColumn("state", F.when(F.col("_done"), "archived").otherwise(F.col("state")))
    return archived.select("knowledge_key", "lineage_key", "version", "state", "body").unionByName(new)


def reaffirmed(knowledge: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The named rows, active again, with the hashes that their references have now. A row with a reference that is gone stays as
    it is. knowledge(knowledge_key, state, source_refs, ...)."""
    asked = knowledge.where(F.col("knowledge_key").isin(keys)).select("knowledge_key", F.explode("source_refs").alias("node_key"))
    found = asked.join(nodes.select("node_key", "content_hash"), "node_key", "left")
    proved = found.groupBy("knowledge_key").agg(F.bool_and(F.col("content_hash").isNotNull()).alias("_all"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("node_key", "content_hash")))).alias("_hashes")).where("_all")
    joined = knowledge.join(proved, "knowledge_key", "left")
    return joined.withColumns({"state": F.when(F.col("_all"), "active").otherwise(F.col("state")), "source_hashes": F.coalesce("_hashes", "source_hashes")}).select(*knowledge.columns)


def last_verified(knowledge: DataFrame, most: int = 160) -> tuple[DataFrame, bool]:
    """The ``most`` entries that were verified last, those that never were at the end, equals by id; and whether there are more."""
    top = knowledge.orderBy(F.desc_nulls_last("verified_at"), "id").limit(most + 1)
    more = top.count() > most
    return top.orderBy(F.desc_nulls_last("verified_at"), "id").limit(most), more


def change_sets(log: DataFrame, drafts: DataFrame) -> DataFrame:
    """The log(id, intent, git_commit, changed_files, changed_symbols, expected_impact, actual_impact, validation_outcome, lessons) with drafts appended, numbered
    on from the last in order of intent. Lists that a draft leaves out are empty, other things that it leaves out null."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
    empty = F.array().cast("array<string>")
    lists = ("changed_files", "changed_symbols")
    rows = numbered(drafts, [F.col("intent")]).withColumn("id", F.col("number") + last)
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    rows = rows.select(*((F.coalesce(given(c).cast("array<string>"), empty) if c in lists else given(c)).cast(log.schema[c].dataType).alias(c) for c in log.columns))
    return log.unionByName(rows)
