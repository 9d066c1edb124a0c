"""Incremental synchronisation of a stored graph with a set of files: one set-based difference, published whole or not at all.

Edges and contributions to shared tables are kept for each file that states them, so that what one file takes back doesn't touch
what another still says; the graph that readers see is combined from them. An edit costs what it touches: nodes and edges of
the edited files, the calls that may lead elsewhere since, shared tables that gained or lost a contribution, and the hash buckets that
hold these. ``tests/test_plans.py`` holds a row of edits against a full run.
"""

from __future__ import annotations

import hashlib
import inspect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators import changes, extract, graph, knowledge, receivers, routing, semantics, tokens
from codeweft.operators.lineage import cut, spread
from codeweft.plans import source_graph
from codeweft.sources.files import unchanged
from codeweft.store import LeaseLost, Part, SnapshotStore, bucket_of

#: Names the extractors as they are: when one changes, stored files count as changed.
FINGERPRINT = hashlib.sha256("".join(map(inspect.getsource, (extract, receivers, routing, semantics, source_graph, tokens))).encode()).hexdigest()[:16]
NODES = f"{extract.NODE}, stub boolean"
EDGES = "source_key string, target_key string, relationship string, confidence decimal(3,2), file_path string, resolution string, original_target string, via string"
MARKS = "class_key string, file_path string, facade_accessor string, accessor_kind string, model boolean, form_request boolean"
BINDINGS = "file_path string, abstract string, concrete string"
META = "identity string"
FILES = "path string, content_hash string, fingerprint string"
RUNS = "run int, scope string, status string, scanned long, updated long, skipped long, deleted long, errors array<string>"
#: A class looks for a method through so many ancestors at most; so far a change is felt by those below.
MOST_LEVELS = 32


@dataclass
class Run:
    status: str
    updated: int = 0
    skipped: int = 0
    deleted: int = 0
    errors: tuple[str, ...] = ()


def sync(store: SnapshotStore, files: DataFrame, roots: list[str], scope: str = "incremental", force: bool = False, fingerprint: str = FINGERPRINT, as_of: Column | None = None, identity: str | None = None) -> Run:
    """files(path, text): all admitted files of now. Files of equal hash and fingerprint are skipped unless ``force``.

    A declaration that two files make is an error, and any error leaves the stored graph as it is. Nodes that a changed or
    deleted file no longer declares become stubs while an edge leads to them and go otherwise; unknown ends of edges
    become stubs. Calls of methods that a class inherits lead to the declaring one. Tables are what all migrations say of them.
    Stored knowledge that rests on what changed is invalidated in the same version. A store that was made for another
    ``identity`` is left alone, and so is one whose lease another writer takes over before the end (``lost``).
    """
    if not store.lock():
        return Run("locked")
    try:
        held = store.read("meta").first()["identity"] if store.has("meta") else None
        if held is not None and identity is not None and held != identity:
            return Run("refused", errors=(f"the store belongs to {held}",))
        return _sync(store, files, roots, scope, force, fingerprint, as_of, identity or held)
    except LeaseLost as lost:
        return Run("lost", errors=(str(lost),))
    finally:
        store.unlock()


def graph_edges(store: SnapshotStore) -> DataFrame:
    """The edges that readers see: of several files that state one edge, the surest statement counts."""
    return changes.combined_edges(store.read("edges"), ["file_path", "original_target"])


def annotated_edges(store: SnapshotStore) -> DataFrame:
    """graph_edges() with what is known of calls through facades, calls that models hand on to their query, and form requests: resolution,
    resolution_state, facade_accessor, accessor_kind, bound_concrete, forward_receiver. Derived on reading, so it is never behind."""
    marks, bound = store.read("marks"), store.read("bindings")
    classes = store.read("nodes").where("node_key like 'class:%'").select(F.col("node_key").alias("class_key"))
    rows = graph_edges(store)
    is_call = F.col("relationship") == "calls"
    calls = semantics.facade_calls(rows.where(is_call), marks.select("class_key", "facade_accessor", "accessor_kind"), bound.select("abstract", "concrete"), classes)
    calls = semantics.builder_forwards(calls, marks.where("model").select("class_key"), receivers.QUERY_CALLS + receivers.COLLECTION_CALLS + receivers.MODEL_CALLS)
    calls = calls.withColumn("resolution_state", F.when(F.col("resolution") == "framework_type", "external").otherwise(F.col("resolution_state")))
    others = rows.where(~is_call).withColumn("resolution_state", F.lit(None).cast("string"))
    return calls.unionByName(semantics.form_requests(others, marks.where("form_request").select("class_key")), allowMissingColumns=True)


def _sync(store: SnapshotStore, files: DataFrame, roots: list[str], scope: str, force: bool, fingerprint: str, as_of, identity: str | None) -> Run:  # noqa: ANN001
    spark, base = store.spark, store.version()
    stored = lambda name, schema: (d if (d := store.read(name)) is not None else spark.createDataFrame([], schema))
    old_files, old_nodes, old_edges, old_shared, runs = stored("files", FILES), stored("nodes", NODES), stored("edges", EDGES), stored("shared", extract.SHARED), stored("runs", RUNS)
    live = spread(unchanged(files.withColumn("content_hash", F.sha2("text", 256)), old_files, fingerprint))
    todo = live if force else live.where("not skip")
    missing = cut(changes.missing_files(old_files.withColumnRenamed("path", "file_path"), live.select(F.col("path").alias("file_path")), roots).select(F.col("file_path").alias("path")))
    counts = {"updated": todo.count(), "scanned": live.count(), "deleted": missing.count()}
    counts["skipped"] = counts["scanned"] - counts["updated"]
    number = runs.count() + 1
    errors: list[str] = []
    log = lambda status: runs.unionByName(spark.createDataFrame([(number, scope, status, counts["scanned"], counts["updated"], counts["skipped"], counts["deleted"], errors)], RUNS))
    meta = {"meta": spark.createDataFrame([(identity,)], META)} if identity else {}
    if base and not counts["updated"] and not counts["deleted"]:
        store.publish({"runs": log("completed")} | meta, base)
        return Run("completed", 0, counts["skipped"], 0)
    touched = cut(todo.select(F.col("path").alias("file_path")).union(missing.select(F.col("path").alias("file_path"))).distinct())
    in_touched = lambda df: df.join(touched, "file_path", "left_semi").select(*df.columns)
    beside = lambda df: df.join(touched, "file_path", "left_anti").select(*df.columns)

    if counts["updated"]:
        found = source_graph.read_files(todo.select("path", "text"))
    else:
        found = source_graph.Reading(*(spark.createDataFrame([], x) for x in (extract.NODE, EDGES, extract.SHARED, MARKS, BINDINGS)))
    nodes = cut(found.nodes.withColumn("stub", F.lit(False)).select(*old_nodes.columns))
    said, contributed = cut(per_file(found.edges)), cut(found.shared)
    before, said_before = cut(in_touched(old_nodes)), cut(in_touched(old_edges))
    kept = beside(old_nodes)

    # a declaration of the edited files that another one makes, too
    new_names = nodes.select(identity_of(F.col("node_key")).alias("identity"), "file_path")
    others = kept.where("not stub and file_path is not null").select(identity_of(F.col("node_key")).alias("identity"), "file_path").join(new_names.select("identity").distinct(), "identity", "left_semi")
    errors = [r["identity"] for r in changes.duplicate_declarations(new_names.unionByName(others), F.col("identity"), "file_path").orderBy("identity").limit(20).collect()]
    if errors:
        if base:
            store.publish({"runs": log("failed")} | meta, base)
        return Run("failed", 0, counts["skipped"], 0, tuple(errors))

    # calls of other files that may lead elsewhere now: those to classes below a class that the edit declares, changes or takes away
    family = lambda e: e.where(F.col("relationship").isin("extends", "uses_trait"))
    classes = cut(before.unionByName(nodes).select(owning_class(F.col("node_key")).alias("at")).where("at is not null").distinct())
    links = cut(family(old_edges.select("source_key", "target_key", "relationship").unionByName(said.select("source_key", "target_key", "relationship"))).select(F.lower("source_key").alias("below"), F.lower("target_key").alias("at")).distinct())
    affected = descendants(classes, links)
    rest = beside(old_edges)
    named_class = owning_class(F.coalesce("original_target", "target_key"))
    is_call = (F.col("relationship") == "calls") & F.col("target_key").startswith("method:")
    stale = cut(rest.where(is_call).withColumn("at", named_class).join(affected, "at", "left_semi").select(*rest.columns))
    parents = cut(family(rest).select("source_key", "target_key", "relationship").unionByName(family(said).select("source_key", "target_key", "relationship")))
    declared = kept.where("not stub").unionByName(nodes)
    calls = stale.unionByName(said.where(is_call))
    relinked = cut(linked(calls, declared, parents))
    others_said = said.where(~is_call)
    written_as = F.coalesce("original_target", "target_key").alias("_as")
    same_call = ["file_path", "source_key", "relationship", "_as"]
    steady = rest.withColumn("_as", written_as).join(stale.select("file_path", "source_key", "relationship", written_as), same_call, "left_anti").select(*rest.columns)
    edges_now = steady.unionByName(others_said).unionByName(relinked)

    # shared tables that gain or lose a contribution
    given_before = in_touched(old_shared)
    contributions = beside(old_shared).unionByName(contributed)
    table_keys = cut(given_before.select("node_key").unionByName(contributed.select("node_key")).distinct())
    tables = cut(extract.shared_nodes(contributions.join(table_keys, "node_key", "left_semi")).withColumn("stub", F.lit(False)).select(*old_nodes.columns))

    # stubs: every key that the edit has to do with stands, as a declaration or for the edges that lead to or from it, or goes
    keys = lambda e: e.select(F.col("source_key").alias("node_key")).union(e.select(F.col("target_key").alias("node_key")))
    concerned = cut(keys(said_before).union(keys(said)).union(keys(stale)).union(keys(relinked)).union(before.select("node_key")).union(nodes.select("node_key")).union(table_keys).distinct())
    declared_now = nodes.select("node_key").union(tables.select("node_key"))
    still = kept.where("not stub").select("node_key").join(concerned, "node_key", "left_semi").join(table_keys, "node_key", "left_anti")
    free = cut(concerned.join(declared_now.union(still).distinct(), "node_key", "left_anti"))
    used = free.join(keys(edges_now), "node_key", "left_semi")
    was = old_nodes.join(free, "node_key", "left_semi").groupBy("node_key").agg(F.first("node_type").alias("_type"), F.first("symbol_name").alias("_symbol"))
    kind = F.get(F.split("node_key", ":"), F.lit(0))
    by_key = F.when(kind.isin("view", "component"), F.concat(F.lit("blade_"), kind)).otherwise(kind)
    stubs = cut(used.where("node_key not like 'file:%'").join(was, "node_key", "left").select(
        "node_key", F.coalesce("_type", by_key).alias("node_type"), F.coalesce("_symbol", F.substring("node_key", F.length(kind) + 2, F.lit(1 << 20))).alias("symbol_name"),
        *(F.lit(None).cast("string").alias(c) for c in ("file_path", "content_hash", "signature", "visibility")), F.lit(None).cast("boolean").alias("adapts"), F.lit(True).alias("stub"),
    ).select(*old_nodes.columns))
    outdated = table_keys.union(free).union(nodes.select("node_key")).distinct()
    unowned = kept.join(outdated, "node_key", "left_anti").select(*old_nodes.columns)
    nodes_now = unowned.unionByName(nodes).unionByName(tables).unionByName(stubs)

    now = live.select("path", "content_hash", F.lit(fingerprint).alias("fingerprint"))
    files_now = old_files.join(now, "path", "left_anti").join(missing, "path", "left_anti").select(*old_files.columns).unionByName(now)
    paths = touched.select(F.col("file_path").alias("key"))
    part = lambda rows, key, changed: Part(rows, key, _buckets(changed, store.buckets))
    out = {
        "files": part(files_now, F.col("path"), paths),
        "nodes": part(nodes_now, F.coalesce("file_path", "node_key"), paths.union(outdated).union(stubs.select("node_key"))),
        "edges": part(edges_now, F.col("file_path"), paths.union(stale.select("file_path"))),
        "shared": part(contributions, F.col("file_path"), paths),
        "marks": part(beside(stored("marks", MARKS)).unionByName(found.marks), F.col("file_path"), paths),
        "bindings": part(beside(stored("bindings", BINDINGS)).unionByName(found.bindings), F.col("file_path"), paths),
        "runs": log("completed"),
    } | meta
    if store.has("knowledge"):
        sound_before = before.where("not stub").unionByName(old_nodes.join(table_keys, "node_key", "left_semi").where("not stub").select(*old_nodes.columns))
        sound_now = nodes.unionByName(tables)
        delta = changes.difference(sound_before, sound_now, "node_key", "content_hash").where("change in ('changed', 'removed')")
        fresh = delta.join(sound_now.select("node_key", "content_hash"), "node_key", "left").select("node_key", F.when(F.col("change") == "changed", F.col("content_hash")).alias("new_hash"))
        k = store.read("knowledge")
        stale_rows = knowledge.invalidated(k, fresh, as_of if as_of is not None else F.current_timestamp()).select("knowledge_key", F.lit("stale").alias("_state"))
        out["knowledge"] = k.join(stale_rows, "knowledge_key", "left").withColumn("state", F.coalesce("_state", "state")).select(*k.columns)
    store.publish(out, base)
    return Run("completed", counts["updated"], counts["skipped"], counts["deleted"])


def _buckets(keys: DataFrame, buckets: int) -> tuple[int, ...]:
    """The buckets of some keys: no more than there are."""
    return tuple(sorted(r["bucket"] for r in keys.select(bucket_of(F.col("key"), buckets).alias("bucket")).distinct().collect()))


def per_file(edges: DataFrame) -> DataFrame:
    """What each file states, once: of equal edges of a file the surest, loops aside, in the columns of EDGES. Of equally sure ones a
    parameter's comes first."""
    dec = lambda x: F.lit(x).cast("decimal(3,2)")
    sure = F.least(dec(1), F.greatest(dec(0), F.col("confidence")))
    best = F.max(F.struct(sure.alias("confidence"), F.coalesce(F.col("via") == "parameter", F.lit(False)).alias("p"), "via", "resolution")).alias("b")
    rows = edges.where("source_key != target_key").groupBy("source_key", "target_key", "relationship", "file_path").agg(best)
    return rows.select("source_key", "target_key", "relationship", "b.confidence", "file_path", "b.resolution", F.lit(None).cast("string").alias("original_target"), "b.via")


def identity_of(key: Column) -> Column:
    """Names of classes, methods and functions are one in any case; paths, templates and routes are not."""
    return F.when(key.rlike("^(class|method|function):"), F.lower(key)).otherwise(key)


def owning_class(key: Column) -> Column:
    """The key, in lower case, of a class or of the class that a method belongs to; null for other keys."""
    of_method = F.concat(F.lit("class:"), F.regexp_extract(key, r"^method:(.*)::[^:]*$", 1))
    return F.lower(F.when(key.startswith("class:"), key).when(key.rlike(r"^method:.*::[^:]*$"), of_method))


def descendants(classes: DataFrame, links: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """classes(at) and all below them, links(below, at) saying who extends or uses whom: a round a level, each class once."""
    reached = frontier = classes
    for _ in range(most):
        frontier = cut(frontier.join(links, "at").select(F.col("below").alias("at")).distinct().join(reached, "at", "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached


def linked(calls: DataFrame, declared: DataFrame, parents: DataFrame) -> DataFrame:
    """Calls that lead to the method that a class inherits: what they named is kept in original_target, so that a later run can judge
    anew, and resolution tells what was found. An inherited method is no surer than 0.85. Two calls of a file that meet in one
    method by different names stay two; those that are equal become one."""
    named = calls.withColumns({"target_key": F.coalesce("original_target", "target_key"), "resolution": F.when(F.col("resolution").isin("framework_type", "namespace_fallback", "global_fallback", "resolved_name"), F.col("resolution")), "original_target": F.lit(None).cast("string")})
    known = declared.where("node_type = 'method'").select("node_key", "visibility")
    owner = lambda key: F.concat(F.lit("class:"), F.regexp_extract(key, r"^method:(.*)::[^:]*$", 1))
    name = lambda key: F.regexp_extract(key, r"::([^:]*)$", 1)
    asked = named.select("target_key").distinct().join(known.select(F.col("node_key").alias("target_key")), "target_key", "left_anti")
    classes = declared.where(F.col("node_key").startswith("class:")).select(F.col("node_key").alias("class_key"), "adapts")
    methods = known.select(owner(F.col("node_key")).alias("class_key"), name(F.col("node_key")).alias("name"), F.col("node_key").alias("method_key"), (F.col("visibility") == "private").alias("private"))
    ups = parents.select(F.col("source_key").alias("class_key"), F.col("target_key").alias("parent_key"), F.when(F.col("relationship") == "uses_trait", "trait").otherwise("extends").alias("kind"))
    found = graph.inherited_methods(classes, methods, ups, asked.select(owner(F.col("target_key")).alias("class_key"), name(F.col("target_key")).alias("name")))
    by_key = asked.select("target_key", F.lower(owner(F.col("target_key"))).alias("class_key"), F.lower(name(F.col("target_key"))).alias("name")).join(found, ["class_key", "name"])
    by_key = by_key.where("state = 'resolved'").select("target_key", F.col("method_key").alias("_to"))
    rows = named.join(by_key, "target_key", "left")
    moved = F.col("_to").isNotNull()
    same = F.lower("_to") == F.lower("target_key")
    rows = rows.withColumns({
        "resolution": F.when(moved, F.when(same, "declared_method").otherwise("inherited_method")).otherwise(F.col("resolution")),
        "original_target": F.when(moved, F.col("target_key")),
        "confidence": F.when(moved & ~same, F.least(F.col("confidence"), F.lit(0.85).cast("decimal(3,2)"))).otherwise(F.col("confidence")),
    })
    return rows.withColumn("target_key", F.when(moved, F.col("_to")).otherwise(F.col("target_key"))).select(*calls.columns)
