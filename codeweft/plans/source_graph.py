"""The graph of a source tree: each file goes to the extractors that its path calls for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import normalized_key, unified_path, view_name
from codeweft.operators import extract, receivers, routing, semantics

#: The directives that name another template, in their first argument or, those under a condition, in their second.
FIRST, SECOND = ("extends", "include", "includeIf", "includeFirst", "each", "component"), ("includeWhen", "includeUnless")
#: Tags of components that stand for no template.
NO_COMPONENTS = ("slot", "dynamic-component")
VALUE = r"(\[[^\]]*\]|'[^']*'|\"[^\"]*\")\s*(?:,|$)"
ARGUMENT = r"(?:[^,()\[\]'\"]|'[^']*'|\"[^\"]*\"|\((?:[^()]++|\([^()]*+\))*+\)|\[[^\]]*\])*+"


def included(name: Column, arguments: Column) -> Column:
    """The templates that a directive names as literals, one or a list."""
    first, second = F.regexp_extract(arguments, rf"(?s)^\s*{VALUE}", 1), F.regexp_extract(arguments, rf"(?s)^{ARGUMENT},\s*{VALUE}", 1)
    value = F.when(name.isin(*SECOND), second).when(name.isin(*FIRST), first).otherwise("")
    return F.filter(extract.all_of(value, r"['\"]([^'\"]*)['\"]"), lambda v: v != "")


def template_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of templates, in the columns of ``extract.graph_of``: what each includes, the components that it uses and the
    routes that it names. Comments and verbatim parts don't count."""
    component = F.translate(F.regexp_extract(unified_path(F.col("path")), r"resources/views/components/(.+)\.blade\.php$", 1), "/", ".")
    text = F.regexp_replace("text", r"(?s)\{\{--.*?--\}\}|@verbatim\b.*?@endverbatim\b", "")
    symbol = F.when(component != "", component).otherwise(F.coalesce(view_name(F.col("path")), F.col("path")))
    rows = files.select("path", F.sha2("text", 256).alias("content_hash"), text.alias("t"), symbol.alias("symbol"), F.when(component != "", "blade_component").otherwise("blade_view").alias("kind"))
    rows = rows.withColumn("key", normalized_key(F.concat(F.when(F.col("kind") == "blade_component", "component:").otherwise("view:"), "symbol")))
    nodes = rows.select(F.col("key").alias("node_key"), F.col("kind").alias("node_type"), F.col("symbol").alias("symbol_name"), F.col("path").alias("file_path"), "content_hash", F.concat("kind", F.lit(" "), "symbol").alias("signature"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("boolean").alias("adapts"))
    to = lambda names, prefix, rel: F.transform(names, lambda n: F.struct(normalized_key(F.concat(F.lit(prefix), n)).alias("target_key"), F.lit(rel).alias("relationship")))
    views = F.flatten(F.transform(extract.directives(F.col("t")), lambda d: included(d["name"], d["arguments"])))
    tags = F.filter(extract.all_of(F.col("t"), r"<x-([A-Za-z0-9][A-Za-z0-9._-]*)\b"), lambda n: ~n.isin(*NO_COMPONENTS))
    routes = extract.all_of(F.col("t"), r"\broute\s*\(\s*['\"]([^'\"]+)['\"]")
    ends = F.array_distinct(F.concat(to(views, "view:", "renders_view"), to(tags, "component:", "uses_component"), to(routes, "route:", "references_route")))
    edges = rows.select("path", "key", F.explode(ends).alias("e")).select(F.col("key").alias("source_key"), "e.target_key", "e.relationship", F.lit(0.85).cast("decimal(3,2)").alias("confidence"), F.col("path").alias("file_path"))
    return nodes, edges


def migration_files(files: DataFrame) -> DataFrame:
    return files.where(unified_path(F.col("path")).rlike(r"(^|/)migrations/[^/]+\.php$"))


def shared_tables(files: DataFrame) -> DataFrame:
    """What migrations among the files say of tables, in the columns of ``extract.SHARED``."""
    return extract.contributions(migration_files(files))


@dataclass(frozen=True)
class Reading:
    """What files say: nodes and edges, contributions to shared tables, marks of classes, and bindings (file_path, abstract, concrete)."""

    nodes: DataFrame
    edges: DataFrame
    shared: DataFrame
    marks: DataFrame
    bindings: DataFrame


def source_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of read_files()."""
    found = read_files(files)
    return found.nodes, found.edges


def read_files(files: DataFrame) -> Reading:
    """files(path, text): templates by their ending, everything else as code, with its routes, what its classes
    say of each other, the calls that its receivers lead to, and the tables that migrations define. Edges may come more than once:
    ``changes.combined_edges`` takes the surest. Declarations and methods are read once for all of these."""
    is_template = F.col("path").endswith(".blade.php")
    code = files.where(~is_template)
    read = extract.read_once(code)
    parts = [extract.graph_of(code, read)]
    # what no file holds needs no plan: one look over the texts tells
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    there = files.agg(has(is_template).alias("templates"), has(~is_template & F.col("text").contains("Route::")).alias("routes"), has(~is_template & F.col("text").rlike(r"->|\w\s*\(")).alias("calls")).first()
    if there["routes"]:
        parts.append(routing.route_graph(code))
    if there["templates"]:
        parts.append(template_graph(files.where(is_template)))
    if not migration_files(code).isEmpty():
        parts.append(extract.migration_graph(migration_files(code)))
    nodes = reduce(DataFrame.unionByName, (n for n, _ in parts))
    said = [*(e for _, e in parts), semantics.semantic_edges(code, read), *(receivers.body_edges(code, read) if there["calls"] else [])]
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), said)
    if "resolution" not in edges.columns:
        edges = edges.withColumn("resolution", F.lit(None).cast("string"))
    bound = semantics.bindings(read[1]).select(F.col("path").alias("file_path"), "abstract", "concrete").distinct()
    return Reading(nodes, edges, shared_tables(code), semantics.class_marks(code, read), bound)
