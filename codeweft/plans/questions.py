"""Many questions to the graph as one job: packets of symbol lookups and impact analyses, whose frontiers carry the question, and an
evaluation that retrieves what it judges.

The number of jobs depends on the depth of the traversals, not on the number of questions. What one question gathers is bounded as in
``retrieve``; ``tests/test_questions.py`` holds the packets of both against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators import graph, reports, search
from codeweft.operators.lineage import cut
from codeweft.plans import retrieve
from codeweft.plans.retrieve import Memory

#: A question: ``asked`` is what is looked up (symbol_lookup) or what others may depend on (impact_analysis).
QUESTION = "question string, operation string, asked string"
PER = ("question",)
OPERATIONS = ("symbol_lookup", "impact_analysis")
WARNING = "question string, at int, warning string"
LIMIT = "question string, limit string"


class Gathered:
    """What all questions have found: items with their question and identities, warnings in order, limits that were met, and the
    questions that met anything stale."""

    def __init__(self) -> None:
        self.items: list[DataFrame] = []
        self.warnings: list[DataFrame] = []
        self.limits: list[DataFrame] = []
        self.stale: list[DataFrame] = []

    def warn(self, rows: DataFrame, at: int, text: Column) -> None:
        self.warnings.append(rows.select("question", F.lit(at).alias("at"), text.alias("warning")))

    def met(self, rows: DataFrame, limit: str) -> None:
        self.limits.append(rows.select("question", F.lit(limit).alias("limit")))

    def fresh(self, rows: DataFrame, include_stale: bool, what: str, at: int) -> DataFrame:
        """rows(question, fresh, ...) without the stale ones, unless these are asked for; how many were withheld becomes a warning."""
        old = rows.where("not fresh").groupBy("question").agg(F.count(F.lit(1)).alias("n"))
        self.stale.append(old.select("question"))
        if include_stale:
            return rows
        self.warn(old, at, F.concat(F.col("n").cast("string"), F.lit(f" {what} were withheld because their source changed; synchronise the index.")))
        return rows.where("fresh")


def _identities(symbol: Column, file: Column, key: Column) -> Column:
    return F.array_compact(F.array(symbol, file, key)).alias("identities")


def _own() -> Column:
    return _identities(F.col("symbol_name"), F.col("file_path"), F.col("node_key"))


def _lookups(memory: Memory, index: DataFrame | None, asked: DataFrame, most: int, include_stale: bool, out: Gathered) -> None:
    named = asked.withColumn("asked", F.ltrim(F.trim("asked"), F.lit("\\")))
    out.warn(named.where("asked = ''"), 0, F.lit("A non-empty symbol or node key is required."))
    named = named.where("asked != ''")
    hit = graph.resolve_each(memory.nodes, named, index=index, steps=("similar",))
    counts = hit.groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    judged = memory.judged(memory.nodes.join(hit.select("node_key").distinct(), "node_key", "left_semi")).select("node_key", "summary", "fresh")
    found = cut(hit.join(judged, "node_key").join(counts, "question").join(named.select("question", "asked"), "question"))
    here = F.concat(F.lit("["), F.col("asked"), F.lit("]"))
    out.warn(named.join(found.select("question").distinct(), "question", "left_anti"), 0, F.concat(F.lit("No indexed symbol matches "), here, F.lit(". Inspect the source before editing.")))
    out.warn(found.where("n > 1").select("question", "asked").distinct(), 0, F.concat(F.lit("Multiple indexed symbols match "), here, F.lit(". Edges for each candidate are included. Use one of the returned node keys to resolve the ambiguity.")))
    out.warn(found.where("n = 1 and not fresh"), 0, F.concat(F.lit("Indexed symbol "), here, F.lit(" is stale or unresolved. Read the declaration source before relying on this memory.")))
    out.stale.append(found.where("not fresh").select("question"))
    out.items.append(retrieve.node_items(found, F.when(F.col("n") == 1, 180).otherwise(160), (*PER, _own())))
    # a method is seen with the class that it belongs to
    owner = F.concat(F.lit("class:"), F.regexp_extract("node_key", "^method:(.*?)::", 1))
    seeds = found.select("question", "node_key").union(found.where("n = 1 and node_key rlike '^method:.*?::'").select("question", owner))
    limit = min(retrieve.EDGES, most)
    near = cut(graph.neighborhood_of_each(memory.edges, seeds, limit + 1))
    out.met(near.where(F.col("_n") > limit), "graph_neighbors")
    near = near.where(F.col("_n") <= limit)
    ends = near.select(F.explode(F.array("source_key", "target_key")).alias("node_key")).distinct()
    rows = retrieve.with_ends(near, memory.judged(memory.nodes.join(ends, "node_key", "left_semi")))
    primary = found.where("n = 1").select("question", F.col("node_key").alias("primary"))
    rows = rows.join(primary, "question", "left")
    # where nothing is known of live sources, every node is fresh: there is nothing to part, so that rows need not be written first
    rows = out.fresh(rows if memory.live is None else cut(rows), include_stale, "graph relationships", 1)
    owned = F.coalesce((F.col("source_key") == F.col("primary")) | (F.col("target_key") == F.col("primary")), F.lit(False))
    other = F.when(F.col("incoming"), F.col("source_key")).otherwise(F.col("target_key"))
    out.items.append(retrieve.edge_lines(rows, owned, (*PER, _identities(retrieve.other_end("symbol_name"), retrieve.other_end("file_path"), other))))
    views = found.where(F.col("node_type").isin("blade_view", "blade_component")).select("question", "node_key")
    if views.isEmpty():
        return
    nested, over = graph.hops_of_each(memory.edges, views, ("renders_view", "uses_component"), retrieve.HOPS, retrieve.HOP_EDGES)
    out.met(over, "blade_include_hops")
    inner = memory.judged(memory.nodes.join(nested.select("node_key").distinct(), "node_key", "left_semi"))
    out.items.append(retrieve.hop_lines(out.fresh(cut(nested.join(inner, "node_key")), include_stale, "nested includes", 2), (*PER, _own())))


def _impacts(memory: Memory, index: DataFrame | None, asked: DataFrame, include_stale: bool, depth: int | None, max_nodes: int | None, out: Gathered) -> None:
    cap, reach = graph.clamp(max_nodes, 30, 0, graph.HARD_NODES), graph.clamp(depth, 2, 0, graph.HARD_DEPTH)
    hit = cut(graph.resolve_each(memory.nodes, asked, memory.modules, index))
    seen = hit.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.first("step").alias("step"), F.array_sort(F.collect_list("symbol_name")).alias("names"))  # six at most
    told = asked.join(seen, "question", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n != 1")
    here = F.concat(F.lit("["), F.trim("asked"), F.lit("]"))
    hint = (
        F.when(F.col("n") == 0, F.concat(F.lit("No indexed symbol matches "), here, F.lit(". Inspect the source or synchronise the index.")))
        .when(F.col("step") == "similar", F.concat(F.lit("Multiple symbols match "), here, F.lit(". Inspect one of: "), F.array_join(F.slice("names", 1, 5), ", ")))
        .otherwise(F.concat(F.lit("Multiple indexed declarations match "), here, F.lit(". Use a node key.")))
    )
    out.warn(told, 0, hint)
    subject = cut(hit.join(seen.where("n = 1").select("question"), "question", "left_semi"))
    out.warn(subject, 0, F.lit(retrieve.IMPACT_NOTE.format(reach)))
    line = F.concat_ws(" ", F.lit("Subject"), "node_type", F.coalesce("symbol_name", "node_key"), F.col("node_key"))
    out.items.append(retrieve.items(subject, F.lit("impact-subject"), F.lit(180), line, per=(*PER, _own())))
    parts, columns = [], ["node_key", "node_type", "symbol_name", "file_path", "relationship", "direction", "distance", "confidence", "risk", "score", "fresh", "reason"]
    modules = subject.where("step = 'module'").select("question", F.col("node_key").alias("module_key"))
    if not modules.isEmpty():  # what they hold
        inside = memory.nodes.where("node_type != 'file'").join(modules, "module_key")
        members = cut(search.leading(inside, "question", ["node_type", "node_key"], cap + 1))
        out.met(members.where(F.col("_n") > cap), "impact_traversal")
        held = members.where(F.col("_n") <= cap)
        sound = memory.judged(memory.nodes.join(held.select("node_key").distinct(), "node_key", "left_semi")).select("node_key", "fresh")
        parts.append(retrieve.member_rows(held.join(sound, "node_key"), F.col("module_key"), (*PER, "module_key")).select("question", *columns))
    # symbols: what depends on them
    origins = subject.where("step != 'module'").select("question", "node_key")
    reached, cut_short = graph.impact_of_each(memory.edges, memory.nodes, origins, depth, cap)
    out.met(cut_short.where("truncated"), "impact_traversal")
    # so are paths that lead over nodes alone; levels are written, and no more is made of them here than columns
    sound = memory.live is None and reached.where("node_type is null").isEmpty()
    if sound:
        found = reached.withColumn("fresh", F.lit(True))
    else:
        on_path = reached.select(F.explode("path").alias("node_key")).union(origins.select("node_key")).distinct()
        state = cut(memory.judged(memory.nodes.join(on_path, "node_key", "left_semi")).select("node_key", "fresh"))
        steps = reached.select("question", F.col("node_key").alias("found"), F.explode("path").alias("node_key")).join(state, "node_key", "left")
        each = steps.groupBy("question", F.col("found").alias("node_key")).agg(F.bool_and(F.coalesce("fresh", F.lit(False))).alias("fresh"))
        found = reached.join(each, ["question", "node_key"])
    found = found.withColumn("reason", graph.finding_reason(F.col("direction"), F.col("relationship"), F.col("confidence"), F.col("node_type").isNull()))
    rows = reduce(DataFrame.unionByName, [*parts, found.select("question", *columns)])
    rows = rows if sound else out.fresh(cut(rows), include_stale, "impact findings", 1)
    out.items.append(retrieve.finding_lines(rows, (*PER, _own())))
    if sound:
        return
    moved = origins.join(state.where("not fresh").select("node_key"), "node_key", "left_semi")
    out.stale.append(moved.select("question"))
    out.warn(moved, 2, F.lit("The indexed impact subject changed; stored summaries and dependent relationships require source verification."))


def answered(memory: Memory, questions: DataFrame, budget: int | None = None, include_stale: bool = False, depth: int | None = None, max_nodes: int | None = None, index: DataFrame | None = None, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """questions as QUESTION says, one row each -> (packets, sources).

    packets: question, operation, header, ids, text, used, estimated_tokens, warnings, stale, truncated, candidate_count, selected_count,
    omitted_count, compacted_count, truncation_reasons. sources(question, position, id, identities): what a packet shows, in order.
    ``index`` (see postings) lets names that match nothing whole find symbols that contain them. Without ``texts`` packets have no text, which need not be
    put together then.
    """
    packets, folds = _answered(memory, questions, budget, include_stale, depth, max_nodes, index, texts)
    order = folds.select("question", F.posexplode("taken").alias("at", "t"))
    sources = order.select("question", (F.col("at") + 1).alias("position"), "t.id", "t.identities")
    return packets, sources


def _answered(memory: Memory, questions: DataFrame, budget: int | None = None, include_stale: bool = False, depth: int | None = None, max_nodes: int | None = None, index: DataFrame | None = None, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """answered(), with (question, taken) instead of sources: what each packet shows, as search.folded() gives it."""
    most, room, out = retrieve.candidates(budget), retrieve.room(budget), Gathered()
    spark = memory.spark
    questions = cut(questions.select("question", "operation", "asked"))
    of = lambda operation: questions.where(F.col("operation") == operation).select("question", F.coalesce("asked", F.lit("")).alias("asked"))
    lookups, impacts = of("symbol_lookup"), of("impact_analysis")
    if not lookups.isEmpty():
        _lookups(memory, index, lookups, most, include_stale, out)
    if not impacts.isEmpty():
        _impacts(memory, index, impacts, include_stale, depth, max_nodes, out)
    out.warn(questions.where(~F.col("operation").isin(*OPERATIONS)), 0, F.concat(F.lit("Questions by the many are lookups and impact analyses, not ["), "operation", F.lit("].")))
    union = lambda parts, schema: reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))
    limits = cut(union(out.limits, LIMIT).groupBy("question").agg(F.array_sort(F.collect_set("limit")).alias("limits")))
    out.warn(limits, 9, F.lit(retrieve.BOUNDED))
    warned = union(out.warnings, WARNING).distinct().groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda w: w["warning"]).alias("warnings"))
    none = F.array().cast("array<string>")
    head = questions.join(warned, "question", "left").join(limits, "question", "left").withColumns({"warnings": F.coalesce("warnings", none), "limits": F.coalesce("limits", none)})
    lines = F.concat(F.array(F.translate("operation", "_", " "), F.lit(retrieve.ADVICE)), F.transform("warnings", lambda w: F.concat(F.lit("Warning: "), w)))
    stale = union(out.stale, "question string").distinct().withColumn("stale", F.lit(True))
    head = cut(head.withColumn("header", F.array_join(lines, "\n")).join(stale, "question", "left"))
    every = cut(union(out.items, f"question string, {retrieve.ITEM}, identities array<string>"))
    once = search.deduplicated(every, "question")
    # what a packet shows goes through the fold with the ids, which is written: nothing is looked up by ids afterwards but texts
    folds = cut(search.folded(once.join(head.select("question", "header"), "question"), "question", F.col("header"), room, carried=("identities",)))
    packed = search.of_folded(folds, "question")
    counts = every.groupBy("question").agg(F.count(F.lit(1)).alias("candidate_count"))
    rows = head.join(packed, "question", "left").join(counts, "question", "left")
    if texts:
        rows = rows.join(search.texts_of(folds, once, "question"), "question", "left")
    size = F.least(F.octet_length("header"), F.lit(room * 4))
    zero = {"used": size, "ids": none, "omitted": F.lit(0), "compacted": F.lit(0), "candidate_count": F.lit(0), "stale": F.lit(False)}
    rows = rows.withColumns({k: F.coalesce(k, v) for k, v in zero.items()})
    short = F.col("omitted") + F.col("compacted") > 0
    packets = rows.select(
        "question", "operation", "header", "ids", *([F.concat_ws("\n", F.substring("header", F.lit(1), size), "body").alias("text")] if texts else []), "used", F.ceil(F.col("used") / 4).alias("estimated_tokens"), "warnings", "stale",
        (short | (F.size("limits") > 0)).alias("truncated"), "candidate_count", F.size("ids").alias("selected_count"), F.col("omitted").alias("omitted_count"), F.col("compacted").alias("compacted_count"),
        F.array_compact(F.concat("limits", F.array(F.when(short, "token_budget")))).alias("truncation_reasons"),
    )
    return packets, folds


def evaluated(memory: Memory, questions: DataFrame, expected: DataFrame, k: int = 8, budget: int = 2500, **asked) -> DataFrame:  # noqa: ANN003
    """expected(question, item): what each question should find -> a row for each question that expects something, with what its own
    packet shows judged as in ``reports.evaluated``, and the packet's estimated_context_tokens, within_budget and truncated."""
    packets, folds = _answered(memory, questions, budget, texts=False, **asked)
    shown = folds.select(F.col("question").alias("scenario"), F.transform("taken", lambda t: t["identities"]).alias("identities"))
    judged = reports.evaluated_packets(shown, expected.withColumnRenamed("question", "scenario"), k)
    cost = packets.select(F.col("question").alias("scenario"), F.col("estimated_tokens").alias("estimated_context_tokens"), (F.col("estimated_tokens") <= budget).alias("within_budget"), "truncated")
    return judged.join(cost, "scenario")
