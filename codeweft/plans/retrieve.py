"""The public retrieval operations: each gathers scored items, which are ranked, de-duplicated and packed into a budget."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.scoring import edge_score, include_score, knowledge_confidence, knowledge_score
from codeweft.functions.text import relevance, terms
from codeweft.operators import graph, knowledge, reports, search
from codeweft.operators.lineage import cut

BUDGET, MOST_BUDGET = 4000, 32_000
LEAST_CANDIDATES, MOST_CANDIDATES, TOKENS_A_CANDIDATE = 12, 500, 20
EDGES, HOPS, HOP_EDGES, SEEDS, HISTORY = 80, 4, 32, 8, 100
FIELDS = {"symbol_name": 3, "summary": 2, "file_path": 1}
ITEM = "id string, score int, text string, compact string"
KNOWLEDGE = "knowledge_key string, kind string, title string, body string, state string, confidence double, expires_at timestamp, source_refs array<string>, source_hashes map<string,string>"
#: Sentences of headers.
IMPACT_NOTE = "Impact follows indexed dependents and container members to depth {}. Dynamic calls, inheritance overrides and runtime container bindings may be absent. Risk labels are heuristics; verify live source before acting."
BOUNDED = "Candidate retrieval was bounded; refine the query or request a larger budget for more context."
ADVICE = "Memory is advisory; live source is authoritative. Token estimates use UTF-8 bytes/4 for context text."


@dataclass(frozen=True)
class Memory:
    """The stored tables that answers are made of; those that may be absent count as empty.

    nodes(node_key, node_type, symbol_name, file_path, module_key, content_hash; summary and stub if there are any),
    edges(source_key, target_key, relationship, confidence), modules(module_key, name, root_path), knowledge as in KNOWLEDGE,
    changes(id, intent, validation, lessons), runs(run, status), live(path, live_hash): hashes of the sources as they are now.
    """

    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame | None = None
    knowledge: DataFrame | None = None
    changes: DataFrame | None = None
    runs: DataFrame | None = None
    live: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def judged(self, nodes: DataFrame | None = None) -> DataFrame:
        """Nodes with summary, stub and fresh: whether the file that a node was read from is still as it was."""
        rows = self.nodes if nodes is None else nodes
        for name, value in (("summary", F.lit(None).cast("string")), ("stub", F.lit(False))):
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        if self.live is None:
            return rows.withColumn("fresh", F.lit(True))
        return reports.fresh_nodes(rows, self.live, F.array_compact(F.array("file_path")))


@dataclass
class Gathered:
    """What one operation has found: items as in ITEM, what to warn of, which limits were met, and whether anything is stale."""

    items: DataFrame
    warnings: list[str] = field(default_factory=list)
    limits: list[str] = field(default_factory=list)
    stale: bool = False

    def add(self, other: Gathered) -> Gathered:
        return Gathered(self.items.unionByName(other.items), self.warnings + other.warnings, self.limits + other.limits, self.stale or other.stale)


def items(rows: DataFrame, id_: Column, score: Column, text: Column, compact: Column | None = None, per: tuple[str | Column, ...] = ()) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return rows.select(*per, id_.alias("id"), score.cast("int").alias("score"), text.alias("text"), (nothing if compact is None else compact).alias("compact"))


def nothing(memory: Memory, *warnings: str) -> Gathered:
    return Gathered(memory.spark.createDataFrame([], ITEM), list(warnings))


def kept_fresh(rows: DataFrame, include_stale: bool, what: str) -> tuple[DataFrame, list[str], bool]:
    """rows(fresh, ...) without the stale ones, unless these are asked for, a warning of how many were withheld, and whether there
    were any. The rows are bounded by the question that gathered them."""
    rows = cut(rows)
    old = rows.where("not fresh").count()
    if include_stale or not old:
        return rows, [], bool(old)
    return rows.where("fresh"), [f"{old} {what} were withheld because their source changed; synchronise the index."], True


def node_items(nodes: DataFrame, score: Column, per: tuple[str | Column, ...] = ()) -> DataFrame:
    """Items of judged nodes: a stale one shows where to read, and not what was stored."""
    place = F.coalesce(F.concat("file_path", F.lit(":?")), F.lit("unresolved"))
    lead = F.concat(F.concat_ws(" ", "node_type", "symbol_name"), F.lit(" at "), place, F.lit("."))
    shown = F.when(F.col("fresh"), F.concat(lead, F.lit(" "), F.coalesce("summary", "node_type"))).otherwise(F.concat(lead, F.lit(" Indexed source is stale or unresolved. Read the source; the stored summary was withheld.")))
    return items(nodes, F.col("node_key"), score, shown, F.when(F.col("fresh"), lead), per)


def with_ends(near: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with what is known of their ends, and whether they are fresh."""
    side = lambda s: known.select(F.col("node_key").alias(f"{s}_key"), *(F.col(c).alias(f"{s}_{c}") for c in ("symbol_name", "file_path", "stub", "fresh")))
    rows = near.join(side("source"), "source_key").join(side("target"), "target_key")
    return rows.withColumn("fresh", F.col("source_fresh") & (F.col("target_stub") | F.col("target_fresh")))


def other_end(column: str) -> Column:
    return F.when(F.col("incoming"), F.col(f"source_{column}")).otherwise(F.col(f"target_{column}"))


def edge_lines(rows: DataFrame, owned: Column, per: tuple[str | Column, ...] = ()) -> DataFrame:
    """Items of edges as with_ends() gives them."""
    text = F.concat(
        F.when(F.col("fresh"), "").otherwise("[stale graph] "),
        F.concat_ws(" ", F.when(F.col("incoming"), "incoming").otherwise("outgoing"), "relationship", other_end("symbol_name"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("file"), F.coalesce(other_end("file_path"), F.lit("unresolved"))),
        F.when(F.col("target_stub"), " (declaration unresolved)").otherwise(""),
    )
    key = F.concat(F.lit("edge:"), F.concat_ws(">", "source_key", "relationship", "target_key"))
    return items(rows, key, edge_score(F.col("confidence"), owned, F.col("relationship"), F.col("fresh")), text, per=per)


def finding_lines(rows: DataFrame, per: tuple[str | Column, ...] = ()) -> DataFrame:
    """Items of impact findings (fresh, distance, direction, relationship, reason and so on)."""
    text = F.concat(F.when(F.col("fresh"), "").otherwise("[stale graph] "), F.format_string("d%d %s %s %s confidence %.2f risk %s file %s. %s", "distance", "direction", "relationship", F.coalesce("symbol_name", "node_key"), F.col("confidence").cast("double"), "risk", F.coalesce("file_path", F.lit("unresolved")), "reason"))
    return items(rows, F.concat_ws(":", "node_key", "relationship", "direction"), F.when(F.col("fresh"), F.col("score")).otherwise(20), text, per=per)


def hop_lines(rows: DataFrame, per: tuple[str | Column, ...] = ()) -> DataFrame:
    text = F.concat(F.when(F.col("fresh"), "").otherwise("[stale graph] "), F.concat_ws(" ", F.lit("nested"), "relationship", "symbol_name", F.lit("depth"), F.col("depth").cast("string"), F.lit("file"), F.coalesce("file_path", F.lit("unresolved"))))
    return items(rows, F.concat(F.lit("view-hop:"), "node_key"), include_score(F.col("depth"), F.col("fresh")), text, per=per)


def member_rows(members: DataFrame, module: Column, per: tuple[str, ...] = ()) -> DataFrame:
    """Members of a module as impact findings."""
    rows = members.select(*per, "node_key", "node_type", "symbol_name", "file_path", F.lit("contains").alias("relationship"), F.lit("outgoing").alias("direction"), F.lit(1).alias("distance"), F.lit(1.0).alias("confidence"), F.lit(100 - 15).alias("score"), "fresh", F.concat(F.lit("Symbol belongs to module "), module, F.lit(".")).alias("reason"))
    return rows.withColumn("risk", graph.risk(F.col("node_type"), F.col("relationship")))


def edge_items(memory: Memory, seeds: DataFrame, most: int, include_stale: bool, primary: str | None = None) -> Gathered:
    """The edges that touch a seed, with the node at the other end."""
    limit = min(EDGES, most)
    near = cut(graph.neighborhood(memory.edges, seeds, limit + 1, limit + 1))
    limits = ["graph_neighbors"] if near.count() > limit else []
    near = near.orderBy(F.desc("confidence"), "source_key", "target_key", "relationship").limit(limit)
    ends = near.select(F.col("source_key").alias("node_key")).union(near.select(F.col("target_key").alias("node_key"))).distinct()
    known = memory.judged(memory.nodes.join(F.broadcast(ends), "node_key", "left_semi"))  # two nodes an edge, 160 at most
    rows = with_ends(near, known)
    rows, warnings, stale = kept_fresh(rows, include_stale, "graph relationships")
    owned = F.lit(False) if primary is None else (F.col("source_key") == primary) | (F.col("target_key") == primary)
    return Gathered(edge_lines(rows, owned), warnings, limits, stale)


def view_hops(memory: Memory, seeds: DataFrame, include_stale: bool) -> Gathered:
    """Views and components nested in those among the seeds."""
    views = cut(seeds.where(F.col("node_type").isin("blade_view", "blade_component")).select("node_key"))
    if views.isEmpty():
        return nothing(memory)
    found, truncated = graph.hops(memory.edges, views, ("renders_view", "uses_component"), HOPS, HOP_EDGES)
    rows, warnings, stale = kept_fresh(memory.judged(memory.nodes.join(F.broadcast(found), "node_key")), include_stale, "nested includes")
    return Gathered(hop_lines(rows), warnings, ["blade_include_hops"] if truncated else [], stale)


def rules_of(memory: Memory, base: Column, most: int, include_stale: bool, module: dict | None = None) -> Gathered:
    """Stored assertions that still hold; those of a module are about it by name or by reference, or about everything."""
    if memory.knowledge is None:
        return nothing(memory)
    now = F.current_timestamp()
    wanted = memory.knowledge.where(knowledge.not_expired(F.col("expires_at"), now) & F.col("state").isin("active", *(["stale"] if include_stale else [])))
    if module is not None:
        named = F.contains(F.lower(F.concat_ws(" ", "title", "body")), F.lit(module["module_key"].lower()))
        general = (F.col("kind") == "architectural_rule") & (F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) == 0)
        root = (module["root_path"] or "").rstrip("/")
        below = memory.nodes.where((F.col("file_path") == root) | F.col("file_path").startswith(f"{root}/")).select(F.col("node_key").alias("ref"))
        refs = wanted.select("knowledge_key", F.explode("source_refs").alias("ref")).join(below, "ref", "left_semi").select("knowledge_key").distinct().withColumn("_below", F.lit(True))
        wanted = wanted.join(refs, "knowledge_key", "left").where(named | general | F.col("_below")).drop("_below")
    wanted = cut(wanted.orderBy("knowledge_key").limit(most + 1))
    limits = ["knowledge_candidates"] if wanted.count() > most else []
    hold = knowledge.usable(wanted.orderBy("knowledge_key").limit(most), memory.judged().where("fresh"), now).withColumnRenamed("valid", "fresh")
    rows, warnings, stale = kept_fresh(hold, include_stale, "stored knowledge records")
    state = F.when(F.col("fresh"), "active").otherwise("stale")
    text = F.concat(F.lit("Rule ["), state, F.lit("] "), "kind", F.lit(": "), "title", F.lit(". "), "body")
    score = knowledge_score(base, knowledge_confidence(F.col("confidence"), state), F.col("fresh"))
    return Gathered(items(rows, F.concat(F.lit("knowledge:"), "knowledge_key"), score, text), warnings, limits, stale)


def overview(memory: Memory, most: int) -> Gathered:
    count = lambda df, name: (df if df is not None else memory.spark.range(0)).agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    active = None if memory.knowledge is None else memory.knowledge.where("state = 'active'")
    counts = count(memory.nodes, "nodes").union(count(memory.edges, "edges")).union(count(memory.modules, "modules")).union(count(active, "rules"))
    n = {r["what"]: r["n"] for r in counts.collect()}  # four numbers
    last = None if memory.runs is None else memory.runs.orderBy(F.desc("run")).select("status").first()
    warnings = [] if n["nodes"] else ["The index is empty. Synchronise it, or inspect the repository directly."]
    if last is not None and last[0] != "completed":
        warnings.append("The latest indexing run did not complete; source inspection is required.")
    text = f"Nodes: {n['nodes']}. Edges: {n['edges']}. Modules: {n['modules']}. Active stored rules: {n['rules']}. Last run: {last[0] if last else 'never'}."
    out = Gathered(items(memory.spark.range(1), F.lit("overview-counts"), F.lit(180), F.lit(text)), warnings)
    if memory.modules is not None:
        own = memory.nodes.where("node_type != 'file'").groupBy("module_key").agg(F.count(F.lit(1)).alias("n"))
        rows = memory.modules.orderBy("module_key").limit(most).join(own, "module_key", "left")
        line = F.format_string("Module %s (%s) root %s symbols %d.", "module_key", "name", "root_path", F.coalesce("n", F.lit(0)))
        out = out.add(Gathered(items(rows, F.concat(F.lit("module:"), "module_key"), F.lit(80), line, line), limits=["module_candidates"] if n["modules"] > most else []))
    return out.add(rules_of(memory, F.lit(120), most, False))


def module_context(memory: Memory, most: int, include_stale: bool, module: str, query: str = "") -> Gathered:
    """The module's nodes, those that match the query first, what surrounds the most relevant of them, and its rules."""
    found = None if memory.modules is None else memory.modules.where((F.col("module_key") == module) | (F.col("name") == module)).orderBy("module_key").first()
    if found is None:
        return nothing(memory, f"No indexed module matches [{module}]. Inspect the source.")
    m = found.asDict()
    line = f"Module {m['module_key']} {m['name']} root {m['root_path']}."
    out = Gathered(items(memory.spark.range(1), F.lit(f"module-header:{m['module_key']}"), F.lit(180), F.lit(f"{line} No stored summary."), F.lit(line)))
    own = memory.nodes.where((F.col("module_key") == m["module_key"]) & (F.col("node_type") != "file"))
    own = own if "summary" in own.columns else own.withColumn("summary", F.lit(None).cast("string"))
    words = memory.spark.range(1).select(terms(F.lit(query))).first()[0] if query.strip() else []
    blank = {c: F.coalesce(c, F.lit("")) for c in FIELDS}
    if words:
        own = own.where(search.contains_any(words, [*FIELDS])).withColumn("_rank", search.lexical_score(words, FIELDS))
    else:
        own = own.withColumn("_rank", F.lit(0))
    order = [F.desc("_rank"), "node_type", "symbol_name", "node_key"]
    own = cut(own.orderBy(*order).limit(most + 1))
    limits = ["symbol_candidates"] if own.count() > most else []
    asked = relevance(F.lit(query), list(blank.values())) if words else F.lit(0)
    rows = cut(memory.judged(own.orderBy(*order).limit(most)).withColumn("relevance", asked))
    stale = not rows.where("not fresh").isEmpty()
    warnings = ["Some indexed symbols changed or cannot be resolved. Stored summaries were withheld; read their source files and synchronise the index."] if stale else []
    score = F.when(F.col("fresh"), F.when(F.col("node_type") == "method", 80).otherwise(90) + F.col("relevance")).otherwise(35)
    out = out.add(Gathered(node_items(rows, score), warnings, limits, stale))
    if words:
        by = relevance(F.lit(query), [blank["symbol_name"], blank["summary"]])
        seeds = cut(rows.withColumn("_by", by).orderBy(F.desc("_by"), "node_type", "symbol_name", "node_key").limit(SEEDS))
        out = out.add(edge_items(memory, seeds, most, include_stale))
    about = relevance(F.lit(query), [F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))]) if words else F.lit(0)
    return out.add(rules_of(memory, 110 + about, most, include_stale, m))


def symbol_lookup(memory: Memory, most: int, include_stale: bool, symbol: str) -> Gathered:
    """The node of a key or symbol, or all candidates if it is ambiguous, with the edges that touch them and nested views."""
    name = symbol.strip().lstrip("\\")
    if not name:
        return nothing(memory, "A non-empty symbol or node key is required.")
    found = cut(memory.judged(graph.resolve_target(memory.nodes, name, steps=("similar",)).join(memory.nodes.select("node_key", "content_hash", "module_key"), "node_key")))
    n = found.count()  # six at most
    if not n:
        return nothing(memory, f"No indexed symbol matches [{name}]. Inspect the source before editing.")
    stale = not found.where("not fresh").isEmpty()
    seeds, warnings, primary = found, [], None
    if n > 1:
        warnings.append(f"Multiple indexed symbols match [{name}]. Edges for each candidate are included. Use one of the returned node keys to resolve the ambiguity.")
    else:
        primary = found.first()["node_key"]
        if stale:
            warnings.append(f"Indexed symbol [{name}] is stale or unresolved. Read the declaration source before relying on this memory.")
        if "::" in primary and primary.startswith("method:"):
            owner = memory.nodes.where(F.col("node_key") == "class:" + primary.removeprefix("method:").split("::")[0])
            seeds = found.select("node_key").union(owner.select("node_key"))
    out = Gathered(node_items(found, F.lit(180 if n == 1 else 160)), warnings, [], stale)
    return out.add(edge_items(memory, seeds, most, include_stale, primary)).add(view_hops(memory, found, include_stale))


def impact_analysis(memory: Memory, most: int, include_stale: bool, target: str, depth: int | None = None, max_nodes: int | None = None) -> Gathered:
    """What depends on a target, or what a module holds."""
    found = graph.resolve_target(memory.nodes, target, memory.modules)
    hint = graph.target_hint(found, target)
    if hint:
        return nothing(memory, hint)
    subject = found.first()
    cap = graph.clamp(max_nodes, 30, 0, graph.HARD_NODES)
    if subject["step"] == "module":
        members = cut(graph.module_members(memory.nodes, subject["node_key"], cap))
        truncated = members.count() > cap
        rows = memory.judged(members.orderBy("node_type", "node_key").limit(cap))
        rows = member_rows(rows, F.lit(subject["node_key"]))
        origin_fresh = True
    else:
        reached, truncated = graph.impact(memory.edges, memory.nodes, subject["node_key"], depth, cap)
        reached = cut(reached)
        on_path = reached.select(F.explode("path").alias("node_key")).union(found.select("node_key")).distinct()
        state = cut(memory.judged(memory.nodes.join(F.broadcast(on_path), "node_key", "left_semi")).select("node_key", "file_path", "fresh"))  # hard caps bound the findings
        origin_fresh = state.where(F.col("node_key") == subject["node_key"]).first()["fresh"]
        by_path = reached.select(F.col("node_key").alias("found"), F.explode("path").alias("node_key")).join(state, "node_key", "left")
        sound = by_path.groupBy(F.col("found").alias("node_key")).agg(F.bool_and(F.coalesce("fresh", F.lit(False))).alias("fresh"))
        rows = reached.join(sound, "node_key").join(state.select("node_key", "file_path"), "node_key", "left").withColumn("fresh", F.col("fresh") & F.lit(origin_fresh))
        rows = rows.withColumn("reason", graph.finding_reason(F.col("direction"), F.col("relationship"), F.col("confidence"), F.col("node_type").isNull()))
    rows, warnings, stale = kept_fresh(rows, include_stale, "impact findings")
    reach = graph.clamp(depth, 2, 0, graph.HARD_DEPTH)
    first = IMPACT_NOTE.format(reach)
    warnings = [first, *warnings] + ([] if origin_fresh else ["The indexed impact subject changed; stored summaries and dependent relationships require source verification."])
    head = items(found, F.lit("impact-subject"), F.lit(180), F.concat_ws(" ", F.lit("Subject"), "node_type", F.coalesce("symbol_name", "node_key"), F.col("node_key")))
    body = finding_lines(rows)
    return Gathered(head.unionByName(body), warnings, ["impact_traversal"] if truncated else [], stale or not origin_fresh)


def change_history(memory: Memory, most: int, limit: int = 10) -> Gathered:
    if memory.changes is None:
        return nothing(memory)
    last = memory.changes.orderBy(F.desc("id")).limit(max(0, min(HISTORY, most, limit)))
    text = F.trim(F.concat(F.lit("Change #"), F.col("id").cast("string"), F.lit(" "), "intent", F.lit(" validation "), F.coalesce("validation", F.lit("unrecorded")), F.lit(" lessons "), F.coalesce("lessons", F.lit("none"))))
    return Gathered(items(last, F.concat(F.lit("change:"), F.col("id").cast("string")), F.lit(70), text))


def architecture_rules(memory: Memory, most: int, include_stale: bool) -> Gathered:
    out = rules_of(memory, F.lit(120), most, include_stale)
    if out.items.isEmpty():
        out.warnings.append("No usable architectural rules are stored. Draft suggestions require explicit approval.")
    return out


def gather(memory: Memory, operation: str, budget: int | None = None, include_stale: bool = False, **asked) -> Gathered:  # noqa: ANN003
    """The items of one operation, before they are ranked and packed."""
    most = candidates(budget)
    match operation:
        case "project_overview":
            return overview(memory, most)
        case "module_context":
            return module_context(memory, most, include_stale, asked.get("module", ""), asked.get("query", ""))
        case "symbol_lookup":
            return symbol_lookup(memory, most, include_stale, asked.get("symbol", ""))
        case "impact_analysis":
            return impact_analysis(memory, most, include_stale, asked.get("target", ""), asked.get("depth"), asked.get("max_nodes"))
        case "change_history":
            return change_history(memory, most, asked.get("limit", 10))
        case "architecture_rules":
            return architecture_rules(memory, most, include_stale)
    return nothing(memory, f"Unknown context operation [{operation}].")


def room(budget: int | None) -> int:
    return graph.clamp(budget, BUDGET, 0, MOST_BUDGET)


def candidates(budget: int | None) -> int:
    """How many candidates one question gathers: as many as the budget could show, within bounds."""
    return max(LEAST_CANDIDATES, min(MOST_CANDIDATES, search.CANDIDATES, math.ceil(room(budget) / TOKENS_A_CANDIDATE)))


def retrieve(memory: Memory, operation: str, budget: int | None = None, include_stale: bool = False, **asked) -> DataFrame:  # noqa: ANN003
    """One row: the packet of an operation. operation, header, ids (in order), text, used (bytes), estimated_tokens, warnings, stale, truncated,
    candidate_count, deduplicated_count, selected_count, omitted_count, compacted_count, candidate_limit, budget_tokens and
    truncation_reasons.

    Operations and what they take: project_overview; module_context(module, query); symbol_lookup(symbol);
    impact_analysis(target, depth, max_nodes); change_history(limit); architecture_rules. Another name gives a warning.
    """
    found = gather(memory, operation, budget, include_stale, **asked)
    warnings = list(dict.fromkeys(found.warnings))
    if found.limits:
        warnings.append(BOUNDED)
    header = "\n".join([operation.replace("_", " "), ADVICE, *(f"Warning: {w}" for w in warnings)])
    every = cut(found.items.withColumn("packet", F.lit(operation)))
    once = cut(search.deduplicated(every, "packet"))
    n, kept = every.count(), once.count()
    base = memory.spark.range(1).select(F.lit(operation).alias("packet"))
    size = min(len(header.encode()), room(budget) * 4)
    zero = {"used": F.lit(size), "ids": F.array().cast("array<string>"), "omitted": F.lit(0), "compacted": F.lit(0)}
    packed = base.join(search.packed(once, "packet", header, room(budget)), "packet", "left").withColumns({k: F.coalesce(k, v) for k, v in zero.items()})
    whole = packed.join(search.shown(once, "packet", header, room(budget)), "packet", "left")
    cut_short = F.col("omitted") + F.col("compacted") > 0
    reasons = F.array_distinct(F.array_compact(F.array(*map(F.lit, found.limits), F.when(cut_short, "token_budget"))))
    return whole.select(
        F.col("packet").alias("operation"), F.lit(header).alias("header"), "ids", F.concat_ws("\n", F.substring(F.lit(header), 1, size), "body").alias("text"), "used", F.ceil(F.col("used") / 4).alias("estimated_tokens"),
        F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"), F.lit(found.stale).alias("stale"), (cut_short | F.lit(bool(found.limits))).alias("truncated"),
        F.lit(n).alias("candidate_count"), F.lit(n - kept).alias("deduplicated_count"), F.size("ids").alias("selected_count"), F.col("omitted").alias("omitted_count"), F.col("compacted").alias("compacted_count"),
        F.lit(candidates(budget)).alias("candidate_limit"), F.lit(room(budget)).alias("budget_tokens"), reasons.alias("truncation_reasons"),
    )


def telemetry(packet: DataFrame, latency_ms: int, at: Column, agent: str | None = None, model: str | None = None, reported: dict[str, int] | None = None) -> DataFrame:
    """The row to be added to the log of runs for a packet of retrieve()."""
    told = lambda name: F.lit((reported or {}).get(name)).cast("int").alias(f"reported_{name}_tokens")
    basis = "mixed" if any(v is not None for v in (reported or {}).values()) else "estimated"
    return packet.select(
        "operation", F.lit(agent).cast("string").alias("agent"), F.lit(model).cast("string").alias("model"), told("input"), told("output"), told("cached"),
        F.octet_length("text").alias("retrieved_context_size"), F.col("estimated_tokens").alias("estimated_input_tokens"), F.lit(basis).alias("token_basis"), F.lit(latency_ms).alias("latency_ms"), "truncated", "stale", at.alias("created_at"),
    )
