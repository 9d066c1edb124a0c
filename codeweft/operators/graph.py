"""Traversals of the property graph as joins, one a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.scoring import CLASS_LIKE, INHERITANCE, STRUCTURAL, finding_confidence, impact_score, risk
from codeweft.functions.text import class_key
from codeweft.operators.lineage import cut
from codeweft.operators.postings import containing
from codeweft.operators.search import leading

HARD_NODES, HARD_DEPTH, HARD_FINDINGS = 1000, 10, 200


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types and symbols of both ends; an end without a node stays, with nulls."""
    side = lambda s: nodes.select(F.col("node_key").alias(f"{s}_key"), F.col("node_type").alias(f"{s}_type"), F.col("symbol_name").alias(f"{s}_symbol"))
    return edges.join(side("source"), "source_key", "left").join(side("target"), "target_key", "left")


#: Bits that tell which keys are looked for; a power of two.
KEY_BITS = 1 << 26


#: Kinds of keys that a filter names; of more, it names none.
MOST_KINDS = 64


def of_kinds(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``column`` is of a kind that some key is of: a kind is what stands before the first colon. A filter on fixed values goes below
    the aggregations and unions that rows are made of, so that those of other kinds are read, but not made."""
    kind = lambda c: F.substring_index(F.col(c), ":", 1)
    found = [r.kind for r in keys.select(kind(key).alias("kind")).where("kind is not null").distinct().limit(MOST_KINDS + 1).collect()]
    if not found:
        return rows.limit(0)
    return rows if len(found) > MOST_KINDS else rows.where(kind(column).isin(found))


def touching(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``column`` is among the keys, and few others: keys are bits at the places of their hashes, in words of 64 that every task gets.
    They take no more than KEY_BITS however many keys there are, so that of a large table only what a join needs goes through its shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(KEY_BITS))
    word = lambda c: F.shiftright(place(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    words = keys.where(F.col(key).isNotNull()).groupBy(word(F.col(key)).alias("_word")).agg(F.bit_or(bit(F.col(key))).alias("_bits"))
    return rows.join(F.broadcast(words), word(F.col(column)) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(F.col(column))) != 0).select(*rows.columns)


def first_visits(edges: DataFrame, frontier: DataFrame, visited: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One row for each node that a level reaches: against dependencies, and along containment out of files and classes.

    frontier(node_key, node_type, confidence, path), visited(node_key). Of several edges to a node, inheritance goes
    first, then the most confident, then the least keys. ``per`` names further columns of both, such as a question: traversals that
    differ in them go side by side and don't see each other.
    """
    back = edges.where(~F.col("relationship").isin(*STRUCTURAL)).select(F.col("target_key").alias("node_key"), F.col("source_key").alias("far"), "relationship", F.col("confidence").cast("double").alias("edge"), F.lit("incoming").alias("direction"))
    down = edges.where(F.col("relationship").isin(*STRUCTURAL)).select(F.col("source_key").alias("node_key"), F.col("target_key").alias("far"), "relationship", F.col("confidence").cast("double").alias("edge"), F.lit("outgoing").alias("direction"))
    inner = frontier.where(F.col("node_type").isin("file", *CLASS_LIKE))
    if per:  # the frontiers of many traversals may be large
        near = lambda rows, keys: touching(of_kinds(rows, "node_key", keys, "node_key"), "node_key", keys, "node_key")
        back, down = near(back, frontier), near(down, inner)
    reached = back.join(frontier, "node_key").unionByName(down.join(inner, "node_key"))
    reached = reached.join(visited.select(*per, F.col("node_key").alias("far")), [*per, "far"], "left_anti")
    # combined before the shuffle, so that no task meets all edges of a hub
    order = F.struct((~F.col("relationship").isin(*INHERITANCE)).alias("a"), (-F.col("edge")).alias("b"), "node_key", "relationship", "direction")
    best = reached.groupBy(*per, "far").agg(F.min_by(F.struct("relationship", "direction", "edge", "confidence", "path"), order).alias("b"))
    return best.select(*per, F.col("far").alias("node_key"), "b.relationship", "b.direction", "b.edge", F.least("b.confidence", "b.edge").alias("confidence"), F.concat("b.path", F.array("far")).alias("path"))


def impact(edges: DataFrame, nodes: DataFrame, origin: str, depth: int | None = None, most: int | None = None) -> tuple[DataFrame, bool]:
    """What depends on a node, level by level: (findings, truncated).

    Findings have node_key, node_type, symbol_name, relationship, direction, distance, confidence (the least along the
    path), path, risk and score. Without ``most`` every node within ``depth`` is found, in joins alone. With it, a level's
    visits are ordered as in first_visits() and ordinary edges stop at ``most`` findings; inheritance goes on to
    HARD_FINDINGS. Only a level's count comes to the driver.
    """
    depth = clamp(depth, 2, 0, HARD_DEPTH)
    cap = None if most is None else clamp(most, 30, 0, HARD_NODES)
    named = nodes.select("node_key", "node_type", "symbol_name")
    start = nodes.where(F.col("node_key") == origin).select("node_key", "node_type", F.lit(1.0).alias("confidence"), F.array("node_key").alias("path"))
    frontier, visited, found, total, truncated = start, start.select("node_key"), None, 0, False
    for level in range(1, depth + 1):
        new = first_visits(edges, frontier, visited).join(named, "node_key", "left").withColumn("distance", F.lit(level))
        if cap is not None:
            order = Window.orderBy(F.col("relationship").isin(*INHERITANCE).desc(), F.desc("edge"), "node_key")
            # no more than HARD_FINDINGS of a level can be taken: the window is over a top-k
            top = new.orderBy(F.col("relationship").isin(*INHERITANCE).desc(), F.desc("edge"), "node_key").limit(HARD_FINDINGS + 1)
            ranked = top.withColumn("_n", F.row_number().over(order)).withColumn("_inherits", F.col("relationship").isin(*INHERITANCE))
            room = F.when(F.col("_inherits"), HARD_FINDINGS - total).otherwise(min(cap, HARD_FINDINGS) - total)
            seen = ranked.count()
            new = cut(ranked.where(F.col("_n") <= room).drop("_n", "_inherits"))
            taken = new.count()
            total += taken
            truncated = truncated or taken < seen or total >= cap
        else:
            new = cut(new)  # the next level, its visited set and the result all read it
        found = new if found is None else found.unionByName(new)
        if cap is not None and (not taken or total >= HARD_FINDINGS):
            break
        frontier = new.select("node_key", "node_type", "confidence", "path")
        visited = visited.union(new.select("node_key"))
    if found is None:
        found = first_visits(edges, start, start.select("node_key")).join(named, "node_key", "left").withColumn("distance", F.lit(0)).limit(0)
    stub = F.col("node_type").isNull()
    sure = finding_confidence(F.col("confidence"), F.col("edge"), stub)
    shown = found.select("node_key", "node_type", "symbol_name", "relationship", "direction", "distance", sure.alias("confidence"), "path")
    return shown.withColumns({"risk": risk(F.coalesce("node_type", F.lit("")), F.col("relationship")), "score": impact_score(F.col("distance"), F.col("relationship"))}), truncated


def impact_of_each(edges: DataFrame, nodes: DataFrame, origins: DataFrame, depth: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """impact(), with ``most``, of many origins at once: origins(question, node_key), one node a question -> (findings with their question and file_path,
    (question, truncated)). The frontier carries the question, so that a level is the same few jobs for any number of them."""
    depth, cap = clamp(depth, 2, 0, HARD_DEPTH), clamp(most, 30, 0, HARD_NODES)
    named, per = nodes.select("node_key", "node_type", "symbol_name", "file_path"), ("question",)
    frontier = cut(origins.join(named.select("node_key", "node_type"), "node_key").select("question", "node_key", "node_type", F.lit(1.0).alias("confidence"), F.array("node_key").alias("path")))
    visited, found = frontier.select("question", "node_key"), None
    state = frontier.select("question", F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated"))
    inherits = F.col("relationship").isin(*INHERITANCE)
    for level in range(1, depth + 1):
        first = leading(first_visits(edges, frontier, visited, per), "question", [inherits.desc(), F.desc("edge"), "node_key"], HARD_FINDINGS + 1).join(state.select("question", "total"), "question")
        room = F.when(inherits, HARD_FINDINGS - F.col("total")).otherwise(min(cap, HARD_FINDINGS) - F.col("total"))
        level_rows = cut(first.withColumn("taken", F.col("_n") <= room).drop("_n", "total").join(named, "node_key", "left").withColumn("distance", F.lit(level)))
        counts = level_rows.groupBy("question").agg(F.count(F.lit(1)).alias("seen"), F.count_if("taken").alias("more"))
        both = state.join(counts, "question", "left").withColumns({"seen": F.coalesce("seen", F.lit(0)), "more": F.coalesce("more", F.lit(0))})
        total = F.col("total") + F.col("more")
        state = cut(both.select("question", total.alias("total"), (F.col("truncated") | (F.col("more") < F.col("seen")) | (total >= cap)).alias("truncated")))
        new = level_rows.where("taken").drop("taken")
        found = new if found is None else found.unionByName(new)
        # a question with all that it may have goes no further
        frontier = new.join(state.where(F.col("total") < HARD_FINDINGS).select("question"), "question", "left_semi").select("question", "node_key", "node_type", "confidence", "path")
        visited = visited.union(new.select("question", "node_key"))
    if found is None:
        found = first_visits(edges, frontier, visited, per).join(named, "node_key", "left").withColumn("distance", F.lit(0)).limit(0)
    sure = finding_confidence(F.col("confidence"), F.col("edge"), F.col("node_type").isNull())
    shown = found.select("question", "node_key", "node_type", "symbol_name", "relationship", "direction", "distance", sure.alias("confidence"), "path", "file_path")
    return shown.withColumns({"risk": risk(F.coalesce("node_type", F.lit("")), F.col("relationship")), "score": impact_score(F.col("distance"), F.col("relationship"))}), state.select("question", "truncated")


def module_members(nodes: DataFrame, module_key: str, most: int) -> DataFrame:
    """The first ``most`` nodes of a module but its files, by type and key; one more row tells that there are more."""
    return nodes.where((F.col("module_key") == module_key) & (F.col("node_type") != "file")).orderBy("node_type", "node_key").limit(most + 1)


def finding_reason(direction: Column, relationship: Column, confidence: Column, is_stub: Column) -> Column:
    unsure, unknown = F.when(confidence < 0.8, " (resolution is uncertain)").otherwise(""), F.when(is_stub, "; declaration is not indexed").otherwise("")
    return F.concat(F.initcap(direction), F.lit(" "), relationship, F.lit(" relationship"), unsure, unknown, F.lit("."))


def neighborhood(edges: DataFrame, seeds: DataFrame, most: int = 80, hard: int = 80) -> DataFrame:
    """Edges that touch a seed and aren't structural, the most confident first; incoming if the target is a seed."""
    keys = seeds.select(F.col("node_key").alias("_seed")).distinct()
    plain = edges.where(~F.col("relationship").isin(*STRUCTURAL))
    into = plain.join(keys.withColumnRenamed("_seed", "target_key"), "target_key", "left_semi").withColumn("incoming", F.lit(True))
    out = plain.join(keys.withColumnRenamed("_seed", "source_key"), "source_key", "left_semi").join(keys.withColumnRenamed("_seed", "target_key"), "target_key", "left_anti").withColumn("incoming", F.lit(False))
    both = into.unionByName(out)
    return both.orderBy(F.desc("confidence"), "source_key", "target_key", "relationship").limit(min(hard, most))


def neighborhood_of_each(edges: DataFrame, seeds: DataFrame, most: int = 80) -> DataFrame:
    """neighborhood() of many questions at once: seeds(question, node_key) -> the first ``most`` edges of each question, numbered in _n."""
    keys = seeds.select("question", F.col("node_key").alias("_seed")).distinct()
    plain = edges.where(~F.col("relationship").isin(*STRUCTURAL))
    at = lambda column: keys.withColumnRenamed("_seed", column)
    near = lambda column: touching(of_kinds(plain, column, keys, "_seed"), column, keys, "_seed")
    into = near("target_key").join(at("target_key"), "target_key").withColumn("incoming", F.lit(True))
    out = near("source_key").join(at("source_key"), "source_key").join(at("target_key"), ["question", "target_key"], "left_anti").withColumn("incoming", F.lit(False))
    return leading(into.unionByName(out), "question", [F.desc("confidence"), "source_key", "target_key", "relationship"], most)


def hops_of_each(edges: DataFrame, seeds: DataFrame, relationships: tuple[str, ...], depth: int = 4, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """hops(), with ``most``, of many questions at once: seeds(question, node_key) -> ((question, node_key, relationship, depth), the
    questions of which a level was cut)."""
    along = edges.where(F.col("relationship").isin(*relationships)).select("source_key", "target_key", "relationship")
    frontier = visited = seeds.select("question", "node_key").distinct()
    found = over = None
    for level in range(1, depth + 1):
        step = along.join(frontier, F.col("source_key") == F.col("node_key")).select("question", "source_key", "target_key", "relationship")
        step = cut(leading(step, "question", ["source_key", "target_key", "relationship"], most + 1))
        cut_here = step.where(F.col("_n") > most).select("question")
        new = step.where(F.col("_n") <= most).groupBy("question", F.col("target_key").alias("node_key")).agg(F.min("relationship").alias("relationship")).join(visited, ["question", "node_key"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(level)))
        found, over = (new, cut_here) if found is None else (found.unionByName(new), over.union(cut_here))
        frontier = new.select("question", "node_key")
        visited = visited.union(frontier)
    return found, over.distinct()


def hops(edges: DataFrame, seeds: DataFrame, relationships: tuple[str, ...], depth: int = 4, most: int | None = None) -> tuple[DataFrame, bool]:
    """What is reached forward over the given relationships: ((node_key, relationship, depth), whether a level was cut).

    A node counts at its least depth, by the least relationship that leads to it there. With ``most``, a level follows the
    first ``most`` edges by their keys alone. Each level is computed once; without ``most`` no count comes to the driver.
    """
    along = edges.where(F.col("relationship").isin(*relationships)).select("source_key", "target_key", "relationship")
    frontier = visited = seeds.select("node_key").distinct()
    found, truncated = None, False
    for level in range(1, depth + 1):
        step = along.join(frontier, F.col("source_key") == F.col("node_key")).select("source_key", "target_key", "relationship")
        if most is not None:
            step = cut(step.orderBy("source_key", "target_key", "relationship").limit(most + 1))
            truncated = truncated or step.count() > most
            step = step.orderBy("source_key", "target_key", "relationship").limit(most)
        new = step.groupBy(F.col("target_key").alias("node_key")).agg(F.min("relationship").alias("relationship")).join(visited, "node_key", "left_anti")
        new = cut(new.withColumn("depth", F.lit(level)))
        found = new if found is None else found.unionByName(new)
        frontier = new.select("node_key")
        visited = visited.union(frontier)
    return found, truncated


#: Steps of a target's resolution, in order.
STEPS = ("key", "symbol", "file", "module", "similar")


def resolve_target(nodes: DataFrame, target: str, modules: DataFrame | None = None, most: int = 6, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Candidates for a name, by the first step that finds any: (step, node_key, node_type, symbol_name, file_path).

    The steps are: its key, class-like prefixes all being ``class:``; a declared symbol, or an undeclared one if there is no
    declared; a file's path; a module's key or name (node_key is the module's); symbols that contain it in either case, of
    which there may be ``most``. ``steps`` names those to be tried besides the first two. Every step but the last is an equality, and none is run if one before it has found something.
    """
    name = target.strip()
    key = nodes.sparkSession.range(1).select(class_key(F.lit(name))).first()[0]
    columns = ["node_key", "node_type", "symbol_name", "file_path"]

    def at(step: str, rows: DataFrame) -> DataFrame:
        return cut(rows.select(F.lit(step).alias("step"), *columns))

    found = at("key", nodes.where(F.col("node_key") == key))
    if found.isEmpty():
        named = cut(nodes.where(F.col("symbol_name") == name).orderBy(F.col("file_path").isNull(), "node_key").limit(most).select(*columns))
        declared = named.where("file_path is not null")
        found = at("symbol", named if declared.isEmpty() else declared)
    if found.isEmpty() and "file" in steps:
        found = at("file", nodes.where((F.col("node_type") == "file") & (F.col("file_path") == name.replace("\\", "/"))))
    if found.isEmpty() and "module" in steps and modules is not None:
        own = modules.where((F.col("module_key") == name) | (F.col("name") == name)).orderBy("module_key").limit(1)
        found = at("module", own.select(F.col("module_key").alias("node_key"), F.lit("module").alias("node_type"), F.col("name").alias("symbol_name"), F.lit(None).cast("string").alias("file_path")))
    if found.isEmpty() and "similar" in steps:
        found = at("similar", nodes.where((F.col("node_type") != "file") & F.contains(F.lower("symbol_name"), F.lit(name.lower()))).orderBy("symbol_name", "node_key").limit(most))
    return found


def resolve_each(nodes: DataFrame, asked: DataFrame, modules: DataFrame | None = None, index: DataFrame | None = None, most: int = 6, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """resolve_target() of many questions at once: asked(question, asked) -> (question, step, node_key, node_type, symbol_name, file_path).

    All steps are equalities, the last one between grams of an ``index`` of the nodes (see postings); without one it finds nothing.
    Every step runs for all questions, and each question keeps those candidates that its first fruitful step gives.
    """
    name = F.trim("asked")
    q = asked.select("question", name.alias("_name"), class_key(name).alias("_key"), F.translate(name, "\\", "/").alias("_path"), F.lower(name).alias("_word"))
    columns = ["node_key", "node_type", "symbol_name", "file_path"]
    own = nodes.select(*columns)
    # the step, whether a candidate is but a mention, and the order within the step
    shape = lambda rows, step, n, late=F.lit(False), by=F.lit(""): rows.select("question", F.lit(step).alias("step"), *columns, F.lit(n).alias("_at"), late.alias("_late"), by.alias("_by"))
    equal = lambda rows, asked_as, column: q.join(touching(rows, column, q, asked_as), F.col(asked_as) == F.col(column))
    found = shape(equal(own, "_key", "node_key"), "key", 0)
    found = found.unionByName(shape(equal(own, "_name", "symbol_name"), "symbol", 1, F.col("file_path").isNull()))
    if "file" in steps:
        found = found.unionByName(shape(equal(own.where("node_type = 'file'"), "_path", "file_path"), "file", 2))
    if "module" in steps and modules is not None:
        called = modules.select(F.explode(F.array_distinct(F.array("module_key", "name"))).alias("_called"), F.col("module_key").alias("node_key"), F.lit("module").alias("node_type"), F.col("name").alias("symbol_name"), F.lit(None).cast("string").alias("file_path"))
        first = leading(q.join(called, F.col("_name") == F.col("_called")), "question", ["node_key"], 1)
        found = found.unionByName(shape(first, "module", 3))
    if "similar" in steps and index is not None:
        held = containing(index.where("field = 'symbol_name'"), q.select(F.col("_word").alias("word"))).select(F.col("word").alias("_word"), "node_key")
        near = q.join(held, "_word").join(own.where("node_type != 'file'"), "node_key")
        found = found.unionByName(shape(near, "similar", 4, by=F.col("symbol_name")))
    top = leading(found, "question", ["_at", "_late", "_by", "node_key"], most)
    whole = Window.partitionBy("question")
    best = F.struct("_at", "_late")
    return top.withColumn("_best", F.min(best).over(whole)).where(best == F.col("_best")).select("question", "step", *columns)


def target_hint(found: DataFrame, target: str) -> str | None:
    """What to tell of a target that resolve_target() has not found as one node or module; null if it has. Six rows at most are read."""
    rows = found.select("step", "symbol_name").orderBy("symbol_name").collect()
    if len(rows) == 1:
        return None
    if not rows:
        return f"No indexed symbol matches [{target.strip()}]. Inspect the source or synchronise the index."
    if rows[0]["step"] == "similar":
        return f"Multiple symbols match [{target.strip()}]. Inspect one of: {', '.join(r['symbol_name'] for r in rows[:5])}"
    return f"Multiple indexed declarations match [{target.strip()}]. Use a node key."


def inherited_methods(classes: DataFrame, methods: DataFrame, parents: DataFrame, calls: DataFrame, depth: int = 32) -> DataFrame:
    """Finds where each called method is declared: in the class itself, else in its traits, else in its parents.

    classes(class_key, adapts), methods(class_key, name, method_key, private), parents(class_key, parent_key, kind: trait or
    another), calls(class_key, name) -> (class_key, name, method_key, path, state): ``resolved`` with one declaration, ``none``
    if no ancestor has it, else ``unknown``: an ancestor isn't indexed or adapts its traits, a private one stands in
    the way, several differ, ancestors go round in a cycle, or there are ``depth`` of them or more in a row. What the traits of a
    class have shadows its parents, on every level. Names are compared in lower case; path is from the class to the
    declaring one, the least of several.

    First the classes that may be asked are collected upwards, then they are settled downwards from those that need no
    other, a round a level, each class and name once however many paths lead to it. What is never settled is in a cycle.
    """
    low = lambda c: F.lower(F.col(c))
    known = classes.select(low("class_key").alias("at"), F.coalesce("adapts", F.lit(False)).alias("adapts"))
    own = methods.select(low("class_key").alias("at"), low("name").alias("name"), "method_key", F.coalesce("private", F.lit(False)).alias("private"))
    up = cut(parents.select(low("class_key").alias("at"), low("parent_key").alias("next"), (F.col("kind") == "trait").alias("trait")).distinct())
    asked = cut(calls.select(low("class_key").alias("at"), low("name").alias("name")).distinct())

    reached = frontier = asked
    for _ in range(depth):
        frontier = cut(frontier.join(up, "at").select(F.col("next").alias("at"), "name").distinct().join(reached, ["at", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))

    facts = reached.join(known, "at", "left").join(own, ["at", "name"], "left").join(up.select("at", F.lit(True).alias("has_parents")).distinct(), "at", "left")
    here = F.when(F.col("adapts").isNull() | F.col("private"), "unknown").when(F.col("method_key").isNotNull(), "resolved").when(F.col("adapts"), "unknown").when(F.col("has_parents").isNull(), "none")
    facts = cut(facts.select("at", "name", "method_key", here.alias("state")))
    nothing = F.lit(None).cast("array<string>")
    settled = cut(facts.where("state is not null").select("at", "name", "state", "method_key", F.when(F.col("state") == "resolved", F.array("at")).otherwise(nothing).alias("path")))
    waiting = facts.where("state is null").select("at", "name")
    for _ in range(depth - 1):
        above = settled.select(F.col("at").alias("next"), "name", "state", "method_key", "path")
        each = waiting.join(up, "at").join(above, ["next", "name"], "left")

        def of(kind: Column) -> Column:
            count = lambda state: F.count_if(kind & state)
            found = F.when(kind & (F.col("state") == "resolved"), F.struct("method_key", "path"))
            keys = F.collect_set(found["method_key"])
            outcome = F.when(count(F.col("state") == "unknown") > 0, "unknown").when(count(F.col("state").isNull()) > 0, "open").when(F.size(keys) > 1, "unknown").when(F.size(keys) == 1, "resolved").otherwise("none")
            return F.struct(outcome.alias("state"), F.min(found).alias("found"))

        both = each.groupBy("at", "name").agg(of(F.col("trait")).alias("t"), of(~F.col("trait")).alias("p"))
        chosen = F.when(F.col("t.state") == "none", F.col("p")).otherwise(F.col("t"))
        new = both.select("at", "name", chosen.alias("c")).where("c.state != 'open'")
        sure = F.col("c.state") == "resolved"
        new = cut(new.select("at", "name", F.col("c.state").alias("state"), F.when(sure, F.col("c.found.method_key")).alias("method_key"), F.when(sure, F.concat(F.array("at"), "c.found.path")).alias("path")))
        if new.isEmpty():
            break
        settled = cut(settled.unionByName(new))
        waiting = cut(waiting.join(new, ["at", "name"], "left_anti"))

    # a class may call its own private method; as an ancestor's it only stands in the way
    mine = asked.join(own.where("private").select("at", "name", F.col("method_key").alias("own_key")), ["at", "name"], "left").join(known.select("at", F.lit(True).alias("there")), "at", "left")
    out = mine.join(settled, ["at", "name"], "left")
    private = F.col("own_key").isNotNull() & F.col("there").isNotNull()
    state = F.when(private, "resolved").otherwise(F.coalesce("state", F.lit("unknown")))
    return out.select(F.col("at").alias("class_key"), "name", F.when(private, F.col("own_key")).otherwise(F.col("method_key")).alias("method_key"), F.when(private, F.array("at")).otherwise(F.col("path")).alias("path"), state.alias("state"))


def declaring_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(file_path, ...) with declared_in, the node of the file that states them: null where that file isn't indexed, or edges name none."""
    files = nodes.where("node_type = 'file' and file_path is not null").select("file_path", F.col("node_key").alias("declared_in"))
    return edges.join(files, "file_path", "left")
