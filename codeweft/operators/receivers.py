"""What variables hold, and so where calls on them lead: types of receivers, found by joins and a fixpoint over rows.

Definitions and uses of variables are rows with a place in their method. A use takes the last definition before it. What is defined in a branch
doesn't last beyond it unless all branches agree, and closures see what they capture: such places get definitions of their own, which rest on
others. Types then spread from those that are known (``new``, parameters, properties, the container) to what is copied from them, round by
round, each definition once. Chains of query calls are a finite table of (kind of receiver, kind of method), so a whole chain
is one step.

Methods that are alike in all that this rests on, text, names and properties, are looked at once, however many classes hold them: see shared().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import normalized_key
from codeweft.operators import tokens as tk
from codeweft.operators.extract import all_of, full_name, read_once
from codeweft.operators.lineage import FEW_ROWS
from codeweft.operators.lineage import cut as cut_plain
from codeweft.operators.semantics import RELATION, is_model

MODEL, BUILDER = "Illuminate\\Database\\Eloquent\\Model", "Illuminate\\Database\\Eloquent\\Builder"
RELATED, COLLECTION = "Illuminate\\Database\\Eloquent\\Relations\\Relation", "Illuminate\\Support\\Collection"
#: Calls that give the query on, those that end it with a collection, and other calls that a model hands on to its query.
QUERY_CALLS = (
    "where", "orWhere", "whereIn", "orWhereIn", "whereNotIn", "whereNull", "orWhereNull", "whereNotNull", "whereBetween", "whereDate", "whereColumn", "whereHas", "orWhereHas", "whereDoesntHave", "with", "without",
    "withCount", "orderBy", "orderByDesc", "latest", "oldest", "groupBy", "having", "limit", "take", "skip", "offset", "forPage", "distinct", "select", "addSelect", "join", "leftJoin", "rightJoin", "crossJoin",
    "lockForUpdate", "sharedLock", "reorder", "inRandomOrder",
)
COLLECTION_CALLS = ("get", "pluck", "cursor", "lazy")
MODEL_CALLS = (
    "create", "forceCreate", "forceFill", "fill", "save", "update", "delete", "destroy", "query", "find", "findOrFail", "first", "firstOrFail", "firstOrCreate", "firstOrNew", "updateOrCreate", "all", "increment",
    "decrement", "refresh", "replicate", "push", "load", "loadMissing", "relationLoaded", "notify", "notifyNow", "getAttribute", "setAttribute", "newQuery", "withoutEvents", "sole", "value", "count", "exists",
    "doesntExist", "insert", "upsert",
)
#: What opens a branch, and what goes on with the branches before it.
BRANCHES, GOES_ON = ("if", "elseif", "else", "for", "foreach", "while", "do", "switch", "try", "catch", "finally"), ("else", "elseif", "catch", "finally")
COMPOUND = (".=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=")
AT = ["unit", "scope", "var"]
KEY = [*AT, "pos", "sub"]
TYPED = r"(?:^|[(,])\s*(?:#\[[^\]]*\]\s*)?(?:(?:public|protected|private|readonly)\s+)*\??(\\?[A-Za-z_][\w\\]*)\s+&?(?:\.\.\.)?\$(\w+)"
OWNED = r"(?m)^\s*(?:(?:public|protected|private|static|readonly|var)\s+)+\??(\\?[A-Za-z_][\w\\]*)\s+\$(\w+)\s*(?:=[^;]*)?;"
PROMOTED = r"(?:^|[(,])\s*(?:(?:public|protected|private|readonly)\s+)+\??(\\?[A-Za-z_][\w\\]*)\s+\$(\w+)"
CLASS_NAME = rf"^({tk.NAME})$"


def cut(rows: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """All that is kept here is made of tokens: alike from method to method, so that files say little of its size."""
    return cut_plain(rows, compact=True, few=few)


def units_of(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """files(path, text) -> one row a method: unit, method_key, its class with parents and typed properties, the class's relations, and its text."""
    read = read or read_once(files)
    entries = lambda text, pattern: F.arrays_zip(all_of(text, pattern, 2).alias("key"), all_of(text, pattern, 1).alias("value"))
    # patterns go over a body before the shuffles: their rows are few bytes, so that few tasks take what comes after
    methods = read[1].select("path", "class_key", "m", "method", "fqcn", "namespace", "imports", "parents", "parameters", "inner", is_model().alias("model"), entries(F.col("body"), OWNED).alias("owned"))
    promoted = F.flatten(F.collect_list(F.when(F.lower("method") == "__construct", entries(F.col("parameters"), PROMOTED)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))))
    # bounded by the methods of one class
    of_class = methods.groupBy("path", "class_key").agg(promoted.alias("promoted"), F.collect_set(F.when(F.col("model") & F.col("inner").rlike(RELATION), F.col("method"))).alias("relations"))
    key = normalized_key(F.concat(F.lit("method:"), "fqcn", F.lit("::"), "method"))
    rows = methods.join(of_class, ["path", "class_key"])
    typed = F.concat("owned", "promoted")
    properties = F.map_from_entries(F.filter(typed, lambda p, i: ~F.exists(F.slice(typed, i + 2, F.size(typed)), lambda q: q["key"] == p["key"])))
    unit = F.concat_ws("\x00", "path", "class_key", F.col("m").cast("string"))
    return rows.select(unit.alias("unit"), "path", key.alias("method_key"), "method", "fqcn", "namespace", "imports", F.get("parents", F.lit(0)).alias("parent"), properties.alias("properties"), "relations", F.concat(F.lit("("), "inner").alias("text"))


def numbered(files: DataFrame, read: tuple[DataFrame, DataFrame]) -> DataFrame:
    """units_of(), kept, with a number as their unit: tokens are sorted and joined by it many times, and names are long."""
    return cut(units_of(files, read).withColumn("unit", F.monotonically_increasing_id()))


#: Stands for the class that a method belongs to; no name holds it.
OWN = "\x01"
#: What calls lead to is of few short columns, so that more rows of it may be sent to all executors.
FEW_CALLS = 50000


def shared(units: DataFrame, models: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """units_of() -> (the units with their shape and ``own``, one unit for each shape): methods of equal text, namespace, imports, parent, properties and
    relations have one shape, a SHA-256. Their class is OWN in it, and in all that follows from it; it stays itself, and so part of the shape, where the
    method might name it in full, or where more than its name matters."""
    name, low = F.element_at(F.split("fqcn", r"\\"), -1), F.lower
    texts = F.concat_ws(" ", "text", F.transform("imports", lambda i: F.concat_ws(" ", i["alias"], i["name"])), "parent", F.map_values("properties"))
    plain = F.contains(low(texts), low(name)) | F.col("fqcn").endswith("\\Relation") | F.col("fqcn").endswith("\\Builder") | (F.col("fqcn") == MODEL)
    if models is not None:
        units = units.join(models.select("fqcn", F.lit(True).alias("_model")), "fqcn", "left")
        plain = plain | F.col("_model").isNotNull()
    units = units.withColumn("own", F.when(plain, F.col("fqcn")).otherwise(OWN))
    alike = [F.col("own").alias("fqcn"), "text", "namespace", "imports", "parent", F.map_entries("properties").alias("properties"), F.array_sort("relations").alias("relations")]
    units = units.withColumn("shape", F.sha2(F.to_json(F.struct(*alike), {"ignoreNullFields": "false"}), 256)).drop("_model")
    one = units.select("shape", *alike).distinct().withColumns({"properties": F.map_from_entries("properties"), "unit": F.monotonically_increasing_id()})
    return units, cut(one)


def of_each(units: DataFrame, shapes: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """rows(unit, ...) of the shapes, for each unit that has the shape; units have no other columns of these names."""
    return units.join(cut(rows.join(shapes.select("unit", "shape"), "unit").drop("unit"), FEW_CALLS), "shape", how)


def class_name(name: Column) -> Column:
    """A class as a row of units_of() means it; null for names of no class."""
    low = F.lower(name)
    full = full_name(name, F.col("namespace"), F.col("imports"))
    plain = name.rlike(r"^\\?[A-Z]|\\")
    return F.when(low.isin("self", "static"), F.col("fqcn")).when(low == "parent", F.col("parent")).when(plain, full)


def folded(base: Column, names: Column) -> Column:
    """How the type after some calls follows from that before them: ``same`` without calls, ``query`` while all give the query on,
    ``collection`` if the last of such gives a collection, else ``none``."""
    n, other = F.size(names), F.size(F.filter(names, lambda m: ~m.isin(*QUERY_CALLS)))
    last = F.try_element_at(names, F.lit(-1))
    return F.when(n == 0, "same").when(other == 0, "query").when((other == 1) & last.isin(*COLLECTION_CALLS), "collection").otherwise("none")


def applied(mode: Column, base: Column) -> Column:
    relation, builder = base.endswith("\\Relation"), base.endswith("\\Builder") | (base == MODEL)
    query = F.when(relation, F.lit(RELATED)).when(builder, F.lit(BUILDER))
    return F.when(mode == "same", base).when(mode == "query", query).when((mode == "collection") & (relation | builder), F.lit(COLLECTION))


#: What later steps take of _heads().
HEADS = ("calls", "modes", "base", "start_var", "fqcn", "head", "held", "static_class", "static_call", "held_class", "namespace")


def _heads(rows: DataFrame, units: DataFrame, inner: DataFrame, models: DataFrame | None) -> DataFrame:
    """Chains with their calls (name, place), and what they start from: a type that is known, or a variable. ``modes`` has a way to fold for each call,
    and one more for the whole chain."""
    parts, size = F.col("parts"), F.size("parts")
    is_call = lambda i: F.get(parts, i)["t"].isin("->", "?->") & F.get(parts, i + 2)["t"].eqNullSafe("(") & F.get(parts, i + 1)["t"].rlike(r"^\w+$")
    at = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), is_call)
    rows = rows.withColumn("at", at).withColumn("calls", F.transform("at", lambda i: F.struct(F.get(parts, i + 1)["t"].alias("name"), F.get(parts, i + 1)["i"].alias("place"))))
    end = F.when(F.size("at") > 0, F.get("at", F.lit(0))).otherwise(size)
    rows = rows.withColumn("head", F.array_join(F.slice("parts.t", F.lit(1), end), " "))
    first_in = inner.where("n = 1").select("unit", F.col("g").alias("opened"), F.col("text").alias("held"), F.col("alone"))
    opened = F.filter(F.slice(parts, F.lit(1), end), lambda p: p["t"] == "(")
    rows = rows.withColumn("opened", F.get(opened, F.lit(0))["i"]).join(first_in, ["unit", "opened"], "left").join(units.drop("text"), "unit")
    new = rf"^new ({tk.NAME})(?: \( \))?$"
    take = lambda text, pattern, group=1: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    head, held = F.col("head"), F.col("held")
    static = rf"^({tk.NAME}) :: (\w+) \( \)$"
    whole_new = F.coalesce(take(head, new), F.when((head == "( )") & F.col("alone"), take(held, new)))
    known = (
        F.when(head == "$this", F.col("fqcn"))
        .when(whole_new.isNotNull(), class_name(whole_new))
        .when(head.rlike(r"^(?:app|resolve) \( \)$"), class_name(take(held, rf"^({tk.NAME}) :: class$")))
        .when(head.rlike(r"^\$this \??-> \w+$"), class_name(F.try_element_at("properties", F.regexp_extract(head, r"-> (\w+)$", 1))))
    )
    rows = rows.withColumns({"known": known, "static_class": class_name(take(head, static)), "static_call": take(head, static, 2), "held_class": class_name(F.coalesce(take(held, new), take(held, rf"^({tk.NAME}) :: class$")))})
    if models is not None:
        rows = rows.join(models.select(F.col("fqcn").alias("static_class"), F.lit(True).alias("is_model")), "static_class", "left")
    else:
        rows = rows.withColumn("is_model", F.lit(None).cast("boolean"))
    names = F.col("calls.name")
    related = (head == "$this") & F.array_contains("relations", F.coalesce(F.get(names, F.lit(0)), F.lit("")))
    on_model = F.coalesce(F.col("is_model"), F.lit(False))
    # calls that are folded over come after a relation's own call, and a model's static call comes before them
    over = F.when(on_model, F.concat(F.array("static_call"), names)).otherwise(names)
    base = F.when(on_model, F.lit(MODEL)).when(related, F.lit(RELATED)).otherwise(F.col("known"))
    skip = F.when(related, 1).otherwise(0)
    count = lambda j: F.when(on_model, j + 1).otherwise(F.greatest(j - skip, F.lit(0)))
    modes = F.transform(F.sequence(F.lit(0), F.size("calls")), lambda j: F.when(related & (j == 0), "own").otherwise(folded(base, F.slice(over, skip + 1, count(j)))))
    modes = F.when((F.size("calls") == 0) & ~on_model, F.array(F.lit("same"))).otherwise(modes)  # most chains call nothing
    return rows.withColumns({"base": base, "modes": modes, "start_var": take(head, r"^\$(\w+)$")})


def events_of(units: DataFrame, models: DataFrame | None = None) -> dict[str, DataFrame]:
    """units_of() -> ``chains`` with heads and calls, ``definitions`` of variables that are known or unknown by themselves, ``rests`` of
    definitions on what others are at some place, and ``closures``."""
    chained = cut(tk.around(tk.chains(tk.nested(tk.tokens(tk.dealt(units))))))
    here = lambda which: chained.where(which)
    pairs = chained.where("text in ('{', '( )', '(', '[ ]') or pair is not null").select("unit", "first", "last", "pair")

    # closures: from their brace to its pair; arrow functions see what is around them and only have parameters of their own
    name_of = lambda c: F.regexp_extract(c, r"^\$(\w+)$", 1)
    braces = chained.where("text = '{'").select("unit", F.col("first").alias("brace"), F.col("pair").alias("close"))
    plain = lambda k: F.when(F.col("next1.text") == "&", F.col(f"next2.{k}")).otherwise(F.col(f"next1.{k}"))
    makers = here((F.lower("text") == "function") & F.col("brace").isNotNull()).select("unit", "g", F.col("first").alias("at"), plain("first").alias("takes"), "brace")
    used = here(F.lower("text") == "use").select("unit", "brace", F.col("next1.first").alias("uses"))
    closures = cut(makers.join(braces, ["unit", "brace"]).join(used, ["unit", "brace"], "left").select("unit", F.col("brace").alias("open"), "close", "takes", "uses"))
    arrows = cut(here(F.lower("text") == "fn").select("unit", "g", F.col("first").alias("open"), plain("first").alias("takes"), F.col("comma").alias("close")))
    ends = chained.where("pair is not null").select("unit", F.col("first").alias("g"), F.col("pair").alias("_close"))
    # what no method holds needs no joins: those of all that methods do hold would be shuffled for them
    encloses, points = not closures.isEmpty(), not arrows.isEmpty()
    if points:
        arrows = cut(arrows.join(ends, ["unit", "g"], "left").select("unit", "open", F.coalesce("close", "_close", F.lit(1 << 28)).alias("close"), "takes"))

    inside = closures.select("unit", F.col("open").alias("_open"), F.col("close").alias("_close"))

    def scoped(rows: DataFrame, at: str, within: str = "scope") -> DataFrame:
        """Adds the brace of the innermost closure around ``at``: 0 for the method itself."""
        if not encloses:
            return rows.withColumn(within, F.lit(0))
        ids = rows.select("unit", F.col(at).alias("_at")).distinct()
        found = ids.join(inside, "unit").where("_open < _at and _at < _close").groupBy("unit", "_at").agg(F.max("_open").alias(within))
        joined = rows.join(found.withColumnRenamed("_at", at), ["unit", at], "left")
        return joined.withColumn(within, F.coalesce(within, F.lit(0)))

    rows, own_takes = chained, F.col("g") == 0  # a method's parameters are its first brackets
    if encloses or points:
        parameters = closures.select("unit", F.col("takes").alias("g")).union(arrows.select("unit", "takes")).distinct().withColumn("_takes", F.lit(True))
        rows = cut(chained.join(parameters, ["unit", "g"], "left").withColumn("takes", F.coalesce("_takes", own_takes)).drop("_takes"))
    else:
        rows = chained.withColumn("takes", own_takes)
    body = rows.where("not takes")
    alone = rows.withColumn("alone", F.col("next1").isNull())
    # a single word or number holds nothing and calls nothing
    operands = _heads(body.where(F.col("text").rlike(r"^[$\w\\(]") & ~(F.col("text").rlike(r"^[\w\\]") & (F.size("parts") == 1))), units, alone, models)
    operands = cut(scoped(operands.select("unit", "first", *HEADS), "first"))

    # parameters: a variable with a type before it
    taken = rows.where("takes").select("unit", "g", F.col("first").alias("i"), name_of("text").alias("var"), "before", "text").where("var != ''")
    taken = taken.join(units.select("unit", "fqcn", "parent", "namespace", "imports"), "unit").withColumn("type", F.when(F.col("before").rlike(CLASS_NAME), class_name(F.col("before"))))
    doubled = rows.where("takes and text in ('|', '&')").select("unit", F.col("next2.first").alias("i"), F.lit(True).alias("_many"))  # A|B $x has no one type
    taken = taken.join(doubled, ["unit", "i"], "left").withColumn("type", F.when(F.col("_many").isNull(), F.col("type")))
    of_closure = taken.join(closures.select("unit", F.col("takes").alias("g"), "open"), ["unit", "g"]).select("unit", F.col("open").alias("scope"), "var", (F.col("open") * 4 + 3).alias("pos"), "type")
    of_method = taken.where("g = 0").select("unit", F.lit(0).alias("scope"), "var", F.lit(0).alias("pos"), "type")
    of_arrow = scoped(taken.join(arrows.select("unit", F.col("takes").alias("g"), "open", "close"), ["unit", "g"]), "open").select("unit", "scope", "var", (F.col("open") * 4 + 3).alias("pos"), "type", "open", "close")

    # assignments: known, or resting on a variable; they count from where their expression ends
    ended = ends.select("unit", "g", F.col("_close").alias("shut"))
    assigned = body.where(F.col("text").rlike(r"^\$\w+$") & F.col("next1.text").isin("=", *COMPOUND)).join(ended, ["unit", "g"], "left")
    assigned = scoped(assigned.select("unit", "g", "first", name_of("text").alias("var"), (F.col("next1.text") == "=").alias("plain"), F.col("next2.first").alias("right"), F.col("next3.text").alias("then"), F.coalesce("comma", "shut", F.lit(1 << 28)).alias("end")), "first")
    right = operands.select("unit", F.col("first").alias("right"), "base", "start_var", F.try_element_at("modes", F.lit(-1)).alias("mode"))
    assigned = assigned.join(right, ["unit", "right"], "left")
    simple = F.col("plain") & (F.col("then").isNull() | F.col("then").isin(";", ","))
    assigned = cut(assigned.withColumns({"pos": F.col("end") * 4, "type": F.when(simple & F.col("base").isNotNull(), applied(F.col("mode"), F.col("base"))), "rests": simple & F.col("base").isNull() & F.col("start_var").isNotNull()}))
    unset = cut(body.where("lower(text) = 'unset'").select("unit", F.col("next1.first").alias("g")))
    unsets = not unset.isEmpty()
    unset = scoped(rows.join(unset, ["unit", "g"]).where(F.col("text").rlike(r"^\$\w+$")).select("unit", "first", name_of("text").alias("var")), "first")

    none = F.lit(None).cast("string")
    zero = F.lit(0).alias("sub")
    given = [(True, of_method), (encloses, of_closure), (points, of_arrow), (True, assigned.where("not rests")), (unsets, unset.withColumns({"pos": F.col("first") * 4, "type": none}))]
    own = cut(reduce(DataFrame.unionByName, (d.select(*AT, "pos", zero, "type") for there, d in given if there)))
    ask = lambda df, pos, sub, at, scope, var="var", mode=F.lit("same"): df.select(*AT, pos.cast("long").alias("pos"), sub.cast("long").alias("sub"), scope.alias("ask_scope"), F.col(var).alias("ask_var"), at.cast("long").alias("at"), mode.alias("mode"))
    copied = ask(assigned.where("rests"), F.col("pos"), F.lit(0), F.col("right") * 4, F.col("scope"), "start_var", F.col("mode"))
    caught = rows.join(closures.where("uses is not null").select("unit", F.col("uses").alias("g"), "open"), ["unit", "g"]).where(F.col("text").rlike(r"^\$\w+$"))
    caught = scoped(caught.select("unit", "open", name_of("text").alias("var")), "open", "around").withColumn("scope", F.col("open"))
    captured = ask(caught, F.col("open") * 4 + 3, F.lit(0), F.col("open") * 4, F.col("around"))
    restored_arrow = ask(of_arrow, F.col("close") * 4 + 2, -F.col("open"), F.col("open") * 4, F.col("scope"))

    # branches: conditions and bodies of one statement, each of which starts from what was before it
    word = F.lower("text")
    heads = body.where(word.isin(*BRANCHES)).withColumn("goes_on", word.isin(*GOES_ON) | ((word == "if") & tk.same_or(F.lower("before"), "else")))
    numbered = heads.withColumn("statement", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("unit", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    has_condition = F.coalesce(F.col("next1.text") == "( )", F.lit(False))
    then, after = F.when(has_condition, F.col("next2")).otherwise(F.col("next1")), F.when(has_condition, F.col("next1.last")).otherwise(F.col("first"))
    loose = ~tk.same_or(then["text"], "{", ":", ";") & ~((word == "else") & tk.same_or(F.lower(F.col("next1.text")), "if")) & then.isNotNull()
    block = lambda a, b: F.struct(a.alias("open"), b.alias("close"))
    blocks = F.array_compact(F.array(F.when(has_condition, block(F.col("next1.first"), F.col("next1.last"))), F.when(tk.same_or(then["text"], "{"), block(then["first"], then["pair"])).when(loose, block(after, F.col("stop")))))
    branches = numbered.select("unit", "g", "statement", "first", F.explode(blocks).alias("b")).select("unit", "g", "statement", "first", "b.open", "b.close").where("close is not null")
    whole = branches.groupBy("unit", "g", "statement").agg(F.min("first").alias("start"), F.max("close").alias("end"), F.min("open").alias("first_open"))
    branches = cut(scoped(branches.drop("first").join(whole, ["unit", "g", "statement"]), "start"))
    parted = not branches.isEmpty()
    made = assigned.select(*AT, "pos").unionByName(unset.select(*AT, (F.col("first") * 4).alias("pos")))
    within = branches.join(made, ["unit", "scope"]).where("open * 4 < pos and pos <= close * 4")
    changed = within.select("unit", "g", "statement", "scope", "start", "end", "first_open", "var").distinct()
    changed = cut(changed) if parted else changed
    arms = changed.join(branches.select("unit", "g", "statement", "open", "close"), ["unit", "g", "statement"])
    merged = ask(changed, F.col("end") * 4 + 2, -F.col("start"), F.col("start") * 4, F.col("scope")).unionByName(ask(arms, F.col("end") * 4 + 2, -F.col("start"), F.col("close") * 4 + 1, F.col("scope")))
    restored = ask(arms.where("open > first_open"), F.col("open") * 4 + 3, F.lit(0), F.col("start") * 4, F.col("scope"))
    resting = [(True, copied), (encloses, captured), (points, restored_arrow), (parted, merged), (parted, restored)]
    rests = cut(reduce(DataFrame.unionByName, (d for there, d in resting if there)))
    return {"chains": operands, "definitions": own, "rests": rests, "closures": closures}


def reaching(definitions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(unit, scope, var, at) with pos and sub of the last of definitions(unit, scope, var, pos, sub) before: one sort for each variable."""
    none = F.lit(None).cast("long")
    events = definitions.select(*AT, "pos", "sub", F.lit(1).alias("is_def")).distinct().unionByName(asked.select(*AT, "at").distinct().select(*AT, F.col("at").alias("pos"), none.alias("sub"), F.lit(0).alias("is_def")))
    by = Window.partitionBy(*AT).orderBy("pos", "is_def", "sub").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_def") == 1, F.struct("pos", "sub")), ignorenulls=True).over(by)
    found = events.withColumn("d", last).where("is_def = 0").select(*AT, F.col("pos").alias("at"), F.col("d.pos").alias("pos"), F.col("d.sub").alias("sub"))
    return asked.join(found, [*AT, "at"])


def types_of(own: DataFrame, rests: DataFrame) -> DataFrame:
    """(unit, scope, var, pos, sub, type) of all definitions: those that are given, and those that rest on others once all of these are settled. A
    definition that rests on several has a type if they agree on it. Nothing rests on what comes after it, so every round settles some."""
    own = cut(own.groupBy(*KEY).agg(F.max("type").alias("type")).withColumn("sub", F.col("sub").cast("long")).withColumn("pos", F.col("pos").cast("long")))
    keys = own.select(*KEY).unionByName(rests.select(*KEY)).distinct()
    asked = rests.select(*(F.col(k).alias(f"d_{k}") for k in KEY), "mode", "unit", F.col("ask_scope").alias("scope"), F.col("ask_var").alias("var"), "at")
    waiting = cut(reaching(keys, asked).join(own.select(*(F.col(k).alias(f"d_{k}") for k in KEY)), [f"d_{k}" for k in KEY], "left_anti"))
    settled = new = own
    while True:
        known = waiting.join(settled.withColumn("there", F.lit(True)), KEY, "left")
        ready = F.col("there").isNotNull() | F.col("pos").isNull()
        value = applied(F.col("mode"), F.col("type"))
        by = known.groupBy(*(f"d_{k}" for k in KEY)).agg(F.count_if(~ready).alias("open"), F.count_if(value.isNull()).alias("unknown"), F.min(value).alias("a"), F.max(value).alias("b"))
        agreed = F.when((F.col("unknown") == 0) & (F.col("a") == F.col("b")), F.col("a"))
        new = cut(by.where("open = 0").select(*(F.col(f"d_{k}").alias(k) for k in KEY), agreed.alias("type")))
        if new.isEmpty():
            return settled
        settled = cut(settled.unionByName(new))
        waiting = cut(waiting.join(new.select(*(F.col(k).alias(f"d_{k}") for k in KEY)), [f"d_{k}" for k in KEY], "left_anti"))


def receivers(units: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """units_of() -> (unit, place, name, type) of each call on something: the class of what it is called on, null where that isn't known."""
    units, shapes = shared(units, models)
    rows = of_each(units.select("unit", "shape", "fqcn"), shapes, _typed_calls(events_of(shapes, models)))
    return rows.select("unit", "place", "name", F.when(F.col("type") == OWN, F.col("fqcn")).otherwise(F.col("type")).alias("type"))


def _typed_calls(found: dict[str, DataFrame]) -> DataFrame:
    types = types_of(found["definitions"], found["rests"])
    calls = found["chains"].where("size(calls) > 0").select("unit", "scope", "first", "base", "start_var", F.posexplode("calls").alias("j", "c"), "modes", "fqcn")
    calls = calls.select("unit", "scope", (F.col("first") * 4).cast("long").alias("at"), "base", F.col("start_var").alias("var"), F.col("c.name").alias("name"), F.col("c.place").alias("place"), F.get("modes", F.col("j")).alias("mode"), "fqcn")
    known = calls.where("base is not null or var is null").withColumn("type", F.when(F.col("mode") == "own", F.col("fqcn")).otherwise(applied(F.col("mode"), F.col("base"))))
    asked = calls.where("base is null and var is not null")
    by_var = reaching(types.select(*KEY), asked).join(types, KEY, "left").withColumn("type", applied(F.col("mode"), F.col("type")))
    out = ["unit", "place", "name", "type"]
    return known.select(*out).unionByName(by_var.select(*out))


def _plain_calls(units: DataFrame, shapes: DataFrame, chains: DataFrame) -> DataFrame:
    """What chains call without a receiver: own and inherited static calls, dispatches, events, what the container gives, and functions. A function
    of a namespace may be its own or the global one, so both are named, neither for sure; those at the root by a leading backslash are left out,
    as most are the language's own."""
    head, held = F.col("head"), F.coalesce("held", F.lit(""))
    first = F.regexp_extract("head", rf"^({tk.NAME}) (?:::|\()", 1)
    low = F.lower(first)
    edge = lambda prefix, to, rel, sure, via=None, how=None: F.struct(F.concat(F.lit(prefix), to).alias("target"), F.lit(rel).alias("relationship"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("decimal(3,2)").alias("confidence"), (via if isinstance(via, Column) else F.lit(via)).cast("string").alias("via"), F.lit(how).cast("string").alias("resolution"))
    to, call = F.col("static_class"), F.col("static_call")
    own = low.isin("self", "static", "parent")
    dispatches = (call == "dispatch") & ~own
    function = head.rlike(rf"^{tk.NAME} \( \)$") & ~low.isin(*tk.WORDS, "new")
    at_root, spaced = first.startswith("\\"), F.col("namespace") != ""
    plain = F.regexp_replace(first, r"^\\+", "")
    said = F.array_compact(F.array(
        F.when(own & to.isNotNull() & call.isNotNull(), edge("method:", F.concat(to, F.lit("::"), call), "calls", F.when(low == "static", 0.4).otherwise(0.85))),
        F.when(dispatches & to.endswith("Event"), edge("class:", to, "dispatches_event", 0.7)).when(dispatches & to.isNotNull(), edge("class:", to, "depends_on", 0.75, "dispatch")),
        F.when(function & (low == "event") & held.startswith("new ") & F.col("held_class").isNotNull(), edge("class:", F.col("held_class"), "dispatches_event", 0.7)),
        F.when(function & low.isin("app", "resolve") & held.endswith(" :: class") & F.col("held_class").isNotNull(), edge("class:", F.col("held_class"), "depends_on", 0.8, low)),
        F.when(function & ~at_root & spaced, edge("function:", F.concat("namespace", F.lit("\\"), first), "calls", 0.65, None, "namespace_fallback")),
        F.when(function & ~at_root & spaced, edge("function:", first, "calls", 0.5, None, "global_fallback")),
        F.when(function & ((at_root & plain.contains("\\")) | (~at_root & ~spaced)), edge("function:", plain, "calls", 0.95, None, "resolved_name")),
    ))
    # all of these end with what is called
    rows = of_each(units.select("shape", "fqcn", "path", "method_key"), shapes, chains.where(head.endswith(" ( )")).select("unit", F.explode(said).alias("e")))
    return rows.select(F.col("method_key").alias("source_key"), normalized_key(F.replace("e.target", F.lit(OWN), F.col("fqcn"))).alias("target_key"), "e.relationship", "e.confidence", F.col("path").alias("file_path"), "e.resolution", "e.via")


def models_of(read: tuple[DataFrame, DataFrame]) -> DataFrame:
    return read[0].where(is_model()).select("fqcn").distinct()


def _read(files: DataFrame, read: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The units of files, their shapes, and the events of these."""
    read = read or read_once(files)
    models = models_of(read)
    units, shapes = shared(numbered(files, read), models)
    return units, shapes, events_of(shapes, models)


def _edges_on_types(units: DataFrame, shapes: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    target = lambda of: normalized_key(F.concat(F.lit("method:"), of, F.lit("::"), F.col("name")))
    typed = _typed_calls(found).where("type is not null").select("unit", "name", "type", F.when(F.col("type") != OWN, target(F.col("type"))).alias("target"))
    rows = of_each(units.select("shape", "fqcn", "path", "method_key"), shapes, typed).withColumn("type", F.when(F.col("type") == OWN, F.col("fqcn")).otherwise(F.col("type")))
    return rows.select(F.col("method_key").alias("source_key"), F.coalesce("target", target(F.col("type"))).alias("target_key"), F.lit("calls").alias("relationship"), F.lit(0.75).cast("decimal(3,2)").alias("confidence"), F.col("path").alias("file_path"), F.when(F.col("type").startswith("Illuminate\\"), "framework_type").alias("resolution"))


def body_edges(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """files(path, text) -> (calls on what receivers hold, other calls of bodies), in the columns of ``extract.graph_of`` with ``resolution``: framework_type for
    receivers of the framework, how a function's name was understood, else null."""
    units, shapes, found = _read(files, read)
    return _edges_on_types(units, shapes, found), _plain_calls(units, shapes, found["chains"])


def receiver_edges(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The first of body_edges()."""
    return _edges_on_types(*_read(files, read))


def unresolved_calls(files: DataFrame) -> DataFrame:
    """(method_key, unresolved) of each method: its calls on what isn't known, and those whose name is computed."""
    units, shapes, found = _read(files, None)
    open_ = _typed_calls(found).groupBy("unit").agg(F.count_if(F.col("type").isNull()).alias("n"))
    return of_each(units.select("shape", "method_key"), shapes, open_, "left").groupBy("method_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved"))
