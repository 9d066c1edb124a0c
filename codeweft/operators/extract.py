"""Declarations, references, routes, templates and migrations out of source texts, by regular expressions in columns.

This reads what source code states on its face: declarations, inheritance, instantiations, static calls, routes, templates,
table definitions. It infers no types of local variables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.scoring import class_role
from codeweft.functions.text import normalized_key, plural, singular, snake, view_name
from codeweft.operators.lineage import cut

#: What migrations say of a table: one row for each file and table.
SHARED = "node_key string, file_path string, operation string, columns array<struct<name:string,type:string>>"
NODE = "node_key string, node_type string, symbol_name string, file_path string, content_hash string, signature string, visibility string, adapts boolean"
DECLARED = r"(?m)^\s*(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)(?:\s*:\s*\w+)?(?:\s+extends\s+([\w\\, ]+?))?(?:\s+implements\s+([\w\\,\s]+?))?\s*\{"
#: Modifiers and name of a method, up to the parenthesis that opens its parameters.
METHOD = r"(?m)^\s*((?:(?:public|protected|private|static|abstract|final)\s+)*)function\s+&?(\w+)\s*\("
PARAMETER = r"(?:^|,)\s*(?:(?:public|protected|private|readonly)\s+)*(\??[\w\\|&]+)\s+&?(?:\.\.\.)?\$\w+"
PROPERTY = r"(?m)^\s*(?:(?:public|protected|private|static|readonly|var)\s+)+(\??[\w\\|&]+)\s+\$\w+\s*(?:=[^;]*)?;"
#: Attributes at the end of a text, that is, just before what follows it.
ATTRIBUTES = r"(?s)((?:#\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]\s*+)++)$"
#: The actions of a resource with their verbs and paths.
RESOURCE = (("index", "GET", ""), ("create", "GET", "/create"), ("store", "POST", ""), ("show", "GET", "/{id}"), ("edit", "GET", "/{id}/edit"), ("update", "PUT", "/{id}"), ("destroy", "DELETE", "/{id}"))
FORMS = ("create", "edit")


#: Strings in either quotes and comments, told from each other by where they start; what isn't closed goes on to the end.
QUOTED = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+|//[^\n]*+|#(?!\[)[^\n]*+"


def without_comments(code: Column) -> Column:
    """Code without its comments, by one scan in which strings stay as they are."""
    return F.regexp_replace(code, rf"(?s)({QUOTED})|{COMMENT}", "$1")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def held(text: Column, *words: str) -> Column:
    """The text if it holds one of the words, else an empty one: for patterns that find nothing without these, as looking for a word is many times
    faster."""
    none = reduce(lambda a, b: a & b, (~text.contains(w) for w in words))
    return F.when(none, "").otherwise(text)


def heads_of(text: Column, pattern: str, **groups: int) -> Column:
    """What a pattern finds, as structs of the groups by name: one scan of the text, and one of each match."""
    return F.transform(all_of(text, pattern, 0), lambda h: F.struct(*(F.regexp_extract(h, pattern, g).alias(n) for n, g in groups.items())))


def distinct_captures(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(all_of(text, pattern, group))


def full_name(name: Column, namespace: Column, imports: Column) -> Column:
    """A class name in full: absolute, imported by its last segment, or of the namespace."""

    def told(n: Column) -> Column:
        own = F.when(namespace == "", n).otherwise(F.concat(namespace, F.lit("\\"), n))
        first = F.get(F.split(n, r"\\"), F.lit(0))
        imported = F.get(F.filter(imports, lambda i: F.lower(i["alias"]) == F.lower(first)), F.lit(0))["name"]
        rest = F.substring(n, F.length(first) + 1, F.lit(1 << 20))
        return bound(imported, lambda of: F.when(n.startswith("\\"), F.substring(n, 2, 1 << 20)).when(of.isNotNull(), F.concat(of, rest)).otherwise(own))

    return bound(name, told)


def imports_of(code: Column) -> Column:
    """Imports as (alias, name): single ones, with or without an alias, and those in groups; functions and constants aside."""
    statement = r"(?m)^use\s+(?!function\b|const\b)\\?([\w\\]+(?:\\\{[^}]*\})?(?:\s+as\s+\w+)?)\s*;"
    last = lambda name: F.element_at(F.split(name, r"\\"), -1)

    def one(prefix: Column, entry: Column) -> Column:
        name = F.concat(prefix, F.regexp_extract(entry, r"^\s*([\w\\]+)", 1))
        alias = F.regexp_extract(entry, r"\s+as\s+(\w+)", 1)
        return F.struct(F.when(alias != "", alias).otherwise(last(name)).alias("alias"), name.alias("name"))

    def each(use: Column) -> Column:
        prefix, group = F.regexp_extract(use, r"^([\w\\]*\\)\{", 1), F.regexp_extract(use, r"\{([^}]*)\}", 1)
        entries = F.filter(F.split(group, ","), lambda e: F.trim(e) != "")
        return F.when(use.contains("{"), F.transform(entries, lambda e: one(prefix, e))).otherwise(F.array(one(F.lit(""), use)))

    return F.flatten(F.transform(all_of(code, statement), each))


def class_types(declared_type: Column, namespace: Column, imports: Column, own: Column) -> Column:
    """The classes that a type names, in full: parts of unions and intersections, nullable or not; built-in types aside."""
    parts = F.split(F.regexp_replace(declared_type, r"[?\s]", ""), r"[|&]")
    named = F.filter(parts, lambda t: t.rlike(r"^\\?[A-Z]") | t.isin("self", "static"))
    return F.transform(named, lambda t: F.when(t.isin("self", "static"), own).otherwise(full_name(t, namespace, imports)))


def declared(files: DataFrame) -> DataFrame:
    """files(path, text) -> one row for each class-like declaration: path, namespace, imports, kind, name, class_key, parents,
    interfaces, traits, the text of the attributes before it and that of its body up to the next declaration."""
    code = without_comments(F.col("text"))
    rows = files.select("path", F.sha2("text", 256).alias("content_hash"), code.alias("code"))
    rows = rows.withColumns({"namespace": F.regexp_extract("code", r"(?m)^\s*namespace\s+([\w\\]+)\s*;", 1), "imports": imports_of(F.col("code"))})
    heads = heads_of(F.col("code"), DECLARED, kind=1, name=2, extends=3, implements=4)
    rows = rows.withColumns({"bodies": F.split("code", DECLARED), "heads": heads})
    # outer, then without what is empty: else Spark looks for empty ones beforehand, by all these patterns once more, and even before a shuffle
    rows = rows.select("path", "content_hash", "namespace", "imports", "bodies", F.posexplode_outer("heads").alias("i", "h")).where("i is not null").withColumns({"body": F.get("bodies", F.col("i") + 1), "attributes": F.regexp_extract(F.get("bodies", F.col("i")), ATTRIBUTES, 1)})
    names = lambda c: F.transform(F.filter(F.split(c, r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: full_name(F.trim(x), F.col("namespace"), F.col("imports")))
    name = F.col("h.name")
    fqcn = F.when(F.col("namespace") == "", name).otherwise(F.concat("namespace", F.lit("\\"), name))
    traits = F.flatten(F.transform(all_of(F.col("body"), r"(?m)^\s+use\s+([\w\\,\s]+?)\s*[;{]"), lambda t: F.split(t, r"\s*,\s*")))
    resolve = lambda a: F.transform(a, lambda x: full_name(x, F.col("namespace"), F.col("imports")))
    return rows.select("path", "content_hash", "namespace", "imports", F.col("h.kind").alias("kind"), name.alias("name"), fqcn.alias("fqcn"), normalized_key(F.concat(F.lit("class:"), fqcn)).alias("class_key"), names(F.col("h.extends")).alias("parents"), names(F.col("h.implements")).alias("interfaces"), resolve(traits).alias("traits"), "attributes", "body")


def methods_of(found: DataFrame) -> DataFrame:
    """Declarations, one row for each of their methods: its name, modifiers, parameters, return type, and in ``inner`` the text between
    its head and the next one's."""
    rows = found.withColumn("parts", F.split("body", METHOD)).withColumn("heads", heads_of(F.col("body"), METHOD, method=2, modifiers=1))
    rows = rows.select("*", F.posexplode_outer("heads").alias("m", "head")).where("m is not null").select("*", "head.method", "head.modifiers").withColumn("inner", F.get("parts", F.col("m") + 1))
    rows = rows.withColumn("parameters", F.coalesce(balanced(F.col("inner")), F.lit("")))
    return rows.withColumn("returns", F.regexp_extract(F.substring("inner", F.length("parameters") + 2, F.lit(1 << 20)), r"^\s*:\s*([?\w\\|&\s]+?)\s*[{;]", 1))


def read_once(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declared(), methods_of()) of files, each computed once for all that is read from them."""
    found = cut(declared(files))
    return found, cut(methods_of(found))


def graph_of(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files: nodes as in NODE; edges(source_key, target_key, relationship, confidence, file_path, via). ``read`` is
    read_once() of the files, where it is known."""
    found, spans = read or read_once(files)
    file_key = normalized_key(F.concat(F.lit("file:"), F.col("path")))
    visibility = F.regexp_extract("modifiers", r"(private|protected)", 1)
    signature = F.concat(F.col("method"), F.lit("("), F.regexp_replace(F.trim("parameters"), r"\s+", " "), F.lit(")"), F.when(F.col("returns") != "", F.concat(F.lit(": "), F.col("returns"))).otherwise(""))
    methods = spans.withColumns({"signature": signature, "visibility": F.when(visibility == "", "public").otherwise(visibility)}).dropDuplicates(["path", "class_key", "method"])
    method_symbol = F.concat("fqcn", F.lit("::"), F.col("method"))
    method_key = normalized_key(F.concat(F.lit("method:"), method_symbol))
    unset = {"signature": F.lit(None).cast("string"), "visibility": F.lit(None).cast("string"), "adapts": F.lit(None).cast("boolean")}
    more = lambda df: [F.col(n) if n in df.columns else c.alias(n) for n, c in unset.items()]
    node = lambda df, key, kind, symbol: df.select(key.alias("node_key"), kind.alias("node_type"), symbol.alias("symbol_name"), F.col("path").alias("file_path"), "content_hash", *more(df))
    role = class_role(F.col("kind"), F.col("name"), F.exists("interfaces", lambda i: i.endswith("ShouldQueue")))
    own_files = files.select("path", F.sha2("text", 256).alias("content_hash"))
    nodes = node(own_files, file_key, F.lit("file"), F.lit(None).cast("string")).unionByName(node(found.withColumn("adapts", F.col("body").rlike(r"(?m)^\s+use\s+[\w\\,\s]+\{")), F.col("class_key"), role, F.col("fqcn"))).unionByName(node(methods, method_key, F.lit("method"), method_symbol))

    # all that a class, or a method, states is one array, so that each is passed over once; keys are brought to length at the end
    def said(source: Column, prefix: str, targets: Column, rel: str, sure: float, via: str | None = None) -> Column:
        given = lambda t: F.struct(source.alias("source_key"), F.concat(F.lit(prefix), t).alias("target_key"), F.lit(rel).alias("relationship"), F.lit(sure).cast("decimal(3,2)").alias("confidence"), F.lit(via).cast("string").alias("via"))
        return F.transform(targets, given)

    full = lambda c: full_name(c, F.col("namespace"), F.col("imports"))
    typed = lambda types: F.array_distinct(F.flatten(F.transform(types, lambda t: class_types(t, F.col("namespace"), F.col("imports"), F.col("fqcn")))))
    none = F.array().cast("array<string>")
    is_model = F.exists("parents", lambda c: c.rlike(r"(^|\\)(Model|Authenticatable|Pivot)$"))
    table = F.regexp_extract("body", r"\$table\s*=\s*['\"]([A-Za-z_]\w*)['\"]", 1)
    file, of_class, of_method = F.concat(F.lit("file:"), F.col("path")), F.col("class_key"), F.concat(F.lit("method:"), method_symbol)
    by_class = F.concat(
        said(file, "", F.array(of_class), "defines", 1), said(of_class, "class:", F.col("parents"), "extends", 0.95), said(of_class, "class:", F.col("interfaces"), "implements", 0.95),
        said(of_class, "class:", F.col("traits"), "uses_trait", 0.95), said(of_class, "class:", typed(all_of(F.col("body"), PROPERTY)), "depends_on", 0.95, "property"),
        said(of_class, "table:", F.when(is_model & (table != ""), F.array(table)).otherwise(none), "uses_table", 0.9),
        said(of_class, "table:", F.when(is_model & (table == ""), F.array(snake(plural(F.col("name"))))).otherwise(none), "uses_table", 0.7),
    )
    static = r"(\\?\b[A-Z][\w\\]*)::(\w+)\s*\("
    inner = F.col("inner")
    statics = held(inner, "::")
    pairs = F.filter(F.array_distinct(F.arrays_zip(all_of(statics, static, 1).alias("c"), all_of(statics, static, 2).alias("f"))), lambda x: x["f"] != "dispatch")
    called = F.transform(pairs, lambda x: F.concat(full(x["c"]), F.lit("::"), x["f"]))
    by_method = F.concat(
        said(file, "", F.array(of_method), "defines", 1), said(of_class, "", F.array(of_method), "contains", 1),
        said(of_method, "class:", typed(all_of(F.col("parameters"), PARAMETER)), "depends_on", 0.95, "parameter"), said(of_method, "class:", typed(F.array("returns")), "depends_on", 0.95, "return_type"),
        said(of_method, "class:", F.transform(distinct_captures(held(inner, "new"), r"\bnew\s+(\\?[A-Z][\w\\]*)"), full), "depends_on", 0.9, "new"), said(of_method, "method:", called, "calls", 0.85),
        said(of_method, "method:", F.transform(distinct_captures(inner, r"\$this->(\w+)\s*\("), lambda m: F.concat("fqcn", F.lit("::"), m)), "calls", 0.75),
        said(of_method, "view:", distinct_captures(held(inner, "view("), r"\bview\(\s*['\"]([\w.\-/]+)['\"]"), "renders_view", 0.9), said(of_method, "route:", distinct_captures(held(inner, "route("), r"\broute\(\s*['\"]([\w.\-]+)['\"]"), "references_route", 0.8),
    )
    edges = found.select("path", F.explode(by_class).alias("e")).unionByName(spans.select("path", F.explode(by_method).alias("e")))
    edges = edges.select(normalized_key(F.col("e.source_key")).alias("source_key"), normalized_key(F.col("e.target_key")).alias("target_key"), "e.relationship", "e.confidence", F.col("path").alias("file_path"), "e.via")
    return nodes, edges


def templates(files: DataFrame) -> DataFrame:
    """files(path, text) -> (path, view, includes, components, routes) of templates, comments and verbatim parts aside."""
    text = F.regexp_replace("text", r"(?s)\{\{--.*?--\}\}|@verbatim.*?@endverbatim|@@\w+", "")
    rows = files.select("path", view_name(F.col("path")).alias("view"), text.alias("t")).where("view is not null")
    quoted = lambda names: rf"@(?:{names})\s*\(\s*['\"]([\w.\-/:]+)['\"]"
    return rows.select(
        "path",
        "view",
        F.array_sort(distinct_captures(F.col("t"), quoted("include|includeIf|extends|each"))).alias("includes"),
        F.array_sort(F.array_distinct(F.concat(all_of(F.col("t"), r"<x-([\w.\-]+)"), all_of(F.col("t"), quoted("component"))))).alias("components"),
        F.array_sort(distinct_captures(F.col("t"), r"\broute\(\s*['\"]([\w.\-]+)['\"]")).alias("routes"),
    )


def without_quoted_parentheses(text: Column) -> Column:
    """The text with the parentheses within quotes as other characters, so that it keeps its length. Each text is split once, however many quotes
    it holds."""
    parts = lambda t: F.struct(F.split(t, QUOTED, -1).alias("plain"), F.transform(all_of(t, QUOTED, 0), lambda q: F.translate(q, "()", "\x01\x02")).alias("quotes"))
    joined = lambda m: F.array_join(F.flatten(F.transform(m["plain"], lambda p, i: F.array(p, F.coalesce(F.get(m["quotes"], i), F.lit(""))))), "")
    return bound(text, lambda t: bound(parts(t), joined))


def balanced(text: Column) -> Column:
    """What comes before the parenthesis that closes the one just before ``text``; null if none does. Parentheses may nest to any
    depth; those in quotes don't count. One fold over the parts between closing parentheses, with a state of three numbers."""
    depth = lambda part: F.length(part) - F.length(F.replace(part, F.lit("("), F.lit("")))

    def step(s: Column, part: Column) -> Column:
        inner = s["open"] + depth(part) - 1
        at = s["at"] + F.length(part) + 1
        closes = (s["end"] < 0) & (inner == 0)
        return F.struct(F.when(s["end"] >= 0, s["open"]).otherwise(inner).alias("open"), at.alias("at"), F.when(closes, at - 1).otherwise(s["end"]).alias("end"))

    # the last part has no closing parenthesis after it
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("at"), F.lit(-1).alias("end"))
    end = lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["end"]
    before = lambda t, e: F.when(e >= 0, F.substring(t, F.lit(1), e))
    return bound(text, lambda t: bound(F.split(without_quoted_parentheses(t), r"\)", -1), lambda parts: bound(end(parts), lambda e: before(t, e))))


#: Parentheses within arguments, quotes aside, to the depth that one scan follows.
DEPTH = 24
_INNER = rf"(?:[^()'\"]++|{QUOTED})*+"
for _ in range(DEPTH):
    _INNER = rf"(?:[^()'\"]++|{QUOTED}|\({_INNER}\))*+"


def directives(text: Column) -> Column:
    """Directives with their arguments, as they stand between balanced parentheses: array of (name, arguments). One whose
    parentheses don't close is left out; those within the arguments of another are found, too.

    One scan finds the heads and looks ahead over the arguments of each; only where these nest beyond DEPTH, or don't close, are they
    looked for once more, by a fold over the rest of the text."""
    head = r"(?<!@)@(\w+)\s*\("
    seen = rf"(?s){head}(?:(?=({_INNER})\))|)"

    def each(m: Column) -> Column:
        after = lambda i: F.array_join(F.flatten(F.transform(F.sequence(i + 1, F.size(m["pieces"]) - 1), lambda k: F.array(F.get(m["pieces"], k), F.coalesce(F.get(m["heads"], k), F.lit(""))))), "")
        closed = lambda i: F.substring(F.get(m["pieces"], i + 1), F.length(F.get(m["found"], i)) + 1, F.lit(1)) == ")"
        # arguments without any parenthesis or directive of their own are plain to see; an empty capture may also stand for none
        arguments = lambda i: F.when((F.get(m["found"], i) != "") | closed(i), F.get(m["found"], i)).otherwise(balanced(after(i)))
        return F.transform(m["names"], lambda name, i: F.struct(name.alias("name"), arguments(i).alias("arguments")))

    parts = F.struct(all_of(text, seen, 1).alias("names"), all_of(text, seen, 2).alias("found"), all_of(text, head, 0).alias("heads"), F.split(text, head, -1).alias("pieces"))
    return F.filter(bound(parts, each), lambda d: d["arguments"].isNotNull())


def routes(files: DataFrame) -> DataFrame:
    """files(path, text) -> (path, verb, uri, name, action): routes declared by verb."""
    code = without_comments(F.col("text"))
    pattern = r"Route::(get|post|put|patch|delete|any)\(\s*['\"]([^'\"]*)['\"]\s*,\s*(.*?)\)\s*((?:->\w+\([^)]*\)\s*)*);"
    parts = F.arrays_zip(*(all_of(code, "(?s)" + pattern, g).alias(n) for g, n in ((1, "verb"), (2, "uri"), (3, "action"), (4, "chain"))))
    rows = files.select("path", F.explode(parts).alias("r"))
    name = F.regexp_extract("r.chain", r"->name\(\s*['\"]([^'\"]+)['\"]", 1)
    action = F.regexp_replace(F.regexp_replace("r.action", r"[\[\]'\"\s]", ""), "::class,", "::")
    return rows.select("path", F.upper("r.verb").alias("verb"), F.col("r.uri").alias("uri"), F.when(name != "", name).alias("name"), action.alias("action"))


def resource_routes(resources: DataFrame, name: str, api: bool = False) -> DataFrame:
    """Each resource name becomes its routes: (name, action, verb, uri, route)."""
    actions = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(v).alias("verb"), F.lit(p).alias("tail")) for a, v, p in RESOURCE if not (api and a in FORMS)))
    base = plural(F.col(name))
    parameter = F.concat(F.lit("{"), singular(base), F.lit("}"))
    rows = resources.select(F.col(name), F.explode(actions).alias("a"))
    return rows.select(name, "a.action", "a.verb", F.concat(base, F.replace(F.col("a.tail"), F.lit("{id}"), parameter)).alias("uri"), F.concat(base, F.lit("."), F.col("a.action")).alias("route"))


#: The calls that define a column, with its name as their argument.
COLUMN_TYPES = (
    "id", "increments", "tinyIncrements", "smallIncrements", "mediumIncrements", "bigIncrements", "char", "string", "tinyText", "text", "mediumText", "longText", "integer", "tinyInteger", "smallInteger",
    "mediumInteger", "bigInteger", "unsignedInteger", "unsignedTinyInteger", "unsignedSmallInteger", "unsignedMediumInteger", "unsignedBigInteger", "float", "double", "decimal", "unsignedDecimal", "boolean",
    "enum", "set", "json", "jsonb", "date", "dateTime", "dateTimeTz", "time", "timeTz", "timestamp", "timestampTz", "year", "binary", "uuid", "ulid", "ipAddress", "macAddress", "foreignId", "foreignUuid",
    "foreignUlid", "geometry", "geography", "softDeletes", "softDeletesTz", "softDeletesDatetime", "rememberToken",
)
#: The columns that calls without a name stand for, with their types.
IMPLIED = {
    **{t: ((t, t),) for t in ("id", "uuid", "ulid")},
    **{t: (("deleted_at", t),) for t in ("softDeletes", "softDeletesTz", "softDeletesDatetime")},
    "rememberToken": (("remember_token", "rememberToken"),),
    "timestamps": (("created_at", "timestamp"), ("updated_at", "timestamp")),
    "timestampsTz": (("created_at", "timestampTz"), ("updated_at", "timestampTz")),
}


def migrations(files: DataFrame) -> DataFrame:
    """files(path, text) -> (path, i, operation, table, columns): tables that the forward part of a migration defines, statement by
    statement. That part is its method ``up``, and what stands before the first method."""
    code = without_comments(F.col("text"))
    forward = lambda m: F.array_join(F.concat(F.slice(m["pieces"], 1, 1), F.array_compact(F.transform(m["names"], lambda n, i: F.when(F.lower(n) == "up", F.get(m["pieces"], i + 1))))), "\n")
    rows = files.select("path", bound(F.struct(F.split(code, METHOD, -1).alias("pieces"), all_of(code, METHOD, 2).alias("names")), forward).alias("code"))
    pattern = r"(?<![\w\\])\\?(?:Illuminate\\Support\\Facades\\)?Schema::(create|table|drop|dropIfExists)\(\s*['\"](\w+)['\"]"
    rows = rows.select("path", F.split("code", pattern).alias("bodies"), F.posexplode(F.arrays_zip(all_of(F.col("code"), pattern, 1).alias("operation"), all_of(F.col("code"), pattern, 2).alias("table"))).alias("i", "s"))
    body = F.get("bodies", F.col("i") + 1)
    column = rf"\$\w+->({"|".join(COLUMN_TYPES)})\(\s*['\"](\w+)['\"]"
    own = F.arrays_zip(all_of(body, column, 2).alias("name"), all_of(body, column, 1).alias("type"))
    none = F.array().cast("array<struct<name:string,type:string>>")
    given = [F.when(body.rlike(rf"->{call}\(\s*\)"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in made))).otherwise(none) for call, made in IMPLIED.items()]
    return rows.select("path", "i", F.col("s.operation").alias("operation"), F.col("s.table").alias("table"), F.concat(own, *given).alias("columns"))


def contributions(files: DataFrame) -> DataFrame:
    """What each migration says of each table, in the columns of SHARED: its columns by name, of several statements the last one of a name,
    and the last operation."""
    rows = migrations(files).withColumn("node_key", normalized_key(F.concat(F.lit("table:"), "table")))
    # bounded by the statements of one file
    said = rows.groupBy("node_key", F.col("path").alias("file_path")).agg(F.max_by("operation", "i").alias("operation"), F.array_sort(F.collect_list(F.struct("i", "columns"))).alias("all"))
    every = F.flatten(F.transform("all", lambda s: s["columns"]))
    last = lambda cs: F.filter(cs, lambda c, i: ~F.exists(F.slice(cs, i + 2, F.size(cs)), lambda d: d["name"] == c["name"]))
    return said.select("node_key", "file_path", "operation", bound(every, last).alias("columns"))


def shared_nodes(said: DataFrame) -> DataFrame:
    """contributions of all files -> one node for each table, in the columns of NODE, with a hash of its columns and sources."""
    members = F.flatten(F.collect_list(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], F.col("file_path")))))
    rows = said.groupBy("node_key").agg(F.array_sort(F.collect_set("file_path")).alias("sources"), F.array_sort(members).alias("members"))
    name, none = F.substring("node_key", 7, 1 << 20), F.lit(None).cast("string")
    seal = F.sha2(F.concat_ws("|", F.array_join("members", ","), F.array_join("sources", ",")), 256)
    return rows.select("node_key", F.lit("table").alias("node_type"), name.alias("symbol_name"), none.alias("file_path"), seal.alias("content_hash"), F.concat(F.lit("table "), name).alias("signature"), none.alias("visibility"), F.lit(None).cast("boolean").alias("adapts"))


def migration_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of migrations, in the columns of graph_of: each one, and the tables that it defines."""
    key = lambda path: normalized_key(F.concat(F.lit("migration:"), path))
    none = F.lit(None).cast("string")
    nodes = files.select(key("path").alias("node_key"), F.lit("migration").alias("node_type"), F.col("path").alias("symbol_name"), F.col("path").alias("file_path"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("migration "), "path").alias("signature"), none.alias("visibility"), F.lit(None).cast("boolean").alias("adapts"))
    edges = contributions(files).select(key("file_path").alias("source_key"), F.col("node_key").alias("target_key"), F.lit("defines_table").alias("relationship"), F.lit(0.9).cast("decimal(3,2)").alias("confidence"), "file_path")
    return nodes, edges
