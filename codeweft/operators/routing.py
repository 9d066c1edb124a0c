"""Routes as files declare them, in groups of any depth: their paths, names, actions and middleware, by column expressions.

A file is one row of bounded size (admission limits it); its statements become rows of their own before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import normalized_key, singular
from codeweft.operators.extract import FORMS, RESOURCE, all_of, balanced, bound, full_name, imports_of, without_comments, without_quoted_parentheses
from codeweft.operators.lineage import cut

#: The calls that declare a route.
VERBS = ("get", "post", "put", "patch", "delete", "options", "any", "match", "view", "resource", "apiResource", "redirect", "permanentRedirect")
ANY = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")
START = r"(?<![\w\\])\\?(?:Illuminate\\Support\\Facades\\)?Route::"
#: What may stand between the parentheses of a call.
NESTED = r"(?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+"
HEAD = rf"(?s)^((?:\w+\({NESTED}\)\s*->\s*)*?)({'|'.join(VERBS)}|group)\("
QUOTED = r"['\"]([^'\"]*)['\"]"
CLASS = r"(\\?[A-Za-z_][\w\\]*)::class"
MANY = 1 << 20
COLUMNS = ("path", "route_key", "name", "verb", "methods", "uri", "action", "target", "confidence", "view", "middleware_classes", "middleware_aliases", "content_hash")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """What the group has matched; null where nothing did."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _argument(chain: Column, call: str) -> Column:
    """The first argument of the last call of that name in a chain; null without one."""
    whole = F.try_element_at(all_of(chain, rf"(?s)(?:^|->\s*){call}\(({NESTED})\)"), F.lit(-1))
    return _first(whole, r"(?s)^\s*(\[[^\]]*\]|[^,\[]+)")


def _joined(chain: Column, call: str) -> Column:
    return F.array_join(all_of(chain, rf"(?:^|->\s*){call}\(\s*{QUOTED}"), "")


def _option(options: Column, name: str) -> Column:
    return _first(options, rf"(?s)['\"]{name}['\"]\s*=>\s*(\[[^\]]*\]|[^,\]\[]+)")


def _strings(value: Column) -> Column:
    return all_of(F.coalesce(value, F.lit("")), QUOTED)


def _named(pairs: Column, key: Column) -> Column:
    """The string that a literal map gives for a key."""
    pair = rf"{QUOTED}\s*=>\s*{QUOTED}"
    pairs = F.coalesce(pairs, F.lit(""))
    return F.get(all_of(pairs, pair, 2), (F.array_position(all_of(pairs, pair, 1), key) - 1).cast("int"))


def _full(name: Column) -> Column:
    return full_name(name, F.col("namespace"), F.col("imports"))


def _middleware_classes(value: Column) -> Column:
    strings = F.filter(_strings(value), lambda s: s.contains("\\"))
    return F.array_distinct(F.concat(F.transform(all_of(F.coalesce(value, F.lit("")), CLASS), _full), F.transform(strings, lambda s: F.regexp_replace(s, r"^\\+", ""))))


def _middleware_aliases(value: Column) -> Column:
    return F.array_distinct(F.filter(_strings(value), lambda s: ~s.contains("\\")))


def _group(piece: Column, i: Column) -> Column:
    """What a group gives to the routes in it, and the statements, first to last, that it holds."""
    head = F.struct(F.regexp_extract(piece, HEAD, 1).alias("chain"), F.substring(piece, F.length(F.regexp_extract(piece, HEAD, 0)) + 1, F.lit(MANY)).alias("rest"))

    def said(h: Column) -> Column:
        given = F.regexp_extract(h["rest"], r"(?s)^\s*\[(.*?)\]\s*,\s*(?:static\s+)?(?:function|fn)\b", 1)
        after = F.array_join(F.concat(F.array(h["rest"]), F.slice("pieces", i + 2, F.greatest(F.size("pieces") - i - 1, F.lit(0)))), "Route::")
        inner = bound(after, lambda a: F.coalesce(balanced(a), a))
        return bound(F.struct(h["chain"].alias("chain"), given.alias("given"), F.size(F.split(inner, "Route::", -1)).alias("holds")), options)

    def options(g: Column) -> Column:
        chain, given = g["chain"], g["given"]
        own = F.coalesce(_first(_argument(chain, "controller"), CLASS), _first(_option(given, "controller"), CLASS))
        both = F.struct(_option(given, "middleware").alias("by_option"), _argument(chain, "middleware").alias("by_call"))
        return bound(both, lambda m: F.struct(
            F.btrim(F.concat(_joined(chain, "prefix"), F.lit("/"), F.coalesce(F.get(_strings(_option(given, "prefix")), F.lit(0)), F.lit(""))), F.lit("/")).alias("prefix"),
            F.concat(_joined(chain, "name"), F.coalesce(F.get(_strings(_option(given, "as")), F.lit(0)), F.lit(""))).alias("name"),
            bound(own, lambda c: F.when(c.isNotNull(), _full(c))).alias("controller"),
            F.array_union(_middleware_classes(m["by_option"]), _middleware_classes(m["by_call"])).alias("classes"),
            F.array_union(_middleware_aliases(m["by_option"]), _middleware_aliases(m["by_call"])).alias("aliases"),
            (i + 1).alias("first"),
            (i + g["holds"] - 1).alias("last"),
        ))

    return bound(head, said)


def statements(files: DataFrame) -> DataFrame:
    """files(path, text) -> one row a route statement: its call, arguments and chain, and the groups that it stands in, outermost first."""
    masked = without_quoted_parentheses(without_comments(F.col("text")))
    rows = files.select("path", F.regexp_extract("text", r"(?m)^\s*namespace\s+([\w\\]+)\s*;", 1).alias("namespace"), imports_of(F.col("text")).alias("imports"), F.split(masked, START, -1).alias("pieces")).where(F.size("pieces") > 1)
    is_group = lambda p, i: (i > 0) & (F.regexp_extract(p, HEAD, 2) == "group")
    rows = rows.withColumn("groups", F.filter(F.transform("pieces", lambda p, i: F.when(is_group(p, i), _group(p, i))), lambda g: g.isNotNull()))
    rows = rows.select("path", "namespace", "imports", "groups", F.posexplode("pieces").alias("i", "piece")).where("i > 0")
    rows = rows.withColumn("call", F.regexp_extract("piece", HEAD, 2)).where("call not in ('', 'group')")
    rows = rows.withColumn("rest", F.substring("piece", F.length(F.regexp_extract("piece", HEAD, 0)) + 1, F.lit(MANY)))
    rows = rows.withColumn("arguments", balanced(F.col("rest"))).where("arguments is not null")
    after = F.regexp_extract(F.substring("rest", F.length("arguments") + 2, F.lit(MANY)), rf"(?s)^((?:\s*->\s*\w+\({NESTED}\))*)", 1)
    rows = rows.withColumn("chain", F.concat(F.regexp_extract("piece", HEAD, 1), after))
    return rows.withColumn("groups", F.filter("groups", lambda g: F.col("i").between(g["first"], g["last"])))


def _inherited(rows: DataFrame) -> DataFrame:
    """What a statement has from its groups and its own chain."""
    own = _argument(F.col("chain"), "middleware")
    prefixes = F.filter(F.transform("groups", lambda g: g["prefix"]), lambda p: p != "")
    of_groups = lambda field: F.flatten(F.transform("groups", lambda g: g[field]))
    return rows.withColumns({
        "prefix": F.array_join(prefixes, "/"),
        "name_prefix": F.array_join(F.transform("groups", lambda g: g["name"]), ""),
        "group_controller": F.try_element_at(F.filter(F.transform("groups", lambda g: g["controller"]), lambda c: c.isNotNull()), F.lit(-1)),
        "middleware_classes": F.array_union(_middleware_classes(own), of_groups("classes")),
        "middleware_aliases": F.array_union(_middleware_aliases(own), of_groups("aliases")),
    })


def _hash(rows: DataFrame) -> DataFrame:
    """The rows with the hash of what they rest on, and parentheses in their texts as the source has them."""
    shown = lambda c: F.translate(c, "\x01\x02", "()")
    rows = rows.withColumns({c: shown(F.col(c)) for c in ("route_key", "name", "uri", "action", "target", "view")} | {"middleware_aliases": F.transform("middleware_aliases", shown)})
    text = F.concat_ws("|", F.concat("call", F.lit("("), "arguments", F.lit(")"), "chain"), "route_key", "uri", F.coalesce("action", F.lit("")))
    return rows.withColumn("content_hash", F.sha2(text, 256)).select(*COLUMNS)


def _under(prefix: Column, uri: Column) -> Column:
    return F.btrim(F.concat(prefix, F.lit("/"), uri), F.lit("/"))


def _single(rows: DataFrame) -> DataFrame:
    """Routes of one verb, or of those that ``match`` lists. A path that isn't a literal gives none."""
    rows = rows.where("call not in ('resource', 'apiResource')")
    matched = F.col("call") == "match"
    listed = r"(?s)^\s*(\[[^\]]*\]|['\"][^'\"]*['\"])\s*,"
    rows = rows.withColumn("wanted", F.when(matched, F.transform(_strings(_first(F.col("arguments"), listed)), F.upper)))
    rows = rows.withColumn("given", F.when(matched, F.regexp_replace("arguments", listed, "")).otherwise(F.col("arguments"))).where(F.col("given").rlike(rf"^\s*{QUOTED}\s*(,|$)"))
    verb = F.upper("call")
    name = _joined(F.col("chain"), "name")
    rows = rows.withColumns({
        "uri": _under(F.col("prefix"), F.btrim(F.regexp_extract("given", rf"^\s*{QUOTED}", 1), F.lit("/"))),
        "name": F.when(name != "", F.concat("name_prefix", name)),
        "done": F.when(F.col("call").isin("view", "redirect", "permanentRedirect"), "").otherwise(F.trim(F.regexp_replace("given", rf"(?s)^\s*{QUOTED}\s*,?", ""))),
        "view": F.when(F.col("call") == "view", _first(F.col("given"), rf"^\s*{QUOTED}\s*,\s*{QUOTED}", 2)),
    })
    done = F.col("done")
    pair, alone, text = rf"^\[\s*{CLASS}\s*,\s*['\"](\w+)['\"]\s*,?\s*\]", rf"^{CLASS}\s*,?$", r"^['\"]([^'\"]+)['\"]\s*,?$"
    literal = F.regexp_extract(done, text, 1)
    target = lambda cls, method, sure: F.struct(cls.alias("cls"), method.alias("method"), F.lit(sure).cast("decimal(3,2)").alias("sure"))
    found = (
        F.when(done.rlike(pair), target(_full(F.regexp_extract(done, pair, 1)), F.regexp_extract(done, pair, 2), 0.9))
        .when(done.rlike(alone), target(_full(F.regexp_extract(done, alone, 1)), F.lit("__invoke"), 0.9))
        .when((literal != "") & ~literal.contains("@") & F.col("group_controller").isNotNull(), target(F.col("group_controller"), literal, 0.9))
        .when(literal.contains("@"), target(F.substring_index(literal, "@", 1), F.regexp_extract(literal, "@(.*)$", 1), 0.75))
    )
    rows = rows.withColumn("found", found)
    closure = done.rlike(r"^(?:static\s+)?(?:function|fn)\b")
    key = F.when(F.col("name").isNotNull(), F.col("name")).otherwise(F.concat(F.when(matched, F.array_join("wanted", "|")).otherwise(verb), F.lit(":"), F.col("uri")))
    methods = F.when(F.col("call").isin("get", "view"), F.array(F.lit("GET"), F.lit("HEAD"))).when(F.col("call").isin("any", "redirect", "permanentRedirect"), F.array(*map(F.lit, ANY))).when(matched, F.col("wanted")).otherwise(F.array(verb))
    return rows.withColumns({
        "route_key": normalized_key(F.concat(F.lit("route:"), key)),
        "verb": verb,
        "methods": methods,
        "action": F.when(F.col("found").isNotNull(), F.concat("found.cls", F.lit("@"), "found.method")).when(closure, "closure"),
        "target": F.concat("found.cls", F.lit("::"), "found.method"),
        "confidence": F.coalesce(F.col("found.sure"), F.when(closure, 0.55).otherwise(0.5).cast("decimal(3,2)")),
    })


def _resources(rows: DataFrame) -> DataFrame:
    """The routes that a resource stands for, as its options and chain leave them."""
    rows = rows.where("call in ('resource', 'apiResource')").where(F.col("arguments").rlike(r"^\s*['\"][^'\"]+['\"]"))
    named = rf"^\s*{QUOTED}\s*,\s*(?:{CLASS}|{QUOTED})"
    options = _first(F.col("arguments"), r"(?s)^[^\[]*(\[.*\])\s*,?\s*$")
    either = lambda name: F.coalesce(_argument(F.col("chain"), name), _option(options, name))
    whole = F.btrim(F.regexp_extract("arguments", rf"^\s*{QUOTED}", 1), F.lit("/"))
    by_class, by_text = _first(F.col("arguments"), named, 2), _first(F.col("arguments"), named, 3)
    rows = rows.withColumns({
        "prefix": F.btrim(F.concat("prefix", F.lit("/"), F.regexp_extract(whole, "^(.*)/", 1)), F.lit("/")),
        "resource": F.element_at(F.split(whole, "/"), -1),
        "controller": F.coalesce(_full(by_class), by_text),
        "except": _strings(either("except")),
        "only": F.when(either("only").isNotNull(), _strings(either("only"))),
        "parameters": either("parameters"),
        "names": either("names"),
        "shallow": F.col("chain").rlike(r"(^|->\s*)shallow\(") | F.coalesce(F.lower(F.trim(_option(options, "shallow"))) == "true", F.lit(False)),
    })
    segments = F.split("resource", r"\.")
    parameter = lambda s: F.coalesce(_named(F.col("parameters"), s), F.replace(singular(s), F.lit("-"), F.lit("_")))
    rows = rows.withColumn("base", F.element_at(segments, -1))
    parents = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s: F.concat(s, F.lit("/{"), parameter(s), F.lit("}/")))
    rows = rows.withColumns({"nested": F.concat(F.array_join(parents, ""), F.col("base")), "wildcard": F.concat(F.lit("{"), parameter(F.col("base")), F.lit("}"))})
    actions = F.array(*(F.struct(F.lit(a).alias("of"), F.lit(v).alias("verb"), F.lit(p).alias("tail"), F.lit(a in FORMS).alias("form")) for a, v, p in RESOURCE))
    rows = rows.select("*", F.explode(actions).alias("a")).where("not (call = 'apiResource' and a.form)").where(~F.array_contains("except", F.col("a.of")) & F.coalesce(F.array_contains("only", F.col("a.of")), F.lit(True)))
    short = F.col("shallow") & F.col("a.tail").contains("{id}")
    own = F.concat(F.when(short, F.col("base")).otherwise(F.col("resource")), F.lit("."), F.col("a.of"))
    rows = rows.withColumn("name", F.concat("name_prefix", F.coalesce(_named(F.col("names"), F.col("a.of")), own)))
    return rows.withColumns({
        "uri": _under(F.col("prefix"), F.concat(F.when(short, F.col("base")).otherwise(F.col("nested")), F.replace(F.col("a.tail"), F.lit("{id}"), F.col("wildcard")))),
        "route_key": normalized_key(F.concat(F.lit("route:"), F.col("name"))),
        "verb": F.col("a.verb"),
        "methods": F.when(F.col("a.of") == "update", F.array(F.lit("PUT"), F.lit("PATCH"))).when(F.col("a.verb") == "GET", F.array(F.lit("GET"), F.lit("HEAD"))).otherwise(F.array("a.verb")),
        "action": F.concat("controller", F.lit("@"), "a.of"),
        "target": F.concat("controller", F.lit("::"), "a.of"),
        "confidence": F.lit(0.8).cast("decimal(3,2)"),
        "view": F.lit(None).cast("string"),
    })


def route_table(files: DataFrame) -> DataFrame:
    """files(path, text) -> one row a route, with COLUMNS: target is the method that answers, as class::method, as surely as confidence
    tells; middleware that is named by an alias stays apart from that named by its class. Null texts have none."""
    rows = cut(_inherited(statements(files)))  # both kinds of routes are read out of them
    return _hash(_single(rows)).unionByName(_hash(_resources(rows)))


def route_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of routes, in the columns of ``extract.graph_of``."""
    rows = route_table(files)
    symbol = F.coalesce("name", F.concat("verb", F.lit(" "), "uri"))
    shown = F.concat("verb", F.lit(" /"), "uri", F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit("")))
    nodes = rows.select(F.col("route_key").alias("node_key"), F.lit("route").alias("node_type"), symbol.alias("symbol_name"), F.col("path").alias("file_path"), "content_hash", shown.alias("signature"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("boolean").alias("adapts")).dropDuplicates(["node_key", "file_path"])
    to = lambda key, rel, sure: F.struct(normalized_key(key).alias("target_key"), F.lit(rel).alias("relationship"), sure.cast("decimal(3,2)").alias("confidence"))
    ends = F.concat(
        F.array_compact(F.array(F.when(F.col("target").isNotNull(), to(F.concat(F.lit("method:"), F.col("target")), "calls", F.col("confidence"))), F.when(F.col("view").isNotNull(), to(F.concat(F.lit("view:"), F.col("view")), "renders_view", F.lit(0.9))))),
        F.transform("middleware_classes", lambda c: to(F.concat(F.lit("class:"), c), "uses_middleware", F.lit(0.9))),
    )
    edges = rows.select(F.col("route_key").alias("source_key"), F.col("path").alias("file_path"), F.explode(ends).alias("e")).select("source_key", "e.*", "file_path")
    return nodes, edges
