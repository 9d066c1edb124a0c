"""What classes say about each other by convention: observers, listeners, policies, container bindings, relations of models; and what
a model or an accessor class states of itself. Read from statements as they stand, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import normalized_key
from codeweft.operators.extract import all_of, balanced, full_name, held, read_once

NAME = r"(\\?[A-Za-z_][\w\\]*)"
CLASS = rf"{NAME}::class"
CONTAINER = r"(?:\$this->app|\bapp\(\s*\))\s*->\s*"
BIND = rf"{CONTAINER}(bind|singleton|scoped|bindIf)\("
CONTEXT = rf"{CONTAINER}when\(\s*{CLASS}\s*\)\s*->\s*needs\(\s*{CLASS}\s*\)\s*->\s*give\("
#: Parents that make a class a model, and the calls that relate it to another.
MODELS = ("Illuminate\\Database\\Eloquent\\Model", "Illuminate\\Foundation\\Auth\\User", "Illuminate\\Database\\Eloquent\\Relations\\Pivot")
RELATIONS = ("hasOne", "hasMany", "belongsTo", "belongsToMany", "morphTo", "morphOne", "morphMany", "morphToMany", "morphedByMany", "hasManyThrough", "hasOneThrough")
RELATION = rf"\$this->({'|'.join(RELATIONS)})\("
ANY_RELATED = "Illuminate\\Database\\Eloquent\\Relations\\Relation"


def _full(name: Column) -> Column:
    return full_name(name, F.col("namespace"), F.col("imports"))


def _edge(source: Column, target: Column, relationship: str, sure: Column | float) -> Column:
    sure = sure if isinstance(sure, Column) else F.lit(sure)
    return F.struct(source.alias("source_key"), target.alias("target_key"), F.lit(relationship).alias("relationship"), sure.cast("decimal(3,2)").alias("confidence"))


def _pairs(text: Column, pattern: str, first: int = 1, second: int = 2) -> Column:
    return F.arrays_zip(all_of(text, pattern, first).alias("a"), all_of(text, pattern, second).alias("b"))


def is_model() -> Column:
    return F.exists("parents", lambda p: p.isin(*MODELS))


def concrete(value: Column) -> Column:
    """What a binding gives: (name, sure, via) of a class constant, a class in quotes, or the one class that a closure makes; else null."""
    plain = lambda s: F.regexp_replace(F.replace(s, F.lit("\\\\"), F.lit("\\")), r"^\\+", "")
    made = F.array_distinct(F.transform(all_of(value, rf"\bnew\s+{NAME}"), _full))
    given = lambda name, sure, via: F.struct(name.alias("name"), F.lit(sure).cast("decimal(3,2)").alias("sure"), F.lit(via).alias("via"))
    constant, quoted = rf"^\s*{CLASS}\s*(,|$)", r"^\s*['\"]([^'\"]*\\[^'\"]*)['\"]"
    return (
        F.when(value.rlike(constant), given(_full(F.regexp_extract(value, constant, 1)), 0.95, "class_const"))
        .when(value.rlike(quoted), given(plain(F.regexp_extract(value, quoted, 1)), 0.8, "class_string"))
        .when(value.rlike(r"^\s*(?:static\s+)?(?:function|fn)\b") & (F.size(made) == 1), given(F.get(made, F.lit(0)), 0.85, "closure_new"))
    )


def _calls(text: Column, head: str) -> Column:
    """The arguments of each call that the head opens, parentheses within them at any depth; null where they don't close."""
    return F.transform(F.slice(F.split(text, head, -1), F.lit(2), F.size(all_of(text, head, 0))), balanced)


def bindings(methods: DataFrame) -> DataFrame:
    """Container bindings in methods: (path, source_key, abstract, abstract_kind, concrete, lifetime, via, confidence). A class that is bound
    alone is bound to itself, unless the binding is conditional."""
    inner = held(F.col("inner"), "bind", "singleton(", "scoped(")
    calls = F.arrays_zip(all_of(inner, BIND).alias("lifetime"), _calls(inner, BIND).alias("arguments"))
    rows = methods.select("path", "fqcn", "method", "namespace", "imports", F.explode(calls).alias("c")).select("*", "c.lifetime", "c.arguments").where("arguments is not null")
    head = rf"^\s*(?:{CLASS}|['\"]([^'\"]+)['\"])\s*(?:,|$)"
    text = F.replace(F.regexp_extract("arguments", head, 2), F.lit("\\\\"), F.lit("\\"))
    constant = F.regexp_extract("arguments", head, 1)
    rows = rows.where(F.col("arguments").rlike(head)).withColumns({
        "abstract": F.when(constant != "", _full(constant)).otherwise(F.regexp_replace(text, r"^\\+", "")),
        "abstract_kind": F.when((constant != "") | text.contains("\\"), "class").otherwise("container_key"),
        "rest": F.trim(F.regexp_replace("arguments", head, "")),
    })
    itself = (F.col("rest") == "") & (F.col("abstract_kind") == "class") & (F.col("lifetime") != "bindIf")
    own = F.struct(F.col("abstract").alias("name"), F.lit(0.9).cast("decimal(3,2)").alias("sure"), F.lit("self_binding").alias("via"))
    rows = rows.withColumn("c", F.coalesce(concrete(F.col("rest")), F.when(itself, own))).where("c is not null")
    source = normalized_key(F.concat(F.lit("method:"), "fqcn", F.lit("::"), "method"))
    return rows.select("path", source.alias("source_key"), "abstract", "abstract_kind", F.col("c.name").alias("concrete"), "lifetime", F.col("c.via").alias("via"), F.col("c.sure").alias("confidence"))


def semantic_edges(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """files(path, text) -> edges in the columns of ``extract.graph_of``: observes, listens_to_event, depends_on of policies, binds,
    contextual_binding, uses_model of relations and uses_table of pivots. ``read`` as in ``extract.graph_of``."""
    found, methods = read or read_once(files)
    body = F.col("body")
    facade = lambda name: rf"(?<![\w\\])\\?(?:[\w\\]*\\)?{name}"
    named = lambda name: F.concat(F.lit("class:"), name)  # noqa: E731  keys are brought to length at the end
    turned = lambda pairs, rel: F.transform(pairs, lambda p: _edge(named(_full(p["b"])), named(_full(p["a"])), rel, 0.9))
    policies = F.regexp_extract(held(body, "$policies"), r"(?s)\$policies\s*=\s*\[(.*?)\]\s*;", 1)
    listened = _pairs(F.regexp_extract(held(body, "$listen"), r"(?s)\$listen\s*=\s*\[(.*?)\]\s*;", 1), rf"{CLASS}\s*=>\s*\[([^\]]*)\]")
    observers = F.flatten(F.transform(all_of(held(F.col("attributes"), "ObservedBy"), r"(?s)ObservedBy\(([^()]*)\)"), lambda a: all_of(a, CLASS)))
    of_classes = F.concat(
        turned(_pairs(held(body, "::observe("), rf"{NAME}::observe\(\s*{CLASS}"), "observes"),
        turned(_pairs(held(body, "Event::listen("), rf"{facade('Event')}::listen\(\s*{CLASS}\s*,\s*{CLASS}\s*[,)]"), "listens_to_event"),
        turned(_pairs(held(body, "Gate::policy("), rf"{facade('Gate')}::policy\(\s*{CLASS}\s*,\s*{CLASS}"), "depends_on"),
        turned(_pairs(policies, rf"{CLASS}\s*=>\s*{CLASS}"), "depends_on"),
        F.flatten(F.transform(listened, lambda p: F.transform(all_of(p["b"], CLASS), lambda x: _edge(named(_full(x)), named(_full(p["a"])), "listens_to_event", 0.9)))),
        F.transform(observers, lambda o: _edge(named(_full(o)), F.col("class_key"), "observes", 0.9)),
    )
    key = F.concat(F.lit("method:"), "fqcn", F.lit("::"), "method")
    inner = F.col("inner")
    given_to = held(inner, "needs(")
    contexts = F.arrays_zip(all_of(given_to, CONTEXT, 1).alias("a"), _calls(given_to, CONTEXT).alias("b"))
    given = F.filter(F.transform(contexts, lambda c: concrete(c["b"])), lambda g: g.isNotNull())
    related = F.when(is_model(), F.transform(all_of(inner, rf"{RELATION}\s*{CLASS}", 2), lambda c: _edge(key, named(_full(c)), "uses_model", 0.85)))
    pivots = F.when(is_model(), F.transform(all_of(inner, r"\$this->belongsToMany\(\s*[^,()]+,\s*['\"]([A-Za-z_]\w*)['\"]"), lambda t: _edge(key, F.concat(F.lit("table:"), t), "uses_table", 0.9)))
    none = F.array().cast("array<struct<source_key:string,target_key:string,relationship:string,confidence:decimal(3,2)>>")
    of_methods = F.concat(F.transform(given, lambda g: _edge(key, named(g["name"]), "contextual_binding", F.least(g["sure"], F.lit(0.85).cast("decimal(3,2)")))), F.coalesce(related, none), F.coalesce(pivots, none))
    bound = bindings(methods)
    to_bound = lambda source: _edge(source, named(F.col("concrete")), "binds", F.col("confidence"))
    through = F.when((F.col("abstract_kind") == "class") & (F.col("abstract") != F.col("concrete")), to_bound(named(F.col("abstract"))))
    parts = [found.select("path", F.explode(of_classes).alias("e")), methods.select("path", F.explode(of_methods).alias("e")), bound.select("path", F.explode(F.array_compact(F.array(to_bound(F.col("source_key")), through))).alias("e"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(normalized_key(F.col("e.source_key")).alias("source_key"), normalized_key(F.col("e.target_key")).alias("target_key"), "e.relationship", "e.confidence", F.col("path").alias("file_path"))


def class_facts(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """files(path, text) -> (class_key, path, casts, accessors, scopes, relations, facade_accessor, accessor_kind, middleware_aliases) of each class:
    casts, accessors, scopes and relations of models alone, the accessor of classes whose parent is a facade, aliases that a class gives to ``$this->middleware``.

    A later cast or relation of a name takes the place of an earlier one. What a class doesn't state is empty, or null for the accessor.
    """
    found, spans = read or read_once(files)
    entry = rf"['\"]([^'\"]+)['\"]\s*=>\s*(?:['\"]([^'\"]+)['\"]|{CLASS})"
    returned = r"(?s)function\s+casts\s*\([^)]*\)[^{]*\{\s*return\s*\[(.*?)\]\s*;"
    maps = F.concat_ws(",", F.regexp_extract(held(F.col("body"), "$casts"), r"(?s)\$casts\s*=\s*\[(.*?)\]\s*;", 1), F.regexp_extract(held(F.col("body"), "casts"), returned, 1))
    zipped = F.arrays_zip(all_of(maps, entry, 1).alias("k"), all_of(maps, entry, 2).alias("s"), all_of(maps, entry, 3).alias("c"))
    casts = F.transform(zipped, lambda z: F.struct(z["k"].alias("key"), F.when(z["s"] != "", z["s"]).otherwise(_full(z["c"])).alias("value")))
    methods = spans.withColumn("at", F.struct("m", "method"))
    by_name = F.regexp_extract("method", r"^(?:get|set)(.+)Attribute$", 1)
    typed = _full(F.trim("returns")).endswith("\\Attribute")
    scope = F.regexp_extract("method", r"^scope([A-Z].*)$", 1)
    related = rf"{RELATION}\s*(?:{CLASS})?"
    target = F.regexp_extract("inner", related, 2)
    facts = methods.select(
        "path", "class_key", "m",
        F.when(by_name != "", by_name).when(typed & (F.col("returns") != ""), F.col("method")).alias("accessor"),
        F.when(scope != "", F.concat(F.lower(F.substring(scope, 1, 1)), F.substring(scope, 2, 1 << 20))).alias("scope"),
        F.when(F.col("inner").rlike(RELATION), F.struct(F.col("method").alias("key"), F.when(target != "", _full(target)).otherwise(ANY_RELATED).alias("value"))).alias("relation"),
        F.when(F.lower("method") == "getfacadeaccessor", F.regexp_extract("inner", rf"return\s+(?:{CLASS}|['\"]([^'\"]+)['\"])\s*;", 0)).alias("returned"),
    )
    # a class has as many methods as its file declares: the lists are bounded by one file
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("m", F.col(c).alias("v"))))), lambda x: x["v"])
    lists = facts.groupBy("path", "class_key").agg(F.array_distinct(ordered("accessor")).alias("_accessors"), ordered("scope").alias("_scopes"), ordered("relation").alias("_relations"), F.max("returned").alias("_returned"))
    last = lambda pairs: F.map_from_entries(F.filter(pairs, lambda c, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda d: d["key"] == c["key"])))
    rows = found.join(lists, ["path", "class_key"], "left")
    only = lambda c, model_only: F.when(model_only, F.col(c))
    strings = F.array().cast("array<string>")
    pairs = F.array().cast("array<struct<key:string,value:string>>")
    accessor = rf"return\s+(?:{CLASS}|['\"]([^'\"]+)['\"])\s*;"
    constant, text = F.regexp_extract("_returned", accessor, 1), F.replace(F.regexp_extract("_returned", accessor, 2), F.lit("\\\\"), F.lit("\\"))
    fronts = F.exists("parents", lambda p: p.endswith("\\Facade"))
    named = F.when(fronts & F.col("_returned").isNotNull(), F.when(constant != "", _full(constant)).otherwise(F.when(text != "", text)))
    kind = F.when(named.isNotNull(), F.when((constant != "") | text.contains("\\"), "class").otherwise("container_key"))
    return rows.select(
        "class_key", "path",
        last(F.coalesce(F.when(is_model(), casts), pairs)).alias("casts"),
        F.coalesce(only("_accessors", is_model()), strings).alias("accessors"),
        F.coalesce(only("_scopes", is_model()), strings).alias("scopes"),
        last(F.coalesce(only("_relations", is_model()), pairs)).alias("relations"),
        named.alias("facade_accessor"), kind.alias("accessor_kind"),
        F.array_distinct(all_of(held(F.col("body"), "$this->middleware("), r"\$this->middleware\(\s*['\"]([^'\"]+)['\"]")).alias("middleware_aliases"),
    )


def facade_calls(edges: DataFrame, accessors: DataFrame, bound: DataFrame, classes: DataFrame) -> DataFrame:
    """edges(target_key, resolution, ...) with what their static calls through a facade are known to reach.

    accessors(class_key, facade_accessor, accessor_kind), bound(abstract, concrete), classes(class_key) of those declared. Adds resolution_state,
    facade_accessor, accessor_kind and bound_concrete, the one class that is bound, if it is one. Several make the call ambiguous;
    an accessor that is a class nobody declares makes it external, unless one class is bound to it. Calls that have been
    resolved to a declared or inherited method, and all other edges, stay as they are, with nulls.
    """
    owner = F.lower(F.concat(F.lit("class:"), F.regexp_extract("target_key", r"^method:(.*)::[^:]*$", 1)))
    by = bound.groupBy(F.col("abstract").alias("facade_accessor")).agg(F.count_distinct("concrete").alias("_n"), F.min("concrete").alias("_one"))
    there = classes.select(F.lower("class_key").alias("_named"), F.lit(True).alias("_there")).distinct()
    fronts = accessors.where("facade_accessor != ''").groupBy(F.lower("class_key").alias("_owner")).agg(F.min(F.struct("facade_accessor", "accessor_kind")).alias("a")).select("_owner", "a.*")
    known = fronts.join(by, "facade_accessor", "left").withColumn("_named", F.lower(normalized_key(F.concat(F.lit("class:"), "facade_accessor")))).join(there, "_named", "left")
    one = F.coalesce(F.col("_n"), F.lit(0)) == 1
    missing = (F.col("accessor_kind") == "class") & F.col("_there").isNull()
    state = F.when(missing, F.when(one, "partially_resolved").otherwise("external")).when(F.col("_n") > 1, "ambiguous").otherwise("partially_resolved")
    known = known.select("_owner", state.alias("resolution_state"), "facade_accessor", "accessor_kind", F.when(one, F.col("_one")).alias("bound_concrete"))
    settled = F.coalesce(F.col("resolution").isin("declared_method", "inherited_method"), F.lit(False))
    rows = edges.withColumn("_call", F.when(~settled & F.col("target_key").startswith("method:"), owner)).join(known, F.col("_call") == F.col("_owner"), "left")
    return rows.withColumn("resolution", F.when(F.col("_owner").isNotNull(), F.coalesce("resolution", F.lit("facade_accessor"))).otherwise(F.col("resolution"))).drop("_call", "_owner")


def class_marks(files: DataFrame, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """files(path, text) -> (class_key, file_path, facade_accessor, accessor_kind, model, form_request): what calls and types are annotated by."""
    read = read or read_once(files)
    form = read[0].select("class_key", "path", is_model().alias("model"), F.exists("parents", lambda p: p.endswith("FormRequest")).alias("form_request"))
    facts = class_facts(files, read).select("class_key", "path", "facade_accessor", "accessor_kind")
    return form.join(facts, ["class_key", "path"], "left").select("class_key", F.col("path").alias("file_path"), "facade_accessor", "accessor_kind", "model", "form_request")


def builder_forwards(edges: DataFrame, models: DataFrame, calls: tuple[str, ...]) -> DataFrame:
    """edges(target_key, resolution, resolution_state, ...) of which calls that a model, models(class_key), hands on to its query, by the names ``calls``, are
    marked: resolution eloquent_builder_forward, state partially_resolved, and the model in forward_receiver. What is resolved already stays."""
    owner = F.regexp_extract("target_key", r"^method:(.*)::[^:]*$", 1)
    known = models.select(F.lower("class_key").alias("_model")).distinct().withColumn("_is", F.lit(True))
    rows = edges.withColumn("_owner", F.when(F.col("target_key").startswith("method:"), owner))
    rows = rows.join(known, F.lower(F.concat(F.lit("class:"), "_owner")) == F.col("_model"), "left")
    forwards = F.coalesce(F.col("_is"), F.lit(False)) & F.col("resolution").isNull() & F.regexp_extract("target_key", r"::([^:]*)$", 1).isin(*calls)
    set_to = lambda name, value: F.when(forwards, value).otherwise(F.col(name)).alias(name)
    kept = [F.col(c) for c in edges.columns if c not in ("resolution", "resolution_state")]
    return rows.select(*kept, set_to("resolution", F.lit("eloquent_builder_forward")), set_to("resolution_state", F.lit("partially_resolved")), F.when(forwards, F.col("_owner")).alias("forward_receiver"))


def form_requests(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """edges(relationship, target_key, via, resolution, resolution_state, ...) of which parameters of a class in requests(class_key) are marked as form requests."""
    known = requests.select(F.lower("class_key").alias("_request")).distinct().withColumn("_is", F.lit(True))
    rows = edges.join(known, F.lower("target_key") == F.col("_request"), "left")
    asked = F.coalesce(F.col("_is"), F.lit(False)) & (F.col("relationship") == "depends_on") & F.coalesce(F.col("via").isin("parameter", "form_request"), F.lit(False))
    given = {"via": "form_request", "resolution": "form_request", "resolution_state": "resolved"}
    return rows.select(*(F.when(asked, F.lit(given[c])).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in edges.columns))
