"""Registered queries over source files: sources are composed out of the tables' rows, so that the work grows with them, and SQL says what must
come out of each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators import changes, extract, graph, knowledge, receivers, reports, routing, semantics
from codeweft.operators.lineage import checkpoint_dir, cut, spread
from codeweft.plans import sample_sources
from codeweft.plans.demo_graph import table
from codeweft.plans.source_graph import template_graph
from codeweft.plans.sync import annotated_edges, graph_edges, sync
from codeweft.queries import query
from codeweft.sources import files
from codeweft.store import SnapshotStore

ORDER_PHP = r"""<?php
namespace App\Models;

use Illuminate\Database\Eloquent\Model;
use App\Support\{Money as Cash, Tax};
use App\Contracts\Billable as Bills;

class Order extends Model implements Bills
{
    use Logs;
    protected $table = 'orders_v2';
    private ?Cash $total;

    public function __construct(private Tax $tax, array $n = array(1, 2)) { }

    private function owner(): User|null { return new User(); }

    public function close(self $other) { $this->note(); return $this->missing(); }
}
"""
LOGS_PHP = r"""<?php
namespace App\Models;

trait Logs
{
    public function note() { return Audit::write(1); }
}
"""
M = "App\\Models\\"
LITERAL = [("app/Models/Order.php", ORDER_PHP), ("app/Models/Logs.php", LOGS_PHP)]


def for_each(rows: DataFrame, key: str, files: list[tuple[str, str]]) -> DataFrame:
    """The files once for each row: in a namespace and a folder of its own, named by ``key``."""
    each = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in files))
    rows = spread(rows.select(F.col(key).cast("string").alias("k"))).select("k", F.explode(each).alias("f"))
    views = "resources/views/"
    folder = F.concat(F.lit("s"), "k", F.lit("/"))
    path = F.when(F.col("f.path").startswith(views), F.concat(F.lit(views), folder, F.substring("f.path", len(views) + 1, 1 << 20))).otherwise(F.concat(folder, "f.path"))
    return rows.select(path.alias("path"), F.replace(F.col("f.text"), F.lit("App\\"), F.concat(F.lit("App\\S"), "k", F.lit("\\"))).alias("text"))


def suppliers(spark: SparkSession, sf_dir: str, files: list[tuple[str, str]]) -> DataFrame:
    return for_each(table(spark, sf_dir, "supplier"), "s_suppkey", files)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def expected(rows: list[tuple], columns: str, keep: str = "", more: str = "") -> str:
    """SQL for ``rows`` as they come out for each supplier; ``keep`` names the columns that aren't text."""
    own = lambda c: f"""replace(replace(replace({c}, 'App\\', 'App\\S' || s_suppkey || '\\'), 'file:app/', 'file:s' || s_suppkey || '/app/'), 'view:pages.', 'view:s' || s_suppkey || '.pages.') as {c}"""
    shown = ", ".join(c if c in keep.split() else own(c) for c in columns.split())
    return f"select {shown}{more} from supplier cross join (values {_values(rows)}) x({columns.replace(' ', ', ')})"


ORDER, LOGS, IN_ORDER, IN_LOGS = f"class:{M}Order", f"class:{M}Logs", "file:app/Models/Order.php", "file:app/Models/Logs.php"
EXTRACTED = [
    *((IN_ORDER, t, "defines", 1.0) for t in (ORDER, *(f"method:{M}Order::{m}" for m in ("__construct", "owner", "close")))),
    *((ORDER, f"method:{M}Order::{m}", "contains", 1.0) for m in ("__construct", "owner", "close")),
    (IN_LOGS, LOGS, "defines", 1.0), (IN_LOGS, f"method:{M}Logs::note", "defines", 1.0), (LOGS, f"method:{M}Logs::note", "contains", 1.0),
    (ORDER, "class:Illuminate\\Database\\Eloquent\\Model", "extends", 0.95), (ORDER, "class:App\\Contracts\\Billable", "implements", 0.95), (ORDER, LOGS, "uses_trait", 0.95),
    (ORDER, "table:orders_v2", "uses_table", 0.9), (ORDER, "class:App\\Support\\Money", "depends_on", 0.95),
    (f"method:{M}Order::__construct", "class:App\\Support\\Tax", "depends_on", 0.95), (f"method:{M}Order::owner", f"class:{M}User", "depends_on", 0.95), (f"method:{M}Order::close", ORDER, "depends_on", 0.95),
    (f"method:{M}Order::close", f"method:{M}Order::note", "calls", 0.75), (f"method:{M}Order::close", f"method:{M}Order::missing", "calls", 0.75), (f"method:{M}Logs::note", f"method:{M}Audit::write", "calls", 0.85),
]


@query(expected(EXTRACTED, "source_key target_key relationship confidence", "confidence"))
def extracted_edges(spark, sf_dir):
    """Aliased and grouped imports, property, promoted, parameter and return types, traits, tables, calls."""
    _, e = extract.graph_of(suppliers(spark, sf_dir, LITERAL))
    return changes.combined_edges(e, ["file_path"]).select("source_key", "target_key", "relationship", F.col("confidence").cast("double").alias("confidence"))


SIGNATURES = [(f"method:{M}Order::__construct", "__construct(private Tax $tax, array $n = array(1, 2))", "public"), (f"method:{M}Order::owner", "owner(): User|null", "private"), (f"method:{M}Order::close", "close(self $other)", "public"), (f"method:{M}Logs::note", "note()", "public")]


@query(expected(SIGNATURES, "node_key signature visibility"))
def method_signatures(spark, sf_dir):
    n, _ = extract.graph_of(suppliers(spark, sf_dir, LITERAL))
    return n.where("node_type = 'method'").select("node_key", "signature", "visibility")


ORDERS, AUDIT, P, A = "App\\Http\\Controllers\\OrderController", "App\\Http\\Middleware\\Audit", "App\\Providers\\", "admin."
EVERY_VERB = "GET HEAD POST PUT PATCH DELETE OPTIONS"
ROUTES = [
    ("route:home", "home", "GET HEAD", "", "App\\Http\\Controllers\\HomeController::__invoke", 0.9, None, "", ""),
    (f"route:{A}orders.show", f"{A}orders.show", "GET HEAD", "admin/orders/{id}", f"{ORDERS}::show", 0.9, None, AUDIT, "can:view auth"),
    ("route:GET|POST:admin/deep/x", None, "GET POST", "admin/deep/x", "Legacy::go", 0.75, None, AUDIT, "auth throttle:(60)"),
    (f"route:{A}deep.y", f"{A}deep.y", "POST", "admin/deep/y", None, 0.55, None, AUDIT, "auth throttle:(60)"),
    ("route:DELETE:admin/z", None, "DELETE", "admin/z", f"{ORDERS}::remove", 0.9, None, AUDIT, "auth"),
    (f"route:{A}photos.comments.index", f"{A}photos.comments.index", "GET HEAD", "admin/photos/{photo}/comments", f"{ORDERS}::index", 0.8, None, AUDIT, "auth"),
    (f"route:{A}comments.show", f"{A}comments.show", "GET HEAD", "admin/comments/{comment}", f"{ORDERS}::show", 0.8, None, AUDIT, "auth"),
    ("route:all", "all", "GET HEAD", "people-lists", "App\\Plain::index", 0.8, None, "", ""),
    ("route:people-lists.store", "people-lists.store", "POST", "people-lists", "App\\Plain::store", 0.8, None, "", ""),
    ("route:people-lists.show", "people-lists.show", "GET HEAD", "people-lists/{who}", "App\\Plain::show", 0.8, None, "", ""),
    ("route:people-lists.update", "people-lists.update", "PUT PATCH", "people-lists/{who}", "App\\Plain::update", 0.8, None, "", ""),
    ("route:VIEW:about", None, "GET HEAD", "about", None, 0.5, "pages.about", "", ""),
    ("route:REDIRECT:old", None, EVERY_VERB, "old", None, 0.5, None, "", ""),
]


@query(expected(ROUTES, "route_key name methods uri target confidence view classes aliases", "confidence", ", 's' || s_suppkey || '/routes/web.php' as path"))
def route_table(spark, sf_dir):
    """Nested groups by call and by array, resources with options, all forms of actions, middleware by class and by alias."""
    r = routing.route_table(suppliers(spark, sf_dir, sample_sources.FILES))
    joined = lambda c: F.array_join(c, " ")
    return r.select("route_key", "name", joined("methods").alias("methods"), "uri", "target", F.col("confidence").cast("double").alias("confidence"), "view", joined("middleware_classes").alias("classes"), joined("middleware_aliases").alias("aliases"), "path")


C, REGISTER = "class:", f"method:{P}AppProvider::register"
SAID = [
    (f"{C}{P}UserObserver", f"{C}{M}User", "observes", 0.9), (f"{C}{M}OrderObserver", ORDER, "observes", 0.9), (f"{C}App\\Audit", ORDER, "observes", 0.9),
    (f"{C}{P}Notify", f"{C}{P}Shipped", "listens_to_event", 0.9), (f"{C}{P}SendMail", f"{C}{P}Placed", "listens_to_event", 0.9), (f"{C}{P}Log\\Write", f"{C}{P}Placed", "listens_to_event", 0.9),
    (f"{C}{P}UserPolicy", f"{C}{M}User", "depends_on", 0.9), (f"{C}{P}OrderPolicy", ORDER, "depends_on", 0.9), (REGISTER, f"{C}{P}CardPay", "contextual_binding", 0.85),
    (f"method:{M}Order::lines", f"{C}{M}Line", "uses_model", 0.85), (f"method:{M}Order::tags", f"{C}{M}Tag", "uses_model", 0.85), (f"method:{M}Order::tags", "table:order_tag", "uses_table", 0.9),
    (REGISTER, f"{C}{P}StripePay", "binds", 0.85), (f"{C}App\\Contracts\\Pay", f"{C}{P}StripePay", "binds", 0.85), (REGISTER, f"{C}App\\Cart", "binds", 0.95),
    (REGISTER, f"{C}{P}Clock", "binds", 0.9), (REGISTER, f"{C}App\\New", "binds", 0.8), (f"{C}App\\Old", f"{C}App\\New", "binds", 0.8),
]


@query(expected(SAID, "source_key target_key relationship confidence", "confidence"))
def semantic_edges(spark, sf_dir):
    """Observers, listeners, policies, bindings, relations and pivots."""
    return semantics.semantic_edges(suppliers(spark, sf_dir, sample_sources.FILES)).select("source_key", "target_key", "relationship", F.col("confidence").cast("double").alias("confidence"))


FACTS = [
    (f"{C}{P}AppProvider", "", "", "", "", None, None, ""),
    (ORDER, f"a=bool b={M}Money d=date", "Total fullName", "openOnes", f"lines={M}Line owner=Illuminate\\Database\\Eloquent\\Relations\\Relation tags={M}Tag", None, None, ""),
    (f"{C}App\\Facades\\Cart", "", "", "", "", "cart", "container_key", ""),
    (f"{C}App\\Facades\\Web", "", "", "", "", None, None, "auth can:x"),
]


@query(expected(FACTS, "class_key casts accessors scopes relations facade_accessor accessor_kind middleware_aliases"))
def class_facts(spark, sf_dir):
    """Casts by property and by method, accessors of both forms, scopes, relations, what a facade stands for."""
    f = semantics.class_facts(suppliers(spark, sf_dir, sample_sources.FILES))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias(m)
    joined = lambda a: F.array_join(a, " ").alias(a)
    return f.select("class_key", shown("casts"), joined("accessors"), joined("scopes"), shown("relations"), "facade_accessor", "accessor_kind", joined("middleware_aliases"))


ABOUT = "view:pages.about"
TEMPLATE_ENDS = [*((ABOUT, f"view:{v}", "renders_view") for v in ("layouts.app", "parts.list", "parts.own", "parts.shared")), (ABOUT, "component:alert", "uses_component"), (ABOUT, "component:forms.field", "uses_component"), (ABOUT, "route:home", "references_route")]


@query(expected(TEMPLATE_ENDS, "source_key target_key relationship"))
def template_edges(spark, sf_dir):
    _, e = template_graph(suppliers(spark, sf_dir, sample_sources.FILES).where("path like '%.blade.php'"))
    return e.select("source_key", "target_key", "relationship")


# -- inheritance, receivers, chains


CASES = [("a", "unknown", None), ("b", "unknown", None), ("c", "resolved", "t::run"), ("d", "resolved", "t::run"), ("t", "resolved", "t::run"), ("e", "unknown", None), ("f", "resolved", "g::run"), ("h", "unknown", None), ("i", "resolved", "g::run")]


@query(f"select s_suppkey || class_key as class_key, state, s_suppkey || method_key as method_key from supplier cross join (values {_values(CASES)}) x(class_key, state, method_key)")
def inheritance_cases(spark, sf_dir):
    """Cycles (a, b), traits above the first level (d extends c, which uses t and extends g), two that differ (e), one declaration
    by two ways (f), a private one in the way (h), and a cycle that a trait makes irrelevant (i): all of them for each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))

    def rows(data: list[tuple], names: str, own: str) -> DataFrame:
        each = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names.split(), strict=True))) for r in data))
        out = s.select("k", F.explode(each).alias("r")).select("k", "r.*")
        return out.select(*(F.concat("k", n).alias(n) if n in own.split() else F.col(n) for n in names.split()))

    classes = rows([(c, False) for c in "abcdefghitxyz"], "class_key adapts", "class_key")
    methods = rows([("t", "run", "t::run", False), ("g", "run", "g::run", False), ("x", "run", "x::run", True)], "class_key name method_key private", "class_key method_key")
    up = [("a", "b", "extends"), ("b", "a", "extends"), ("c", "t", "trait"), ("c", "g", "extends"), ("d", "c", "extends"), ("e", "t", "trait"), ("e", "g", "trait"), ("f", "y", "trait"), ("f", "z", "trait"), ("y", "g", "extends"), ("z", "g", "extends"), ("h", "x", "extends"), ("i", "g", "trait"), ("i", "a", "extends")]
    calls = rows([(c, "run") for c in "abcdtefhi"], "class_key name", "class_key")
    return graph.inherited_methods(classes, methods, rows(up, "class_key parent_key kind", "class_key parent_key"), calls).select("class_key", "state", "method_key")


def _text(*parts: str) -> Column:
    """A text of literals and columns: parts that begin with @ name a column."""
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts))


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part, whose method takes, makes, copies and merges objects of classes named by the part's brand, size and price."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")).withColumns({"brand": F.replace("p_brand", F.lit("#"), F.lit("")), "other": F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("T"), F.col("p_size").cast("string"))).otherwise("U"), "twice": F.when(F.col("p_size") % 2 == 0, "$x").otherwise("helper()")})
    code = _text(
        "<?php\nnamespace App;\nclass P", "@p_partkey", " extends Base\n{\n    private ?K", "@p_size", " $kept;\n    public function go(B", "@brand", " $b, $free)\n    {\n        // $b->no('it')\n        $x = new T", "@p_size",
        "(1, ['a' => ')']); $x->make(); $y = $x; $y->copied();\n        if ($free->is('x // y')) { $y = new W; $y->inside(); $x = new ", "@other", "(); } else { $x->other(); }\n        $x->merged(); $y->lost(); $b->given(); $this->kept->held();\n        $z = ", "@twice",
        "; $z->last();\n        $f = function (T", "@p_size", " $b) use ($x) { $b->inner(); $y->lost(); };\n    }\n}\n",
    )
    return p.select(_text("app/P", "@p_partkey", ".php").alias("path"), code.alias("text"))


PART_SQL = """p as (select p_partkey, p_size, replace(p_brand, '#', '') as brand, p_size % 3 = 0 as same, p_size % 2 = 0 as twice from part)"""


@query(f"""with {PART_SQL}, c as (
select p_partkey, 'B' || brand || '::given' as t from p union all select p_partkey, 'T' || p_size || '::' || m from p, unnest(['make', 'copied', 'other', 'inner']) u(m) union all select p_partkey, 'W::inside' from p
union all select p_partkey, 'K' || p_size || '::held' from p union all select p_partkey, 'T' || p_size || '::merged' from p where same union all select p_partkey, 'T' || p_size || '::last' from p where same and twice)
select 'method:App\\P' || p_partkey || '::go' as source_key, 'method:App\\' || t as target_key, 0.75 as confidence from c""")
def receiver_calls(spark, sf_dir):
    """Calls on parameters, new objects, copies, branches that agree or don't, properties and closures."""
    e = receivers.receiver_edges(part_sources(spark, sf_dir))
    return e.select("source_key", "target_key", F.col("confidence").cast("double").alias("confidence"))


@query(f"""with {PART_SQL}, n as (select p_partkey, 3 + (not same)::int + (not (same and twice))::int as unresolved from p)
select sum(unresolved)::bigint as unresolved, count(*) as methods, (select string_agg(s, ' ' order by s) from (select 'App\\P' || p_partkey || '::go (' || unresolved || ')' as s from n order by s limit 3)) as examples from n""")
def unresolved_sites(spark, sf_dir):
    """Calls whose receiver isn't known, over all methods, with the first three methods that have any."""
    return reports.unresolved_sites(receivers.unresolved_calls(part_sources(spark, sf_dir)))


@query("""with n as (select n_nationkey as k, n_regionkey as r, n_nationkey % 2 = 0 as even from nation), c as (
select k, 'class:App\\E' || r as t, 'dispatches_event' as rel, 0.7 as c, null as via, null as res from n union all select k, case when even then 'class:App\\J' || r || 'Event' else 'class:App\\J' || r end, case when even then 'dispatches_event' else 'depends_on' end, case when even then 0.7 else 0.75 end, case when not even then 'dispatch' end, null from n
union all select k, 'class:App\\S' || r, 'depends_on', 0.8, 'app', null from n union all select k, 'method:App\\N' || k || '::own', 'calls', 0.85, null, null from n union all select k, 'method:App\\N' || k || '::late', 'calls', 0.4, null, null from n
union all select k, 'method:App\\Up' || r || '::above', 'calls', 0.85, null, null from n
union all select k, 'function:App\\' || f, 'calls', 0.65, null, 'namespace_fallback' from n, unnest(['event', 'app', 'help' || k]) u(f) union all select k, 'function:' || f, 'calls', 0.5, null, 'global_fallback' from n, unnest(['event', 'app', 'help' || k]) u(f)
union all select k, 'function:Lib\\go', 'calls', 0.95, null, 'resolved_name' from n)
select 'method:App\\N' || k || '::run' as source_key, t as target_key, rel as relationship, c as confidence, via, res as resolution from c""")
def body_calls(spark, sf_dir):
    """Events, dispatches, the container, own, late and inherited static calls, functions of a namespace and of others."""
    n = table(spark, sf_dir, "nation").withColumn("job", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("J"), F.col("n_regionkey").cast("string"), F.lit("Event"))).otherwise(F.concat(F.lit("J"), F.col("n_regionkey").cast("string"))))
    code = _text(
        "<?php\nnamespace App;\nclass N", "@n_nationkey", " extends Up", "@n_regionkey", "\n{\n    public function run()\n    {\n        event(new E", "@n_regionkey", "(1)); event($e); // event(new No)\n        ", "@job", "::dispatch('x'); app(S", "@n_regionkey",
        "::class); self::own(); static::late(); parent::above(1); if (1) { return \\strlen('help()'); }\n        help", "@n_nationkey", "(\\Lib\\go());\n    }\n}\n",
    )
    _, other = receivers.body_edges(n.select(_text("app/N", "@n_nationkey", ".php").alias("path"), code.alias("text")))
    return other.select("source_key", "target_key", "relationship", F.col("confidence").cast("double").alias("confidence"), "via", "resolution").distinct()


def fluent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).withColumns({"first": F.when(F.col("s_suppkey") % 3 == 0, "where").when(F.col("s_suppkey") % 3 == 1, "with").otherwise("make"), "then": F.when(F.col("s_suppkey") % 2 == 0, "get").otherwise("take")})
    code = _text(
        "<?php\nnamespace App;\nclass M", "@s_suppkey", " extends \\Illuminate\\Database\\Eloquent\\Model\n{\n    public function notes() { return $this->hasMany(Note::class); }\n    public function go()\n    {\n        $q = M", "@s_suppkey", "::", "@first",
        "('a', [1, ')'])->orderBy('b'); $q->limit(2); $r = $q->", "@then", "(); $r->map();\n        $this->notes()->where('c')->lazy()->each();\n    }\n}\n",
    )
    return s.select(_text("app/M", "@s_suppkey", ".php").alias("path"), code.alias("text"))


@query("""with s as (select s_suppkey as k, s_suppkey % 3 < 2 as known, s_suppkey % 2 = 0 as gets from supplier),
c as (select k, m, 'Illuminate\\Database\\Eloquent\\' || t as t from s, (values ('orderBy', 'Builder'), ('limit', 'Builder'), ('then', 'Builder')) v(m, t) where known
union all select k, 'map', case when gets then 'Illuminate\\Support\\Collection' else 'Illuminate\\Database\\Eloquent\\Builder' end from s where known
union all select k, m, 'Illuminate\\' || t from s, (values ('where', 'Database\\Eloquent\\Relations\\Relation'), ('lazy', 'Database\\Eloquent\\Relations\\Relation'), ('each', 'Support\\Collection')) v(m, t))
select 'method:App\\M' || k || '::go' as source_key, 'method:' || t || '::' || case when m <> 'then' then m when k % 2 = 0 then 'get' else 'take' end as target_key, 'framework_type' as resolution from c
union all select 'method:App\\M' || k || '::' || case when m = 'hasMany' then 'notes' else 'go' end, 'method:App\\M' || k || '::' || m, null from s, (values ('hasMany'), ('notes')) v(m)""")
def fluent_edges(spark, sf_dir):
    """Chains on models, on variables that hold a query, and on relations."""
    return receivers.receiver_edges(fluent_sources(spark, sf_dir)).select("source_key", "target_key", "resolution")


@query("""with m as (select p_partkey from part where p_size % 2 = 0), e as (select o_orderkey, o_orderkey % 3000 as c, case o_orderkey % 4 when 0 then 'where' when 1 then 'pluck' when 2 then 'save' else 'helper' end as f, case when o_orderkey % 5 = 0 then 'declared_method' end as r from orders)
select o_orderkey, case when r is null and p_partkey is not null and f <> 'helper' then 'eloquent_builder_forward' else r end as resolution, case when r is null and p_partkey is not null and f <> 'helper' then 'partially_resolved' end as resolution_state,
case when r is null and p_partkey is not null and f <> 'helper' then 'M' || c end as forward_receiver from e left join m on p_partkey = c""")
def builder_forwards(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.when(k % 4 == 0, "where").when(k % 4 == 1, "pluck").when(k % 4 == 2, "save").otherwise("helper")
    calls = o.select("o_orderkey", F.concat(F.lit("method:M"), (k % 3000).cast("string"), F.lit("::"), name).alias("target_key"), F.when(k % 5 == 0, "declared_method").alias("resolution"), F.lit(None).cast("string").alias("resolution_state"))
    models = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(_text("class:m", "@p_partkey").alias("class_key"))
    return semantics.builder_forwards(calls, models, receivers.QUERY_CALLS + receivers.COLLECTION_CALLS + receivers.MODEL_CALLS).drop("target_key")


@query("""select o_orderkey, case when hit then 'form_request' else via end as via, case when hit then 'form_request' end as resolution, case when hit then 'resolved' end as resolution_state from (
select o_orderkey, via, p_partkey is not null and via = 'parameter' and o_orderkey % 7 > 0 as hit from (select o_orderkey, o_orderkey % 3000 as c, case o_orderkey % 3 when 0 then 'parameter' when 1 then 'new' end as via from orders) left join (select p_partkey from part where p_size > 25) on p_partkey = c)""")
def form_requests(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = o.select("o_orderkey", F.when(k % 7 > 0, "depends_on").otherwise("calls").alias("relationship"), F.concat(F.lit("class:Q"), (k % 3000).cast("string")).alias("target_key"), F.when(k % 3 == 0, "parameter").when(k % 3 == 1, "new").alias("via"), none.alias("resolution"), none.alias("resolution_state"))
    requests = table(spark, sf_dir, "part").where("p_size > 25").select(_text("class:q", "@p_partkey").alias("class_key"))
    return semantics.form_requests(rows, requests).select("o_orderkey", "via", "resolution", "resolution_state")


# -- synchronisation


def _store(spark: SparkSession) -> SnapshotStore:
    return SnapshotStore(spark, f"{checkpoint_dir(spark)}/sync-{uuid.uuid4().hex}")


LINKED = [(f"method:{M}Order::close", f"method:{M}Logs::note", "inherited_method", f"method:{M}Order::note"), (f"method:{M}Order::close", f"method:{M}Order::missing", None, None), (f"method:{M}Logs::note", f"method:{M}Audit::write", None, None)]


@query(f"""{expected(LINKED, 'source_key target_key resolution original_target')} union all select 'completed', 'updated', count(*) filter (s_suppkey % 2 = 0)::varchar, 'skipped ' || (2 * count(*) - count(*) filter (s_suppkey % 2 = 0)) from supplier""")
def sync_incremental(spark, sf_dir):
    """A full run, then one in which a file of every other supplier has changed: calls as they are linked at the end, and what the last run did."""
    store, tree = _store(spark), cut(suppliers(spark, sf_dir, LITERAL))
    sync(store, tree, ["s1"], "full")
    number = F.regexp_extract("path", "^s([0-9]+)/", 1).cast("int")
    edited = F.col("path").endswith("Logs.php") & (number % 2 == 0)
    done = sync(store, tree.withColumn("text", F.when(edited, F.concat("text", F.lit("// changed"))).otherwise(F.col("text"))), ["s1"])
    calls = graph_edges(store).where("relationship = 'calls'").select("source_key", "target_key", "resolution", "original_target")
    return calls.unionByName(spark.createDataFrame([(done.status, "updated", str(done.updated), f"skipped {done.skipped}")], calls.schema))


def nation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation a provider that states its region's listener, and a migration that adds a column to its region's table."""
    n = table(spark, sf_dir, "nation")
    provider = _text("<?php\nnamespace App;\nclass Provider", "@n_nationkey", " extends Base\n{\n    public function boot() { Event::listen(Shipped", "@n_regionkey", "::class, Notify::class); }\n}\n")
    migration = _text("<?php\nreturn new class {\n    public function down() { Schema::drop('gone'); }\n    public function up()\n    {\n        Schema::table('t", "@n_regionkey", "', function ($t) { $t->string('c", "@n_nationkey", "'); $t->id(); });\n    }\n};\n")
    both = F.array(F.struct(_text("app/Provider", "@n_nationkey", ".php").alias("path"), provider.alias("text")), F.struct(_text("database/migrations/m", "@n_nationkey", ".php").alias("path"), migration.alias("text")))
    return n.select("n_nationkey", "n_regionkey", F.explode(both).alias("f")).select("n_nationkey", "n_regionkey", "f.*")


@query("""with n as (select n_regionkey as r, count(*) filter (n_nationkey % 2 = 0) as n, string_agg('c' || n_nationkey || ':string', ' ' order by 'c' || n_nationkey || ':string') filter (n_nationkey % 2 = 0) as cols from nation where n_regionkey < 3 or n_nationkey % 2 = 1 group by 1)
select 'class:App\\Notify' as source_key, 'class:App\\Shipped' || r as target_key, 'listens_to_event' as relationship, null as columns from n where n > 0
union all select 'table:t' || r, n::varchar, 'sources', cols from n where n > 0""")
def sync_shared_statements(spark, sf_dir):
    """Several files state one edge and one table. After a full run the odd nations' files go, and so do all of regions 3 and 4: what the
    others still state stays, what nobody states any more goes."""
    store, tree = _store(spark), cut(nation_sources(spark, sf_dir))
    sync(store, tree.select("path", "text"), ["app", "database"], "full")
    sync(store, tree.where("n_nationkey % 2 = 0 and n_regionkey < 3").select("path", "text"), ["app", "database"])
    edges = graph_edges(store).where("relationship = 'listens_to_event'").select("source_key", "target_key", "relationship", F.lit(None).cast("string").alias("columns"))
    shown = F.array_join(F.array_sort(F.filter(F.flatten(F.collect_list(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])))), lambda c: c != "id:id")), " ")
    tables = store.read("shared").groupBy("node_key").agg(F.count(F.lit(1)).cast("string").alias("target_key"), shown.alias("columns"))
    tables = tables.join(store.read("nodes").where("node_type = 'table' and not stub").select("node_key"), "node_key")
    return edges.unionByName(tables.select(F.col("node_key").alias("source_key"), "target_key", F.lit("sources").alias("relationship"), "columns"))


@query("""with s as (select s_suppkey as k, s_suppkey % 3 < 2 as known from supplier)
select 'method:App\\M' || k || '::' || case s_suppkey_mod when 0 then 'where' when 1 then 'with' else 'make' end as target_key, case when s_suppkey_mod < 2 then 'eloquent_builder_forward' end as resolution, case when s_suppkey_mod < 2 then 'partially_resolved' end as resolution_state, count(*) as n
from (select k, k % 3 as s_suppkey_mod from s) group by 1, 2, 3""")
def sync_annotations(spark, sf_dir):
    """After a run over models: static calls that they hand on to their query."""
    store = _store(spark)
    sync(store, fluent_sources(spark, sf_dir), ["app"], "full")
    e = annotated_edges(store).where("relationship = 'calls' and source_key like '%::go' and target_key rlike '::(where|with|make)$' and target_key like 'method:App%'")
    return e.groupBy("target_key", "resolution", "resolution_state").agg(F.count(F.lit(1)).alias("n"))


# -- orders, appends and joins of the graph's upkeep


@query("""with f as (select p_partkey, 'f' || p_partkey as file_path from part where p_size % 2 = 0)
select o_orderkey, 'file:' || p_partkey as declared_in from orders left join f on file_path = case when o_orderkey % 7 > 0 then 'f' || (o_custkey % 3000) end""")
def edge_declarations(spark, sf_dir):
    """Edges with the file that states them: some files are indexed as something else, some not at all, and some edges name none."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    edges = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("f"), (F.col("o_custkey") % 3000).cast("string"))).alias("file_path"))
    nodes = p.select(_text("file:", "@p_partkey").alias("node_key"), F.when(F.col("p_size") % 2 == 0, "file").otherwise("class").alias("node_type"), _text("f", "@p_partkey").alias("file_path"))
    return graph.declaring_files(edges, nodes).select("o_orderkey", "declared_in")


@query("""select o_orderkey as id, verified_at, row_number() over (order by verified_at desc nulls last, o_orderkey) as place, true as more from (
select o_orderkey, case when o_custkey % 3 > 0 then o_orderdate end as verified_at from orders where o_orderstatus = 'P') qualify place <= 160""")
def last_verified(spark, sf_dir):
    """Entries by when they were verified, never at the end, as many as one question reads."""
    k = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderdate")).alias("verified_at"))
    top, more = knowledge.last_verified(k)
    by = Window.orderBy(F.desc_nulls_last("verified_at"), "id")  # 160 rows
    return top.withColumn("place", F.row_number().over(by).cast("long")).withColumn("more", F.lit(more))


@query("""with files as (select 'src/' || lang || '/' || source || '/' || doc_id || '.txt' as path from documents) select path, row_number() over (order by path) as number from files""")
def path_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files.in_path_order(d.select(path.alias("path")))


@query("""select cast(sum(ceil(strlen(text) / 4.0)) as bigint) as full_source_estimated_tokens, cast(sum(least(ceil(strlen(text) / 4.0), 625)) as bigint) as project_memory_estimated_tokens,
cast(null as bigint) as provider_reported_input_tokens, cast(null as bigint) as provider_reported_output_tokens, cast(null as bigint) as cached_tokens from documents""")
def evaluation_totals(spark, sf_dir):
    full = text.token_estimate(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(full.alias("full_source_estimated_tokens"), F.least(full, F.lit(625)).alias("estimated_context_tokens"))
    return reports.compared(rows)


@query("""with l as (select n_nationkey::bigint as id, n_name as intent, ['a', n_name] as f, null::varchar as outcome from nation),
d as (select (select max(n_nationkey) from nation) + row_number() over (order by s_name) as id, s_name as intent, case when s_suppkey % 2 = 0 then [s_name, 'x'] else [] end as f, case when s_suppkey % 3 = 0 then 'passed' end as outcome from supplier)
select id, intent, array_to_string(f, ' ') as files, 0::bigint as symbols, outcome from (select * from l union all select * from d)""")
def change_sets(spark, sf_dir):
    """A log of changes, and drafts that are appended to it."""
    none = F.lit(None).cast("string")
    log = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("intent"), none.alias("git_commit"), F.array(F.lit("a"), "n_name").alias("changed_files"), F.array().cast("array<string>").alias("changed_symbols"),
        *(none.alias(c) for c in ("expected_impact", "actual_impact", "validation_outcome", "lessons")),
    )
    drafts = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("intent"), F.when(F.col("s_suppkey") % 2 == 0, F.array("s_name", F.lit("x"))).alias("changed_files"), F.when(F.col("s_suppkey") % 3 == 0, "passed").alias("validation_outcome"))
    out = knowledge.change_sets(log, drafts)
    return out.select("id", "intent", F.array_join("changed_files", " ").alias("files"), F.size("changed_symbols").cast("long").alias("symbols"), F.col("validation_outcome").alias("outcome"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then 'app/' || s_suppkey || ' lib' when 1 then 'root/' || s_suppkey when 2 then 'x' else '' end as paths from supplier""")
def module_paths(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 4
    none = F.lit(None).cast("string")
    paths = F.when(kind == 0, F.array(F.concat(F.lit("app\\"), n, F.lit("\\")), F.lit("lib//"), F.concat(F.lit("app/"), n), F.lit("/"))).when(kind == 2, F.array(F.lit("x"), none, F.lit("x/")))
    return s.select("s_suppkey", F.array_join(text.module_paths(paths, F.when(kind == 1, F.concat(F.lit("root/"), n, F.lit("/")))), " ").alias("paths"))
