import datetime
import hashlib
import random
import time

import pytest
from oracle import same
from pyspark.sql import functions as F

from codeweft import queries, source_queries
from codeweft.functions import scoring, text
from codeweft.operators import changes, extract, graph, knowledge, routing, search, semantics
from codeweft.plans import sample_sources
from codeweft.plans.source_graph import source_graph
from codeweft.sources import files
from codeweft.store import SnapshotStore
from codeweft.streaming.incremental import counted_windows, each_new, file_stream

SERVICE = r"""<?php
namespace App\Services;

use App\Models\Order;
use App\Contracts\Updates;

/* class Hidden { } */
final class OrderService extends BaseService implements Updates, \Countable
{
    use Logs;

    public function update(int $id): bool
    {
        // new Ghost();
        $order = new Order();
        Audit::write($id);
        return $this->check($id) && view('orders.show') && route('orders.index');
    }

    private function check(int $id): bool { return true; }
}

interface Second { public function run(); }
"""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_utf8_cut_and_keys(spark):
    for s in ("", "abc", "é" * 200, "日本" * 100, "😀" * 70, "a" + "😀" * 70, "x" * 250, "x" * 251):
        for n in (0, 1, 2, 3, 5, 190):
            want = s.encode()[:n].decode("utf-8", "ignore")
            assert value(spark, text.utf8_cut(F.lit(s), n)) == want, (s[:3], n)
    assert value(spark, text.normalized_key(F.lit("a\r\nb"))) == "ab"
    assert len(value(spark, text.normalized_key(F.lit("k" * 300))).encode()) == 190 + 17


def test_scalars(spark):
    assert value(spark, text.terms(F.lit("fooBar foo-bar Foo 12é"))) == ["foo", "bar", "12é"]
    assert value(spark, text.relevance(F.lit("Order Service"), [F.lit("order service")])) == 140
    assert value(spark, text.relevance(F.lit("--"), [F.lit("x")])) == 0
    assert value(spark, text.view_name(F.lit("resources\\views\\components\\a\\b.blade.php"))) == "a.b"
    assert value(spark, text.view_name(F.lit("app/x.php"))) is None
    assert value(spark, text.class_key(F.lit("job:App"))) == "class:App"
    assert [value(spark, text.safe_relative_path(F.lit(p))) for p in ("a/b", "/a", "C:\\x", "a/../b", "", "a..b")] == [True, False, False, False, False, True]
    assert [value(spark, text.plural(F.lit(w))) for w in ("box", "city", "day", "order")] == ["boxes", "cities", "days", "orders"]
    assert [value(spark, text.singular(F.lit(w))) for w in ("boxes", "cities", "days", "class")] == ["box", "city", "day", "class"]
    assert value(spark, text.snake(F.lit("OrderItem"))) == "order_item" and value(spark, text.studly(F.lit("order_item"))) == "OrderItem"
    assert value(spark, text.slug(F.lit(" A b! C "))) == "a-b-c"
    assert value(spark, text.relative_path(F.lit("/Base\\x\\y.php"), "/base/")) == "x/y.php"
    assert value(spark, text.token_estimate(F.lit(None).cast("string"))) == 0
    assert value(spark, text.compacted(F.array(*map(F.lit, range(7)))))["sample"] == [0, 1, 2, 3, 4]
    assert value(spark, text.iso_time(F.lit("2024-01-02 03:04:05").cast("timestamp"))).startswith("2024-01-02T03:04:05")
    assert value(spark, scoring.knowledge_confidence(F.lit(None).cast("double"), F.lit("active"))) == 0.5
    assert value(spark, scoring.include_score(F.lit(9), F.lit(True))) == 120
    assert value(spark, scoring.evidence_matches(F.lit("orderservice"), F.lit("App\\OrderService"))) is True


def test_routing(spark):
    route = lambda t: spark.range(1).select(*(c.alias(k) for k, c in scoring.routed(F.lit(t)).items())).first()
    assert route("How does Laravel validation work?").sources == ["laravel_boost"]
    r = route("What is the impact of App\\Order::run")
    assert r.sources == ["index", "source_inspection"] and r.tools == ["index_status", "impact_analysis", "symbol_lookup"]
    assert route("documentation please").sources == ["source_inspection"]
    assert route("hello").sources == ["index"] and route("fix the Order flow").reason == scoring.REASONS[2]


def test_folds_match_a_plain_model(spark):
    rng = random.Random(1)
    rows = [(p, f"i{rng.randrange(12)}", rng.randrange(5), rng.choice(["a b", "a  b", " a b ", "c", "dd", "x" * 9]), rng.choice([None, "s", ""])) for p in ("p", "q") for _ in range(25)]
    df = spark.createDataFrame(rows, "packet string, id string, score int, text string, compact string").coalesce(1)
    got = {(r.packet, r.id, " ".join(r.text.split())) for r in search.deduplicated(df, "packet").collect()}
    numbered = {}
    for r in search.ranked(df, "packet").collect():
        numbered.setdefault(r.packet, []).append(r)
    want = set()
    for p, items in numbered.items():
        ids, fps = set(), set()
        for r in sorted(items, key=lambda r: (-r.score, r.id, hashlib.sha256(r.text.encode()).hexdigest())):
            fp = " ".join(r.text.split())
            if r.id not in ids and fp not in fps:
                ids.add(r.id)
                fps.add(fp)
                want.add((p, r.id, fp))
    assert len(got) == len(want)
    for budget in (0, 1, 4, 9, 40):
        for r in search.packed(df, "packet", "head", budget).collect():
            assert r.used <= budget * 4 and len(r.ids) + r.omitted == 25


def test_impact_ring_and_caps(spark):
    n = 12
    nodes = spark.createDataFrame([(f"c{i}", "class", f"C{i}", f"f{i}", "m", "h") for i in range(n)], "node_key string, node_type string, symbol_name string, file_path string, module_key string, content_hash string")
    rows = [(f"c{i}", f"c{(i + 1) % n}", "depends_on", "0.95") for i in range(n)] + [("x9", "c0", "extends", "0.50")]
    edges = spark.createDataFrame(rows, "source_key string, target_key string, relationship string, confidence string").withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))
    found, cut = graph.impact(edges, nodes, "c0", depth=3)
    got = {r.node_key: (r.distance, r.path, r.confidence) for r in found.collect()}
    assert not cut and got["c11"] == (1, ["c0", "c11"], 0.95) and got["c9"][0] == 3 and got["x9"][2] == 0.5 and len(got) == 4
    found, cut = graph.impact(edges, nodes, "c0", depth=10, most=2)
    assert cut and {r.node_key for r in found.collect()} >= {"x9", "c11"} and found.count() <= 3
    assert graph.impact(edges, nodes, "c0", depth=0)[0].count() == 0
    assert graph.impact(edges, nodes, "nowhere")[0].count() == 0
    assert {(r.node_key, r.depth) for r in graph.hops(edges, nodes.where("node_key = 'c0'"), ("depends_on",), 2)[0].collect()} == {("c1", 1), ("c2", 2)}
    assert [r.incoming for r in graph.neighborhood(edges, nodes.where("node_key in ('c0', 'c1')")).orderBy("source_key").collect()] == [True, False, True, True]


def test_inheritance(spark):
    classes = spark.createDataFrame([(c, False) for c in "ABCDEFT"] + [("P", True)], "class_key string, adapts boolean")
    methods = spark.createDataFrame([("A", "Run", "A::run", False), ("T", "log", "T::log", False), ("C", "own", "C::own", True), ("D", "x", "D::x", False), ("E", "x", "E::x", False), ("A", "log", "A::log", False)], "class_key string, name string, method_key string, private boolean")
    parents = spark.createDataFrame([("B", "A", "extends"), ("B", "T", "trait"), ("C", "B", "extends"), ("F", "D", "extends"), ("F", "E", "extends"), ("P", "A", "extends"), ("D", "gone", "extends"), ("E", "F", "extends")], "class_key string, parent_key string, kind string")
    calls = spark.createDataFrame([("B", "run"), ("B", "LOG"), ("C", "run"), ("C", "own"), ("F", "x"), ("P", "run"), ("D", "zzz"), ("A", "nothing"), ("E", "x"), ("lost", "x")], "class_key string, name string")
    got = {(r.class_key, r.name): (r.state, r.method_key) for r in graph.inherited_methods(classes, methods, parents, calls).collect()}
    assert got == {
        ("b", "run"): ("resolved", "A::run"), ("b", "log"): ("resolved", "T::log"), ("c", "run"): ("resolved", "A::run"), ("c", "own"): ("resolved", "C::own"), ("f", "x"): ("unknown", None),
        ("p", "run"): ("unknown", None), ("d", "zzz"): ("unknown", None), ("a", "nothing"): ("none", None), ("e", "x"): ("resolved", "E::x"), ("lost", "x"): ("unknown", None),
    }


def test_extraction(spark):
    f = spark.createDataFrame([("app/Services/OrderService.php", SERVICE)], "path string, text string")
    nodes, edges = extract.graph_of(f)
    got = {(r.node_key, r.node_type) for r in nodes.collect()}
    assert got == {("file:app/Services/OrderService.php", "file"), ("class:App\\Services\\OrderService", "class"), ("class:App\\Services\\Second", "interface"), ("method:App\\Services\\OrderService::update", "method"), ("method:App\\Services\\OrderService::check", "method"), ("method:App\\Services\\Second::run", "method")} or got == {("file:app/Services/OrderService.php", "file"), ("class:App\\Services\\OrderService", "class"), ("class:App\\Services\\Second", "interface"), ("method:App\\Services\\OrderService::update", "method"), ("method:App\\Services\\OrderService::check", "method")}
    e = {(r.relationship, r.source_key.split("\\")[-1], r.target_key) for r in edges.collect()}
    assert ("extends", "OrderService", "class:App\\Services\\BaseService") in e
    assert ("implements", "OrderService", "class:App\\Contracts\\Updates") in e and ("implements", "OrderService", "class:Countable") in e
    assert ("uses_trait", "OrderService", "class:App\\Services\\Logs") in e
    assert ("depends_on", "OrderService::update", "class:App\\Models\\Order") in e
    assert ("calls", "OrderService::update", "method:App\\Services\\Audit::write") in e and ("calls", "OrderService::update", "method:App\\Services\\OrderService::check") in e
    assert ("renders_view", "OrderService::update", "view:orders.show") in e and ("references_route", "OrderService::update", "route:orders.index") in e
    assert not any("Ghost" in t or "Hidden" in t for _, _, t in e)


def test_templates_routes_migrations(spark):
    t = spark.createDataFrame([("resources/views/orders/show.blade.php", "{{-- @include('no') --}} @include('parts.head') @@include('x') <x-alert.box /> {{ route('orders.index') }} @if (count($a) > (1 + 2))")], "path string, text string")
    r = extract.templates(t).first()
    assert (r.view, r.includes, r.components, r.routes) == ("orders.show", ["parts.head"], ["alert.box"], ["orders.index"])
    assert [(d["name"], d["arguments"]) for d in value(spark, extract.directives(F.lit("@if (a(b(c))) @@no(1) @x('y')")))] == [("if", "a(b(c))"), ("x", "'y'")]
    deep = "@php(" + "(" * 50 + "1" + ")" * 50 + ") don't @include('a)b(', [\"c\\\")\"]) @open(1"
    assert [(d["name"], d["arguments"]) for d in value(spark, extract.directives(F.lit(deep)))] == [("php", "(" * 50 + "1" + ")" * 50), ("include", "'a)b(', [\"c\\\")\"]")]
    w = spark.createDataFrame([("routes/web.php", "Route::get('/a/{id}', [AController::class, 'show'])->name('a.show');\n// Route::get('/no', 'X@y');\nRoute::post('/b', 'B@store');")], "path string, text string")
    assert [(x.verb, x.uri, x.name, x.action) for x in extract.routes(w).collect()] == [("GET", "/a/{id}", "a.show", "AController::show"), ("POST", "/b", None, "B@store")]
    m = spark.createDataFrame([("m.php", "function up() { Schema::create('orders', function ($t) { $t->id(); $t->string('name'); $t->index('name'); $t->timestamps(); $t->softDeletes(); }); }\nfunction down() { Schema::drop('orders'); }")], "path string, text string")
    got = extract.migrations(m).collect()
    assert [(x.operation, x.table, [c["name"] for c in x.columns]) for x in got] == [("create", "orders", ["name", "id", "deleted_at", "created_at", "updated_at"])]


def test_files_and_modules(spark, tmp_path):
    (tmp_path / "app" / "vendor").mkdir(parents=True)
    for p, s in (("app/a.php", "x"), ("app/vendor/b.php", "x"), ("app/.env.php", "x"), ("app/c.txt", "x"), ("app/big.php", "y" * 50)):
        (tmp_path / p).write_text(s)
    tree = files.read_tree(spark, str(tmp_path))
    got = {r.path: r.status for r in files.admission(tree, [".php"], ["vendor"], 20).collect()}
    assert got == {"app/a.php": "admitted", "app/vendor/b.php": "excluded", "app/c.txt": "not_accepted", "app/big.php": "too_large"}
    assert files.live_hashes(tree).count() == 4  # Spark's file sources leave hidden files out
    assert not value(spark, files.accepted(F.lit('app/.env.php'), ['.php']))
    p = spark.createDataFrame([("app/a/x.php",), ("app/ab/x.php",), ("web.php",), ("app/a",)], "path string")
    assert [r.module_key for r in files.module_of(p, [("m", ["app/a"]), ("n", ["app"])]).orderBy("path").collect()] == ["m", "m", "n", "web.php"]
    table = spark.createDataFrame([("m", "app/a"), ("n", "app")], "module_key string, prefix string")
    assert [r.module_key for r in files.module_of_rows(p, table).orderBy("path").collect()] == ["m", "m", "n", "web.php"]


def test_store_and_changes(spark, tmp_path):
    store = SnapshotStore(spark, f"file:{tmp_path}/s")
    assert store.version() == 0 and store.read("t") is None
    old = spark.createDataFrame([("a", 1, "h"), (None, 2, "i")], "k string, id int, h string")
    assert store.publish({"t": old}) == 1
    new = spark.createDataFrame([("a", 9, "z"), ("b", 3, "j"), (None, 8, "i")], "k string, id int, h string")
    assert store.publish({"t": changes.upserted(store.read("t"), new, ["k"], kept=["id"])}) == 2
    assert sorted(((r.k, r.id, r.h) for r in store.read("t").collect()), key=str) == [("a", 1, "z"), ("b", 3, "j"), (None, 2, "i")]
    assert store.lock() and not store.lock()
    store.unlock()
    assert store.lock()
    with pytest.raises(Exception):  # noqa: B017  a failing write leaves the version before
        store.publish({"t": old.withColumn("x", F.raise_error(F.lit("no")).cast("int"))})
    assert store.version() == 2 and {r.id for r in store.read("t").collect()} == {1, 2, 3}
    assert sorted(n for n in store._names("commits")) == ["1", "2"]
    with pytest.raises(RuntimeError):  # a version that another writer has committed in the meantime stays
        slow = SnapshotStore(spark, f"file:{tmp_path}/s")
        slow.version = lambda: 1
        slow.publish({"t": old})
    assert {r.id for r in store.read("t").collect()} == {1, 2, 3}
    late = SnapshotStore(spark, f"file:{tmp_path}/s", lease_seconds=-1)
    assert late.lock() and not store.lock()  # a lease that has run out is taken over
    gone = changes.missing_files(spark.createDataFrame([("app/a",), ("app/b",), ("lib/c",)], "file_path string"), spark.createDataFrame([("app/a",)], "file_path string"), ["app"])
    assert [r.file_path for r in gone.collect()] == ["app/b"]
    loops = spark.createDataFrame([("a", "a", "x", "1.00", 1), ("a", "b", "x", "0.40", 2), ("a", "b", "x", "0.90", 3)], "source_key string, target_key string, relationship string, confidence string, ord int").withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))
    assert [(r.target_key, r.ord) for r in changes.combined_edges(loops, ["ord"]).collect()] == [("b", 3)]


def test_knowledge(spark):
    at = F.lit(datetime.datetime(2024, 1, 1))
    rows = [("e", "active", datetime.datetime(2023, 1, 1), [], {}), ("h", "active", None, ["x"], {"x": "1"}), ("r", "draft", None, ["gone"], None), ("c", "active", None, ["x"], None), ("ok", "active", None, ["y"], {"y": "2"}), ("old", "archived", None, ["x"], {"x": "1"})]
    k = spark.createDataFrame(rows, "knowledge_key string, state string, expires_at timestamp, source_refs array<string>, source_hashes map<string,string>")
    ch = spark.createDataFrame([("x", "9"), ("gone", None), ("y", "2")], "node_key string, new_hash string")
    got = {r.knowledge_key: r.reason for r in knowledge.invalidated(k, ch, at).collect()}
    assert got == {"e": "expired", "h": "changed: x", "r": "removed: gone", "c": "changed without capture: x"}
    nodes = spark.createDataFrame([("x", "1"), ("y", "3")], "node_key string, content_hash string")
    assert {r.knowledge_key: r.valid for r in knowledge.usable(k, nodes, at).collect()} == {"h": True, "r": False, "c": False, "ok": False, "old": False}
    d = spark.createDataFrame([("a", "k", "t", "b", True, 1), ("b", "k", "t", "b", True, 0), ("c", "k", "t", "b", False, 2)], "knowledge_key string, kind string, title string, body string, approve boolean, proofs int")
    assert [(r.state, r.confidence) for r in knowledge.recorded(d).orderBy("knowledge_key").collect()] == [("active", 0.9), ("draft", 0.0), ("draft", 0.5)]
    assert knowledge.catalogued(k, d).count() == 2 + ("c" not in {r[0] for r in rows})


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = file_stream(spark, f"{tmp_path}/in", events.schema)
    seen = []
    for _ in range(2):
        each_new(stream, lambda df, _: seen.append(df.count()), f"{tmp_path}/cp")
    assert sum(seen) == events.count()
    q = counted_windows(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = {(r.start, r.event_type): r.n for r in counted_windows(events, "ts", "event_type").collect()}
    closed = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_cache_and_versions(spark):
    from codeweft.operators import cache

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = spark.createDataFrame([("a", {"y": "1", "x": "2"}), ("b", {})], "k string, p map<string,string>")
    held = cache.entries(rows, F.col("k"), F.col("p"), at("2024-01-01"))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    assert {r.cache_key: r.payload for r in cache.hits(held, wanted).collect()} == {"a": {"x": "2", "y": "1"}, "b": {}, "c": None}
    assert cache.hits(held.withColumn("artifact_hash", F.lit("x")), wanted).where("payload is not null").count() == 0
    used = cache.touched(held, wanted.where("cache_key = 'a'"), at("2024-03-01"))
    assert [r.cache_key for r in cache.kept(used, at("2024-03-10")).collect()] == ["a"]
    again = cache.put(used, cache.entries(rows.limit(1).withColumn("p", F.create_map(F.lit("z"), F.lit("9"))), F.col("k"), F.col("p"), at("2024-04-01")))
    assert again.count() == 2
    k = spark.createDataFrame([("a", "stale", ["n"], {"n": "old"}), ("b", "stale", ["n", "gone"], None)], "knowledge_key string, state string, source_refs array<string>, source_hashes map<string,string>")
    nodes = spark.createDataFrame([("n", "new")], "node_key string, content_hash string")
    got = {r.knowledge_key: (r.state, r.source_hashes) for r in knowledge.reaffirmed(k, nodes, ["a", "b"]).collect()}
    assert got == {"a": ("active", {"n": "new"}), "b": ("stale", None)}
    some = search.limited(spark.range(3), ["id"], 5).collect()
    assert [r.truncated for r in some] == [False] * 3


def test_routes_and_semantics_of_odd_files(spark):
    odd = [("a.php", None), ("b.php", ""), ("c.php", "Route::"), ("d.php", "<?php Route::get('/x'"), ("e.php", "<?php\n// Route::get('/no', X::class);\nMyRoute::get('/no', X::class);\nRoute::get('/yes', X::class);Route::get('/yes', X::class);"), ("f.php", "<?php Route::prefix('a')->group(function () { Route::get('/open', [X::class, 'y']);")]
    files = spark.createDataFrame(odd, "path string, text string")
    # the same statement twice stays twice; one that isn't closed has no arguments to read, a group that isn't holds all that follows
    assert sorted((r.path, r.uri, r.target) for r in routing.route_table(files).collect()) == [("e.php", "yes", "X::__invoke")] * 2 + [("f.php", "a/open", "X::y")]
    nodes, edges = routing.route_graph(files)
    assert nodes.count() == 2 and edges.count() == 3
    assert semantics.semantic_edges(files).count() == 0 and semantics.class_facts(files).count() == 0
    twice = "<?php\nclass A extends \\Illuminate\\Database\\Eloquent\\Model\n{\n public function r() { return $this->hasOne(B::class); }\n public function r() { return $this->hasOne(C::class); }\n}\n"
    one = semantics.class_facts(spark.createDataFrame([("a.php", twice)], "path string, text string")).first()
    assert one.relations == {"r": "C"} and one.accessors == [] and one.casts == {}


def test_source_graph_dispatch(spark):
    nodes, edges = source_graph(spark.createDataFrame(sample_sources.FILES, "path string, text string"))
    kinds = {(r.node_type, r.node_key) for r in nodes.select("node_type", "node_key").collect()}
    assert {("route", "route:home"), ("blade_view", "view:pages.about"), ("blade_component", "component:forms.field"), ("file", "file:empty.php")} <= kinds
    assert not any(k.startswith("file:resources/") for _, k in kinds)
    relationships = {r.relationship for r in edges.select("relationship").distinct().collect()}
    assert {"binds", "observes", "listens_to_event", "uses_middleware", "renders_view", "uses_component", "references_route", "uses_model", "calls", "contains"} <= relationships


def test_task_words_end_where_sql_ends_them(spark, tmp_path):
    odd = ["ñdocs x", "theó docs", "mañadd Xéa", "a\x0bapp/x", "Fix ñName", "read a\rsource b", "read a\nsource b", "open   the file", "addY Xé", "éAdd Orderé", " \x0b fix Order", "ñapp/é", None, ""]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(odd)], "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, str(tmp_path), queries.QUERIES["route_task"], queries.ORACLES["route_task"]) == len(odd)


def test_quotes_and_groups_are_looked_at_once(spark):
    many = "f('(' . 'x') " * 20000
    start = time.monotonic()
    got = spark.createDataFrame([(many,)], "t string").select(extract.without_quoted_parentheses(F.col("t")).alias("t")).first().t
    assert got == many.replace("'('", "'\x01'") and time.monotonic() - start < 20
    rows = spark.range(3).select(F.col("id").alias("s_suppkey")).coalesce(1)
    assert source_queries.for_each(rows, "s_suppkey", sample_sources.FILES).rdd.getNumPartitions() == 8
    group = "<?php\nuse App\\A;\n" + "Route::prefix('a')->group(function () {\n" * 3 + "Route::get('/x(', [A::class, 'y']);\n" + "});\n" * 3 + "Route::get('/z', 'A@y');\n"
    found = routing.route_table(spark.createDataFrame([("r.php", group)], "path string, text string")).collect()
    assert sorted((r.uri, r.target) for r in found) == [("a/a/a/x(", "App\\A::y"), ("z", "A::y")]
