import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import SERVICE

from codeweft.plans import retrieve, source_graph
from codeweft.plans.demo_graph import edges, nodes
from codeweft.plans.sync import annotated_edges, graph_edges, sync
from codeweft.store import LeaseLost, Part, SnapshotStore

SF = "/root/testdata/sf0.001"
ORDER = "<?php\nnamespace App\\Models;\nclass Order\n{\n    public function total() { return 1; }\n}\n"


def test_sync(spark, tmp_path):
    store = SnapshotStore(spark, f"file:{tmp_path}/g")
    tree = lambda *f: spark.createDataFrame(list(f), "path string, text string")
    service, order = ("app/Services/OrderService.php", SERVICE), ("app/Models/Order.php", ORDER)
    first = sync(store, tree(service, order), ["app"], "full")
    assert (first.status, first.updated, first.errors) == ("completed", 2, ())
    again = sync(store, tree(service, order), ["app"])
    assert (again.updated, again.skipped) == (0, 2)
    by = {r.node_key: r for r in store.read("nodes").collect()}
    assert "method:App\\Services\\OrderService::update" in by and by["class:App\\Services\\BaseService"].stub and not by["class:App\\Models\\Order"].stub

    k = spark.createDataFrame([("k", "active", None, ["class:App\\Models\\Order"], {"class:App\\Models\\Order": by["class:App\\Models\\Order"].content_hash})], "knowledge_key string, state string, expires_at timestamp, source_refs array<string>, source_hashes map<string,string>")
    store.publish({n: store.read(n) for n in ("files", "nodes", "edges", "runs")} | {"knowledge": k})
    third = sync(store, tree(service), ["app"])  # the model's file is gone, but the service still refers to it
    assert third.deleted == 1 and third.skipped == 1
    by = {r.node_key: r for r in store.read("nodes").collect()}
    assert by["class:App\\Models\\Order"].stub and "method:App\\Models\\Order::total" not in by and "file:app/Models/Order.php" not in by
    assert store.read("knowledge").first().state == "stale"

    version = store.version()
    twice = sync(store, tree(service, ("app/Copy.php", SERVICE)), ["app"])
    assert twice.status == "failed" and twice.errors and {r.node_key for r in store.read("nodes").collect()} == set(by)
    assert store.version() == version + 1 and [r.status for r in store.read("runs").orderBy("run").collect()][-1] == "failed"
    assert store.lock() and sync(store, tree(service), ["app"]).status == "locked"


def test_identity_and_inherited_calls(spark, tmp_path):
    store = SnapshotStore(spark, f"file:{tmp_path}/i")
    source = lambda name, rest: (f"app/{name}.php", f"<?php\nnamespace App;\nclass {name} {rest}\n")
    child = source("Child", "extends Base { public function go() { return $this->run(); } }".replace("{ public", "{\n public"))
    base, other = source("Base", "{\n public function run() { return 1; }\n}"), source("Base", "{\n}")
    tree = lambda *f: spark.createDataFrame(list(f), "path string, text string")
    call = lambda: [(r.target_key, r.resolution) for r in store.read("edges").where("relationship = 'calls'").collect()]
    assert sync(store, tree(child, base), ["app"], "full", identity="here").status == "completed"
    assert call() == [("method:App\\Base::run", "inherited_method")]
    assert sync(store, tree(child), ["app"], identity="elsewhere").status == "refused" and store.version() == 1
    assert sync(store, tree(child, other), ["app"], identity="here").updated == 1  # the declaration goes, the call stays as it was written
    assert call() == [("method:App\\Child::run", None)]


def test_retrieval(spark):
    n, e = nodes(spark, SF).cache(), edges(spark, SF).cache()
    modules = spark.createDataFrame([("region-1", "AMERICA", "region-1")], "module_key string, name string, root_path string")
    changes = spark.createDataFrame([(j, f"change {j}", None, None) for j in range(15)], "id int, intent string, validation string, lessons string")
    runs = spark.createDataFrame([(1, "completed"), (2, "failed")], "run int, status string")
    moved = n.where("file_path is not null").select(F.col("file_path").alias("path"), F.when(F.col("node_key") == "customer:7", "new").otherwise(F.col("content_hash")).alias("live_hash"))
    rules = spark.createDataFrame([("r", "architectural_rule", "t", "b" * 50, "active", 0.9, None, [], None), ("s", "architectural_rule", "u", "c", "active", 0.5, None, ["gone"], None)], retrieve.KNOWLEDGE)
    m = retrieve.Memory(n, e, modules, rules, changes, runs, moved)
    top = retrieve.retrieve(m, "project_overview", 100).first()
    assert top.ids[0] == "overview-counts" and top.used <= 400 and top.estimated_tokens <= 100 and any("did not complete" in w for w in top.warnings) and top.truncated
    assert len(top.text.encode()) == top.used and top.text.startswith("project overview\n")
    mod = retrieve.retrieve(m, "module_context", module="AMERICA", query="Customer").first()
    assert mod.ids[0] == "module-header:region-1" and len(mod.ids) > 5 and mod.stale is False and mod.candidate_limit == 160
    assert retrieve.retrieve(m, "module_context", module="nowhere").first().warnings[0].startswith("No indexed module")
    s = retrieve.retrieve(m, "symbol_lookup", symbol="nation:3").first()
    assert s.ids[0] == "nation:3" and len(s.ids) > 1
    old = retrieve.retrieve(m, "symbol_lookup", symbol="customer:7").first()
    assert old.stale and old.ids == ["customer:7"] and "stale or unresolved" in old.text and any("withheld" in w for w in old.warnings)
    both = retrieve.retrieve(m, "symbol_lookup", symbol="customer:7", include_stale=True).first()
    assert len(both.ids) > 1 and "[stale graph]" in both.text
    i = retrieve.retrieve(m, "impact_analysis", target="nation:3").first()
    assert i.ids[0] == "impact-subject" and 1 < len(i.ids) <= 31
    whole = retrieve.retrieve(m, "impact_analysis", target="AMERICA", max_nodes=3).first()
    assert len(whole.ids) == 4 and "impact_traversal" in whole.truncation_reasons
    assert "Multiple symbols match" in retrieve.retrieve(m, "impact_analysis", target="CUSTOMER#").first().warnings[0]
    r = retrieve.retrieve(m, "architecture_rules").first()
    assert r.ids == ["knowledge:r"] and any("withheld" in w for w in r.warnings)
    c = retrieve.retrieve(m, "change_history", limit=5)
    assert sorted(c.first().ids) == sorted(f"change:{j}" for j in range(10, 15))
    assert retrieve.retrieve(m, "poetry").first().warnings == ["Unknown context operation [poetry]."]
    log = retrieve.telemetry(c, 12, F.lit("2024-01-01").cast("timestamp"), reported={"input": 5}).first()
    assert (log.operation, log.latency_ms, log.reported_input_tokens, log.token_basis) == ("change_history", 12, 5, "mixed")


def test_nested_views(spark):
    n = spark.createDataFrame([(f"view:{c}", "blade_view", c, f"v/{c}", None, "h") for c in "abcd"], "node_key string, node_type string, symbol_name string, file_path string, module_key string, content_hash string")
    e = spark.createDataFrame([("view:a", "view:b", "renders_view", 0.9), ("view:b", "view:c", "renders_view", 0.9), ("view:c", "view:a", "uses_component", 0.9)] + [("view:a", f"view:x{i:02d}", "renders_view", 0.9) for i in range(40)], "source_key string, target_key string, relationship string, confidence double")
    got = retrieve.view_hops(retrieve.Memory(n, e), n.where("node_key = 'view:a'"), False)
    assert {r.id: r.score for r in got.items.collect()} == {"view-hop:view:b": 162, "view-hop:view:c": 154} and got.limits == ["blade_include_hops"]


def random_tree(dice):
    """Sources whose parts hang together: classes below others, traits, calls of what they inherit, listeners that several state, tables that several
    migrations add to, models and facades."""
    out = {}
    for k in range(5):
        if dice.random() < 0.85:
            up = f" extends C{k - 1}" if k and dice.random() < 0.7 else ""
            trait = f"    use T{dice.randint(0, 1)};\n" if dice.random() < 0.4 else ""
            methods = "".join(f"    {dice.choice(['public', 'private'])} function m{j}() {{ $this->m{dice.randint(0, 3)}(); $x = new C{dice.randint(0, 5)}; $x->m{dice.randint(0, 3)}(); }}\n" for j in range(4) if dice.random() < 0.5)
            out[f"app/C{k}.php"] = f"<?php\nnamespace App;\nclass C{k}{up}\n{{\n{trait}{methods}}}\n"
    for k in range(2):
        if dice.random() < 0.8:
            out[f"app/T{k}.php"] = f"<?php\nnamespace App;\ntrait T{k}\n{{\n    public function m{dice.randint(0, 3)}() {{ return 1; }}\n}}\n"
        listen = "Event::listen(Shipped::class, Notify::class);" if dice.random() < 0.5 else ""
        out[f"app/P{k}.php"] = f"<?php\nnamespace App;\nclass P{k} extends Base\n{{\n    public function boot() {{ {listen} }}\n}}\n"
        if dice.random() < 0.7:
            out[f"database/migrations/m{k}.php"] = f"<?php\nreturn new class {{\n    public function up()\n    {{\n        Schema::table('t{dice.randint(0, 1)}', function ($t) {{ $t->string('c{dice.randint(0, 5)}'); }});\n    }}\n}};\n"
    return out


def content(store):
    nodes = {(r.node_key, None if r.stub else r.node_type, r.file_path, r.content_hash, r.stub) for r in store.read("nodes").collect()}
    edges = {(r.source_key, r.target_key, r.relationship, r.confidence, r.file_path, r.resolution, r.original_target) for r in graph_edges(store).collect()}
    others = [sorted(map(repr, store.read(t).collect())) for t in ("shared", "marks", "bindings", "files")]
    return nodes, edges, others


@pytest.mark.parametrize("seed", [3])
def test_edits_one_by_one_equal_a_full_run(spark, tmp_path, seed):
    dice = random.Random(seed)
    tree, store = {}, SnapshotStore(spark, f"file:{tmp_path}/inc", buckets=4)
    frame = lambda t: spark.createDataFrame(sorted(t.items()), "path string, text string")
    for step in range(4):
        new = random_tree(dice)
        # a few files change, come or go at a time
        for path in set(new) | set(tree):
            if step == 0 or dice.random() < 0.4:
                tree.pop(path, None)
                if path in new:
                    tree[path] = new[path]
        assert sync(store, frame(tree), ["app", "database"]).status == "completed"
    whole = SnapshotStore(spark, f"file:{tmp_path}/full", buckets=4)
    sync(whole, frame(tree), ["app", "database"], "full")
    got, want = content(store), content(whole)
    assert got[0] == want[0] and got[1] == want[1] and got[2] == want[2]
    assert any(e[5] == "inherited_method" for e in got[1])
    assert annotated_edges(store).count() == len(got[1])


def test_an_edit_writes_the_buckets_that_it_touches(spark, tmp_path):
    store = SnapshotStore(spark, f"file:{tmp_path}/b", buckets=8)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    store.publish({"t": Part(rows, F.col("k"), ())})
    before = store.manifest()["t"]["parts"]
    bucket = int(next(iter(before)))
    changed = rows.withColumn("v", F.when(F.pmod(F.xxhash64("k"), F.lit(8)) == bucket, 1).otherwise(0))
    store.publish({"t": Part(changed, F.col("k"), (bucket,))})
    after = store.manifest()["t"]["parts"]
    assert {b for b in after if after[b] != before[b]} == {str(bucket)} and len(after) == 8
    assert store.read("t").count() == 1000 and store.read("t", (bucket,)).where("v = 1").count() == store.read("t").where("v = 1").count() > 0
    other = SnapshotStore(spark, f"file:{tmp_path}/b", buckets=5)  # another number of buckets: written whole
    other.publish({"t": Part(other.read("t"), F.col("k"), (0,))})
    assert other.read("t").count() == 1000 and len(other.manifest()["t"]["parts"]) == 5


def test_a_lease_that_was_taken_over_neither_commits_nor_unlocks(spark, tmp_path):
    one, two = (SnapshotStore(spark, f"file:{tmp_path}/l", lease_seconds=1) for _ in range(2))
    t = spark.createDataFrame([(1,)], "k int")
    assert one.lock() and not two.lock()
    time.sleep(1.5)
    assert two.lock() and not one.holds()
    with pytest.raises(LeaseLost):
        one.publish({"t": t})
    one.unlock()
    assert one.version() == 0 and two._fs().exists(two._path("LOCK"))
    two.unlock()
    assert not two._fs().exists(two._path("LOCK"))
    slow = SnapshotStore(spark, f"file:{tmp_path}/l")
    assert slow.lock()
    other = SnapshotStore(spark, f"file:{tmp_path}/l")
    other.publish({"t": t}, base=0)
    with pytest.raises(RuntimeError):  # what was read as version 0 is no longer the latest
        slow.publish({"t": t}, base=0)
    assert slow._made("claims/2", "a writer that died") and slow.publish({"t": t}) == 3 and slow.read("t").count() == 1


def test_changed_files_are_read_by_all_tasks(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def read_files(files):
        raise Seen(files.rdd.getNumPartitions())

    monkeypatch.setattr(source_graph, "read_files", read_files)
    few = spark.range(0, 300, 1, 1).select(F.concat(F.lit("app/A"), "id", F.lit(".php")).alias("path"), F.repeat(F.lit("// x\n"), 50).alias("text"))
    with pytest.raises(Seen) as seen:
        sync(SnapshotStore(spark, f"file:{tmp_path}/d"), few, ["app"], "full")
    assert seen.value.args[0] >= 4
