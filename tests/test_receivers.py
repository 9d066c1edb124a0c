"""Tokens, nesting, chains and types of receivers, against what the sources plainly say."""

import pytest
from pyspark.sql import functions as F

from codeweft.operators import receivers as module
from codeweft.operators import tokens
from codeweft.operators.extract import declared, methods_of
from codeweft.operators.lineage import cut, spread
from codeweft.operators.receivers import receiver_edges, receivers, units_of, unresolved_calls
from codeweft.operators.semantics import semantic_edges

FLOW = r"""<?php
namespace App;
use App\Models\{User, Order as Bill};
class Flow extends Base
{
    private Mailer $mailer;
    public function __construct(private ?Clock $clock, int $n) { $this->mailer->send(1); $this->clock->now(); $this->nothing->lost(); }
    public function straight(Bill $bill, int|Bill $either, $free)
    {
        $bill->pay(); $either->lost(); $free->lost(); $this->own();
        $a = new User('x // y', "( $"); /* $a = new Wrong; */ $a->save(); // $a->lost()
        $b = $a; $b->copied(); $a = $b->made(); $a->lost();
        $c = $d = new User; $d->deep(); $c->lost();
        $e = app(Mailer::class); $e->send(); resolve(Mailer::class)->again();
        (new User(1, [2, 3]))->once(); $f = (new User); $f->twice();
        $g = new self; $g->mine(); $h = new parent(); $h->above(); $h .= 'x'; $h->lost();
        $i = &$b; $i->lost(); $j = $b ?? null; $j->lost(); $k = $this; $k->me(); unset($k); $k->lost();
        $m = $b; $n = $m; $o = $n; $o->far();
        foo($p = new User, 2); $p->kept(); $b?->safe(); $b->{$name}(); $b->one()->lost();
    }
    public function branches(User $u, User $w, User $z)
    {
        if ($u->test()) { $u = new Bill; $u->inside(); $v = new User; } else { $u->other(); }
        $u->lost(); $v->lost();
        if (1) { $w = new User; } elseif (2) { $w = new User(2); }
        $w->agreed();
        foreach ($z as $x) { $z->each(); $x->lost(); $z = new Bill; }
        $z->lost();
        $q = new Bill; try { $q = new User; } catch (E $e) { $q->before(); } finally { $q->finally(); }
        $q->lost();
        if (1) $r = new User; $r->lost();
        $s = new User; if (1) $s->loose(); else $s = new User; $s->same();
        if (1) { if (2) { $s = new Bill; } $s->lost(); } $s->lost();
    }
    public function closures(User $u)
    {
        $t = new Bill;
        $f = function (Bill $u, $n) use ($t) { $u->param(); $t->caught(); $n->lost(); $i = new User; $i->inner(); $t = new User; };
        $u->outer(); $t->still(); $i->lost();
        $g = fn ($u) => $u->lost(); $u->back(); $h = fn () => $t->seen();
        $k = function () { $t->lost(); return function (Bill $b) { $b->nested(); }; };
    }
}
"""
WANT = {
    "__construct": {"send": "App\\Mailer", "now": "App\\Clock"},
    "straight": {
        "pay": "App\\Models\\Order", "own": "App\\Flow", "save": "App\\Models\\User", "copied": "App\\Models\\User", "made": "App\\Models\\User", "deep": "App\\Models\\User", "send": "App\\Mailer", "again": "App\\Mailer",
        "once": "App\\Models\\User", "twice": "App\\Models\\User", "mine": "App\\Flow", "above": "App\\Base", "me": "App\\Flow", "far": "App\\Models\\User", "kept": "App\\Models\\User", "safe": "App\\Models\\User", "one": "App\\Models\\User",
    },
    "branches": {
        "test": "App\\Models\\User", "inside": "App\\Models\\Order", "other": "App\\Models\\User", "agreed": "App\\Models\\User", "each": "App\\Models\\User", "before": "App\\Models\\Order", "finally": "App\\Models\\Order",
        "loose": "App\\Models\\User", "same": "App\\Models\\User",
    },
    "closures": {"param": "App\\Models\\Order", "caught": "App\\Models\\Order", "inner": "App\\Models\\User", "outer": "App\\Models\\User", "still": "App\\Models\\Order", "back": "App\\Models\\User", "seen": "App\\Models\\Order", "nested": "App\\Models\\Order"},
}
FLUENT = r"""<?php
namespace App\Models;
use Illuminate\Database\Eloquent\Model;
class Post extends Model
{
    public function notes() { return $this->hasMany(Note::class); }
    public function go()
    {
        $this->notes()->where('a', 1)->first();
        $q = Post::where('a', 1)->orderBy('b'); $q->limit(2)->get()->map(3); $r = $q->take(1); $r->count();
        $all = Post::with('x')->get(); $all->filter(); Post::make()->lost(); Other::where(1)->lost();
    }
}
"""


def test_tokens_tell_code_from_strings_and_comments(spark):
    code = "$c = 'x // y'; C::run(); # no\n/* no ' */ $d->e(\"a(\\\"b\", 'it''s'); #[Attr]\n// it's no\n\\A\\B::class ?-> ... /* open"
    rows = tokens.tokens(spark.createDataFrame([("u", code), ("v", ""), ("w", None)], "unit string, text string")).where("unit = 'u'").orderBy("i").collect()
    assert [r.t for r in rows] == ["$c", "=", "'x // y'", ";", "C", "::", "run", "(", ")", ";", "$d", "->", "e", "(", '"a(\\"b"', ",", "'it'", "'s'", ")", ";", "#", "[", "Attr", "]", "\\A\\B", "::", "class", "?->", "..."]


def test_brackets_are_matched_by_running_depth(spark):
    import random

    dice = random.Random(3)

    def wild(n):
        out, open_ = [], []
        for _ in range(n):
            k = dice.random()
            if k < 0.3:
                open_.append(dice.choice("([{"))
                out.append(open_[-1])
            elif k < 0.6 and open_:
                out.append({"(": ")", "[": "]", "{": "}"}[open_.pop()])
            else:
                out.append(dice.choice(["$a", "b", "->", ";"]))
        return out + [{"(": ")", "[": "]", "{": "}"}[b] for b in reversed(open_)]

    texts = {f"u{k}": wild(k * 7) for k in range(12)} | {"deep": ["("] * 3000 + [")"] * 3000}
    got = tokens.nested(tokens.tokens(spark.createDataFrame([(u, " ".join(t)) for u, t in texts.items()], "unit string, text string"))).collect()
    by = {(r.unit, r.i): (r.g, r.pair) for r in got}
    for u, ts in texts.items():
        open_, pair, g = [], {}, {}
        for i, t in enumerate(ts):
            if t in ")]}":
                j = open_.pop()
                pair[i], pair[j] = j, i
            g[i] = open_[-1] if open_ else -1
            if t in "([{":
                open_.append(i)
        for i in range(len(ts)):
            assert by[u, i] == (g[i], pair.get(i)), (u, i)


def test_types_flow_through_code(spark):
    files = spark.createDataFrame([("a.php", FLOW)], "path string, text string")
    units = units_of(files)
    got = {}
    for r in receivers(units).join(units.select("unit", "method"), "unit").collect():
        got.setdefault(r.method, {}).setdefault(r.name, set()).add(r.type)
    for method, want in WANT.items():
        assert {n: t for n, t in got[method].items() if n != "lost"} == {n: {t} for n, t in want.items()}, method
        assert got[method].get("lost", {None}) == {None}, method
    open_ = {r.method_key.split("::")[1]: r.unresolved for r in unresolved_calls(files).collect()}
    assert open_["__construct"] == 1 and open_["closures"] == 4


def test_chains_of_query_calls(spark):
    files = spark.createDataFrame([("p.php", FLUENT)], "path string, text string")
    units = units_of(files)
    models = spark.createDataFrame([("App\\Models\\Post",)], "fqcn string")
    got = {}
    for r in receivers(units, models).collect():
        got.setdefault(r.name, set()).add((r.type or "").split("\\")[-1])
    assert got == {"hasMany": {"Post"}, "notes": {"Post"}, "where": {"Relation"}, "first": {"Relation"}, "orderBy": {"Builder"}, "limit": {"Builder"}, "get": {"Builder"}, "map": {"Collection"}, "take": {"Builder"}, "count": {"Builder"}, "filter": {"Collection"}, "lost": {""}}
    edges = {(r.target_key, r.resolution) for r in receiver_edges(files).collect()}
    assert ("method:Illuminate\\Database\\Eloquent\\Builder::limit", "framework_type") in edges and ("method:App\\Models\\Post::notes", None) in edges


@pytest.mark.parametrize("text", ["", "<?php\nclass A {\n function f() { $h = fn ($x) => $x->y(1", "<?php\nclass A {\n function f() { $h = function ($x) use (", "<?php", "<?php class A { function f() { ((( $x->y( } }", "<?php class A { function f() { if else } ] ) $x = ; $x->y(); } }"])
def test_odd_sources(spark, text):
    files = spark.createDataFrame([("a.php", text), ("b.php", None)], "path string, text string")
    assert receiver_edges(files).count() == 0


def test_a_long_method(spark):
    body = "".join(f"$v{i % 50} = {'new A' if i % 7 == 0 else f'$v{(i - 1) % 50}'}; if ($v{i % 50}->go{i}()) {{ $v{i % 50}->in{i}(); }}\n" for i in range(3000))
    files = spark.createDataFrame([("a.php", f"<?php\nclass B {{\n public function f() {{ {body} }}\n}}\n")], "path string, text string")
    assert receivers(units_of(files)).where(F.col("type") == "A").count() == 6000


def test_compact_tables_are_not_broadcast(spark):
    alike = spark.range(5000).select("id", F.repeat(F.lit("x"), 500).alias("text"))  # some KB as files
    joined = lambda t: spark.range(1 << 20).join(t, "id")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in joined(cut(alike)) and "Broadcast" not in joined(cut(alike, compact=True))
    assert "BroadcastHashJoin" in joined(cut(alike.limit(5), compact=True))
    assert "hint" in module.cut(alike)._jdf.queryExecution().analyzed().toString().lower()


def test_patterns_are_matched_by_all_tasks(spark, tmp_path):
    spark.range(40).coalesce(1).write.parquet(f"file:{tmp_path}/k")
    files = spread(spark.read.parquet(f"file:{tmp_path}/k")).select(F.concat(F.lit("app/A"), "id", F.lit(".php")).alias("path"), F.concat(F.lit("<?php\nclass A"), "id", F.lit(" {\n function f() { return 1; }\n}\n")).alias("text"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = declared(files)
    # nothing is matched twice, beforehand, and nothing on the other side of a shuffle that deals rows out
    assert "Repartition" not in plan(found) and "size(heads" not in plan(found) and "size(heads" not in plan(methods_of(cut(found)))
    assert found.count() == 40 and methods_of(found).select("method").distinct().count() == 1


def test_tokens_are_not_shuffled(spark):
    units = cut(spark.range(3000).select(F.col("id").alias("unit"), F.lit("($a) { $b->c($a, [1]); }").alias("text")))
    plan = tokens.around(tokens.chains(tokens.nested(tokens.tokens(tokens.dealt(units)))))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1 and initial.index("Generate posexplode") < initial.index("Exchange")  # plans are printed from their end


def test_units_are_numbered(spark):
    twice = "<?php\nif (1) {\nclass A {\n function f(B $b) { $b->one(); }\n}\n} else {\nclass A {\n function f(C $c) { $c->two(); }\n}\n}\n"
    files = spark.createDataFrame([("a.php", twice)], "path string, text string")  # two methods of one name, path and place
    assert sorted((r.source_key, r.target_key) for r in receiver_edges(files).collect()) == [("method:A::f", "method:B::one"), ("method:A::f", "method:C::two")]


def test_what_is_absent_costs_no_sorts_and_no_patterns(spark):
    units = cut(spark.range(30).select(F.col("id").alias("unit"), F.lit("($a) { $b->c($a, [1]); }").alias("text")))
    plan = tokens.around(tokens.chains(tokens.nested(tokens.tokens(tokens.dealt(units)))))._jdf.queryExecution().executedPlan().toString()
    assert "DESC" not in plan  # what comes next is found in the order of what came before
    code = "<?php\nclass A {\n function f() { User::observe(B::class); Event::listen(C::class, D::class); $this->app->bind(E::class, F::class); }\n}\nclass G { }\n"
    files = spark.createDataFrame([("a.php", code)], "path string, text string")
    edges = semantic_edges(files)
    assert sorted((r.source_key, r.target_key, r.relationship) for r in edges.collect()) == [("class:B", "class:User", "observes"), ("class:D", "class:C", "listens_to_event"), ("class:E", "class:F", "binds"), ("method:A::f", "class:F", "binds")]
    # keys are brought to length once, after rows are made, not within what makes them
    made = [x for x in edges._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert made and not any("octet_length" in x for x in made)


def test_methods_that_are_alike_are_looked_at_once(spark, monkeypatch):
    body = "private self $me;\n private {T} $kept;\n public function go({T} $b, $free) { $this->mine(); $x = new self; $x->made(); self::own(); static::late(); event(new self); app(self::class)->got(); help($x); $b->given(); $this->kept->held(); $this->me->again(); $y = $free ? 1 : 2; $z = new {T}; if ($y) { $z = new {T}; } else { $z = new self; } $z->both(); $free->lost(); }\n public function back() { return $this->hasMany(Note::class); }\n public function all() { $this->back()->where(1)->get()->map(2); self::where(3)->limit(4); }\n"
    made = [
        *((f"s/P{i}.php", f"<?php\nnamespace App;\nclass P{i} extends Base {{\n {body.replace('{T}', 'Thing')}}}\n") for i in range(6)),
        ("named.php", f"<?php\nnamespace App;\nclass Thing extends Base {{\n {body.replace('{T}', 'Thing')}}}\n"),  # the text names the class
        ("aliased.php", f"<?php\nnamespace App;\nuse App\\Q as Thing;\nclass Q extends Base {{\n {body.replace('{T}', 'Thing')}}}\n"),
        ("relation.php", f"<?php\nnamespace App;\nclass Relation extends Base {{\n {body.replace('{T}', 'Thing')}}}\n"),
        ("model.php", f"<?php\nnamespace App;\nuse Illuminate\\Database\\Eloquent\\Model;\nclass M1 extends Model {{\n {body.replace('{T}', 'Thing')}}}\n"),
        ("other.php", f"<?php\nnamespace Elsewhere;\nclass P1 extends Base {{\n {body.replace('{T}', 'Thing')}}}\n"),
    ]
    files = spark.createDataFrame(made, "path string, text string")
    seen, events = [], module.events_of
    monkeypatch.setattr(module, "events_of", lambda units, models=None: seen.append(units.count()) or events(units, models))
    rows = lambda: [sorted(tuple(r) for r in e.collect()) for e in module.body_edges(files)] + [sorted(tuple(r) for r in unresolved_calls(files).collect())]
    got = rows()
    assert seen == [18, 18]  # three methods of each of six kinds of classes, not of eleven classes

    def apart(units, models):
        units = units.withColumn("shape", F.col("unit").cast("string"))
        return units, units

    monkeypatch.setattr(module, "shared", apart)
    assert got == rows() and seen[2:] == [33, 33]
    targets = {(r[0], r[1]) for r in got[0]}
    assert {("method:App\\P3::go", f"method:App\\P3::{m}") for m in ("mine", "made", "again")} <= targets and ("method:App\\P3::go", "method:App\\P3::both") not in targets and ("method:App\\Thing::go", "method:App\\Thing::both") in targets
    assert ("method:App\\P3::go", "method:App\\P3::own") in {(r[0], r[1]) for r in got[1]}
