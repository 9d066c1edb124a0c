import random

import pytest
from pyspark.sql import functions as F

from codeweft.functions.text import canonical_text
from codeweft.operators import graph, postings, reports, search
from codeweft.operators.lineage import cut
from codeweft.plans import questions, retrieve
from codeweft.queries import memory

SF = "/root/testdata/sf0.001"
FIELDS = ("header", "ids", "text", "used", "estimated_tokens", "warnings", "stale", "truncated", "candidate_count", "selected_count", "omitted_count", "compacted_count", "truncation_reasons")


def by_ones(m, asked, **more):
    """The packets of single questions; max_nodes is asked of impact analyses alone."""
    name = {"symbol_lookup": "symbol", "impact_analysis": "target"}
    rows = {q: retrieve.retrieve(m, op, **{name[op]: what}, **more).first() for q, op, what in asked}
    return {q: tuple(r[f] for f in FIELDS) for q, r in rows.items()}


def by_many(spark, m, asked, index=None, **more):
    packets, sources = questions.answered(m, spark.createDataFrame(asked, questions.QUESTION), index=index, **more)
    shown = {}
    for r in sources.orderBy("question", "position").collect():
        shown.setdefault(r["question"], []).append(r["id"])
    got = {r["question"]: tuple(r[f] for f in FIELDS) for r in packets.collect()}
    assert {q: list(p[1]) for q, p in got.items() if p[1]} == shown
    return got


def assert_same(many, ones):
    assert many.keys() == ones.keys()
    for q in ones:
        for f, a, b in zip(FIELDS, many[q], ones[q], strict=True):
            assert a == b, (q, f)


def test_many_answers_equal_single_ones(spark):
    m = memory(spark, SF)
    asked = [("b", "symbol_lookup", " \\nation:3 "), ("c", "symbol_lookup", "small ring"), ("d", "symbol_lookup", "nobody"), ("g", "impact_analysis", "nation:3"), ("h", "impact_analysis", "AMERICA"), ("i", "impact_analysis", "small ring")]
    assert_same(by_many(spark, m, asked, budget=300, max_nodes=5), by_ones(m, asked, budget=300, max_nodes=5))
    other = by_many(spark, m, [("x", "poetry", "y"), ("n", "symbol_lookup", None)])
    assert other["x"][5] == ["Questions by the many are lookups and impact analyses, not [poetry]."] and "non-empty" in other["n"][5][0]
    assert by_many(spark, m, []) == {}


@pytest.fixture(scope="module")
def small(spark):
    node = lambda key, kind, name, path: (key, kind, name, path, "m", "h-" + (path or ""))
    rows = [
        node("class:A", "class", "A", "a.php"), node("method:A::run", "method", "A::run", "a.php"), node("class:B", "class", "B", "b.php"), node("method:B::go", "method", "B::go", "b.php"), node("class:C", "class", "C", "c.php"),
        node("view:x", "blade_view", "x", "x.blade.php"), node("view:y", "blade_view", "y", "y.blade.php"), node("view:z", "blade_view", "z", "z.blade.php"), node("file:a.php", "file", "a.php", "a.php"), node("class:Gone", "class", "Gone", None),
    ]
    n = spark.createDataFrame(rows, "node_key string, node_type string, symbol_name string, file_path string, module_key string, content_hash string").withColumn("stub", F.col("file_path").isNull())
    links = [
        ("class:A", "method:A::run", "contains", "1"), ("class:B", "method:B::go", "contains", "1"), ("class:B", "class:A", "extends", "0.95"), ("class:C", "class:B", "extends", "0.95"), ("method:B::go", "method:A::run", "calls", "0.75"),
        ("method:A::run", "class:Gone", "depends_on", "0.9"), ("method:A::run", "view:x", "renders_view", "0.9"), ("view:x", "view:y", "uses_component", "0.9"), ("view:y", "view:z", "renders_view", "0.9"), ("view:z", "view:x", "renders_view", "0.9"),
    ]
    e = spark.createDataFrame(links, "source_key string, target_key string, relationship string, confidence string").withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))
    live = spark.createDataFrame([(p, "h-" + p if p != "b.php" else "new") for p in ("a.php", "b.php", "c.php", "x.blade.php", "y.blade.php", "z.blade.php")], "path string, live_hash string")
    return retrieve.Memory(cut(n.coalesce(1)), cut(e.coalesce(1)), live=cut(live.coalesce(1)))


def test_stale_sources_methods_and_views(spark, small):
    asked = [("1", "symbol_lookup", "method:A::run"), ("2", "symbol_lookup", "class:B"), ("3", "symbol_lookup", "x"), ("4", "impact_analysis", "class:A"), ("5", "impact_analysis", "class:B"), ("6", "impact_analysis", "a.php"), ("7", "symbol_lookup", "class:Gone")]
    assert_same(by_many(spark, small, asked), by_ones(small, asked))
    some = [a for a in asked if a[0] in "25"]
    assert_same(by_many(spark, small, some, include_stale=True), by_ones(small, some, include_stale=True))


def test_names_that_match_in_part(spark, small):
    index = postings.postings(small.nodes)
    asked = [("1", "symbol_lookup", "::"), ("2", "symbol_lookup", "gO"), ("3", "impact_analysis", "::R"), ("4", "impact_analysis", "::")]
    assert_same(by_many(spark, small, asked, index), by_ones(small, asked))


def test_index_tells_what_a_scan_tells(spark):
    names = ["", None, "a", "ab", "abc", "abcabc", "abcdabcd", "ABCdef", "aaaaaa", "größer-als", "xabxcab", "日本語テキスト", "abcab"]
    nodes = spark.createDataFrame([(f"k{i}", a, b) for i, (a, b) in enumerate((a, b) for a in names for b in (None, "abc/def", a))], "node_key string, symbol_name string, file_path string")
    index = postings.postings(nodes)
    words = ["a", "ab", "abc", "abca", "abcabc", "aaa", "aaaa", "bcd", "größer", "ß", "本語", "本語テキ", "zzz", "", "c/d", "dabcd"]
    got = {tuple(r) for r in postings.containing(index, spark.createDataFrame([(w,) for w in [*words, "ab"]], "word string")).collect()}
    want = {(w, f, r["node_key"]) for r in nodes.collect() for f in ("symbol_name", "file_path") for w in words if w and w in (r[f] or "").lower()}
    assert got == want
    for some in (["abc", "a"], ["größer", "日"], ["zzz"], [""], ["ab", "ab"]):
        asked = [w for w in dict.fromkeys(some) if w]
        score = lambda r: sum(n for w in asked for f, n in search.WEIGHTS.items() if f in r and w in (r[f] or "").lower())  # noqa: B023, E731
        want = sorted(((-score(r.asDict()), r["node_key"]) for r in nodes.collect() if score(r.asDict())))[:7]
        assert [(-r["score"], r["node_key"]) for r in postings.indexed_top(index, some, 7).collect()] == want
    assert postings.containing(postings.postings(nodes.limit(0)), spark.createDataFrame([("a",)], "word string")).count() == 0


def test_canonical_text(spark):
    rows = [('{"b": 1.50, "a": {"d": [3, {"z": null, "y": "ü"}], "c": true}}', '{"a":{"c":true,"d":[3,{"y":"ü","z":null}]},"b":1.5}'), ("[ ]", "[]"), ('{"a":1,"a":2}', None), ("{", None), (None, None), ('"x"', '"x"')]
    got = spark.createDataFrame(rows, "j string, want string").select(canonical_text(F.col("j")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_items_that_occur_once_are_not_written_again(spark, monkeypatch):
    written = []

    def noted(df, *more):
        out = cut(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(search, "cut", noted)
    items = cut(spark.range(2000).select((F.col("id") % 50).alias("packet"), F.col("id").cast("string").alias("id"), F.lit(1).alias("score"), F.concat(F.lit("text "), F.col("id")).alias("text")))
    assert search.deduplicated(items, "packet").count() == 2000 and sum(written) == 0
    twice = cut(items.union(items.where("packet = 7")).union(items.where("packet = 8").withColumn("id", F.lit("x"))))
    once = search.deduplicated(twice, "packet")
    assert once.count() == 2000 and once.where("packet = 7").count() == 40 and once.where("packet = 8").select("text").distinct().count() == 40


def test_rows_that_touch_keys(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("at"), "id")
    near = graph.touching(rows, "at", keys, "k")
    assert near.columns == ["at", "id"] and {r.id for r in near.where("id % 3 = 0").collect()} == set(range(0, 3000, 3)) and near.count() < 1020
    assert graph.touching(rows, "at", keys.limit(0), "k").isEmpty()


def test_postings_tell_what_is_new_in_a_field(spark):
    nodes = spark.createDataFrame([("k", "abcab", None), ("l", "aaaa", "xa")], "node_key string, symbol_name string, file_path string")
    index = postings.postings(nodes)
    got = {(r.node_key, r.field, r.place): (r.gram, r.after, r["first"]) for r in index.collect()}
    assert [got["k", "symbol_name", p] for p in range(1, 6)] == [("abc", "ab", 1), ("bca", "b", 1), ("cab", "", 1), ("ab", "", 4), ("b", "", 4)]
    assert [got["l", "symbol_name", p][2] for p in range(1, 5)] == [1, 4, 4, 4] and got["l", "file_path", 2] == ("a", "", 1)
    words = spark.createDataFrame([(w,) for w in ("a", "ab", "aa", "aaa", "aaaa", "abca", "cab", "b")], "word string")
    rows = sorted(tuple(r) for r in postings.containing(index, words).collect())
    assert rows == sorted([(w, "symbol_name", "k") for w in ("a", "ab", "abca", "cab", "b")] + [(w, "symbol_name", "l") for w in ("a", "aa", "aaa", "aaaa")] + [("a", "file_path", "l")])


def test_words_are_looked_up_in_different_texts_once(spark, monkeypatch):
    dice = random.Random(5)
    wild = lambda n, of="ab]^-\\&[x0 12\n\U0001f600.": "".join(dice.choice(of) for _ in range(n))
    rows = [(f"k{i}", None if i % 7 == 0 else wild(i % 23), None if i % 5 == 0 else f"region-{i}/nation-{i % 3}/" + wild(i % 9)) for i in range(300)]
    words = [*{wild(n) for n in range(1, 9) for _ in range(6)}, "nation-1", "on-", "7", "no such word", "n" * 9, ""]
    nodes = spark.createDataFrame(rows, "node_key string, symbol_name string, file_path string")
    asked = spark.createDataFrame([(w,) for w in [*words, "7"]], "word string")
    want = set()
    for at, field in ((1, "symbol_name"), (2, "file_path")):
        for w in words:
            held = [r[0] for r in rows if w and r[at] is not None and w in r[at]]
            want |= {(w, field, len(held), min(held))} if held else set()
    shown = lambda: {(r.word, r.field, r.n, r.first) for r in postings.counted(nodes, asked).collect()}
    assert shown() == want
    monkeypatch.setattr(postings, "MOST_GRAMS", 3)
    assert shown() == want
    monkeypatch.undo()
    assert postings.counted(nodes, asked.limit(0)).count() == 0
    # what no word can stand in tells no nodes apart: two texts, not 3,000
    seen = []
    monkeypatch.setattr(postings, "postings", lambda n, whole=postings.postings: seen.append(n.count()) or whole(n))
    many = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("node_key"), F.concat(F.lit("Order-"), "id").alias("symbol_name"), F.concat(F.lit("nation-"), F.col("id") % 2, F.lit("/order-"), "id").alias("file_path"))
    got = sorted(tuple(r) for r in postings.counted(many, spark.createDataFrame([("nation-1",), ("order",)], "word string")).collect())
    assert got == [("nation-1", "file_path", 1500, "k1"), ("order", "file_path", 3000, "k0"), ("order", "symbol_name", 3000, "k0")] and seen == [2]


def test_packets_that_fit_whole_equal_the_fold(spark):
    # sizes 10, 20 and 30 with a header of 8 bytes: 8 + 11 + 21 + 31 = 71 bytes; budgets in bytes around that
    rows = [("p", f"i{n}", 9 - n, "x" * n * 10, "y" * n, f"c{n}") for n in (1, 2, 3)] + [("q", "i0", 1, "", None, "c"), ("q", "i1", 0, "abc", None, "d"), ("r", "i1", 1, None, None, "e")]
    items = spark.createDataFrame(rows, "packet string, id string, score int, text string, compact string, more string")
    for room, want in ((71, (71, [("i1", False, "c1"), ("i2", False, "c2"), ("i3", False, "c3")], 0)), (70, (44, [("i1", False, "c1"), ("i2", False, "c2"), ("i3", True, "c3")], 0)), (1000, (71, [("i1", False, "c1"), ("i2", False, "c2"), ("i3", False, "c3")], 0))):
        got = {r.packet: (r.used, [(t.id, t.compact, t.more) for t in r.taken], r.omitted) for r in search.folded(items, "packet", "8 bytes.", room, 1, carried=("more",)).collect()}
        assert got["p"] == want and got["q"] == (12, [("i1", False, "d")], 1) and got["r"] == (8, [], 1), (room, got)
    assert search.folded(items.where("packet = 'q' and id = 'i1'"), "packet", "", 50, 1).first().used == 3


def test_packets_are_judged_as_their_rows(spark):
    dice = random.Random(11)
    names = ["a", "A\\b", "a/b", "b::c", "x/b", "c", "", None, "a::d", "A"]
    packets = [(f"s{i}", [[dice.choice(names) for _ in range(dice.randrange(4))] for _ in range(dice.randrange(12))]) for i in range(60)]
    expected = [(f"s{dice.randrange(62)}", dice.choice(["a", "b", "A/b", "c", "zz", "b::c"])) for _ in range(90)]
    frame = spark.createDataFrame(packets, "scenario string, identities array<array<string>>")
    wanted = spark.createDataFrame(expected, "scenario string, item string")
    each = frame.select("scenario", F.posexplode("identities").alias("at", "i")).select("scenario", (F.col("at") + 1).alias("position"), F.explode("i").alias("identity"))
    for k in (1, 3, 8):
        want = sorted(tuple(r) for r in reports.evaluated(each, wanted, k).collect())
        assert sorted(tuple(r) for r in reports.evaluated_packets(frame, wanted, k).collect()) == want and len(want) > 40


def test_edges_of_other_kinds_are_not_made(spark):
    made = spark.range(100).groupBy((F.col("id") % 10).alias("g")).agg(F.max("id").alias("n")).select(F.concat(F.lit("part:"), "g").alias("target_key"), "n")
    made = made.unionByName(spark.range(5).select(F.concat(F.lit("order:"), "id").alias("target_key"), F.col("id").alias("n")))
    keys = spark.createDataFrame([("order:3",), ("order:9",), (None,)], "k string")
    near = graph.of_kinds(made, "target_key", keys, "k")
    assert sorted(r.n for r in near.collect()) == [0, 1, 2, 3, 4]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x or "Aggregate" in x]
    assert not any("Aggregate" in x for x in filters) or plan.index("Aggregate") < plan.rindex("Filter")  # below what rows are made of, or gone with it
    many = spark.range(200).select(F.concat(F.lit("k"), "id", F.lit(":x")).alias("k"))
    assert graph.of_kinds(made, "target_key", many, "k").count() == 15 and graph.of_kinds(made, "target_key", keys.limit(0), "k").count() == 0


def test_texts_of_odd_blanks_are_found_alike(spark):
    alike = ["a b", " a b", "a  b", "a\tb", "a b\n", "a　b", "\x00a b", "a  b", "a\x85b\x0b"]
    rows = [("p", f"i{n:02}", 100 - n, t) for n, t in enumerate([*alike, "ab", "a c", " ", "", " "])]
    items = cut(spark.createDataFrame(rows, "packet string, id string, score int, text string"))
    from codeweft.functions.text import text_fingerprint

    prints = {r.id: r.fp for r in items.select("id", text_fingerprint(F.col("text")).alias("fp")).collect()}
    first = {}
    for r in rows:
        first.setdefault(prints[r[1]], r[1])
    assert sorted(r.id for r in search.deduplicated(items, "packet").collect()) == sorted(first.values()) and "i01" not in first.values()
