import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from codeweft.llm.jaccard_join import DEPTH, depths, first_shared_tree, least_similarity, match_depth, one_of_each, prefix, shared_depth, shared_nodes, similarity_join
from codeweft.llm.queries import op4_jaccard_join


def grams(text, n=5):
    words = (text or "").encode().split()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, threshold=0.8):
    sets = [(i, t or "", grams(t)) for i, t in rows]
    links = {i: set() for i, _ in rows}
    by = {}
    for k, (i, t, s) in enumerate(sets):
        near = {j for g in s for j in by.get(g, ())}
        for j in near:
            u = sets[j][2]
            if len(s & u) >= threshold * len(s | u) - 1e-12:
                links[i].add(sets[j][0])
                links[sets[j][0]].add(i)
        for g in s:
            by.setdefault(g, []).append(k)
    for i, t, s in sets:
        if not s:
            for j, u, _ in sets:
                if u == t and i != j:
                    links[i].add(j)
                    links[j].add(i)
    component = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = i
                todo += links[x]
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


def result(df):
    return {r.doc_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_depth():
    assert match_depth(20, 8, 0.8, 0.999) == 5 and match_depth(20, 6, 0.8, 0.999) == 5 and match_depth(1, 6, 0.1, 0.999) == 1 and match_depth(20, 6, 1.0, 0.999) == 6


def test_depths_differ_between_texts():
    t = Fraction(4, 5)
    for n in range(1, 60):  # against all set sizes and overlaps
        every = [Fraction(i, n + b - i) for b in range(1, 2 * n) for i in range(1, min(n, b) + 1)]
        assert least_similarity(n, t) == min(j for j in every if j >= t), n
    got = {n: depths(n, t, 20, 0.999) for n in (1, 4, 6, 7, 8, 50, 1000)}
    assert got[1] == (8,) and got[7][0] > got[6][0] > got[4][0] == got[50][0] == got[1000][0] == 5
    assert got[50] == got[1000] == (5,) and len(got[8]) > 1  # a text of 8 n-grams meets one of 7 at that one's depth
    for a in range(1, 120):
        for b in range(math.ceil(0.8 * a), math.floor(a / 0.8) + 1):
            meet = max(depths(a, t, 20, 0.999)[0], depths(b, t, 20, 0.999)[0])
            assert meet in depths(a, t, 20, 0.999) and meet in depths(b, t, 20, 0.999)


def test_nodes_shared_in_sorted_tries():
    rng = random.Random(7)
    labels = sorted((t, *((rng.randrange(2) << 48) | (rng.randrange(2) << 32) | (rng.randrange(2) << 16) | rng.randrange(2) for _ in range(2)), i, 0) for t in range(3) for i in range(40))
    schema = ["tree", "hi", "lo", "k1", "k2"]
    columns = dict(zip(schema, zip(*labels)))
    t = pa.table({"tree": pa.array(columns["tree"], pa.int32()), **{c: pa.array(columns[c], pa.int64()) for c in schema[1:]}, "depths": pa.array([1 << 3 | 1 << 5] * len(labels), pa.int32())})
    parts = lambda r: [(r[1] >> s) & 0xFFFF for s in (48, 32, 16, 0)] + [(r[2] >> s) & 0xFFFF for s in (48, 32, 16, 0)]
    want = {(p, r[0], r[3]) for p in (3, 5, DEPTH) for r in labels if any(q[0] == r[0] and q[3] != r[3] and parts(q)[:p] == parts(r)[:p] for q in labels)}
    for step in (1, 7, 1000):
        out = [r for b in shared_nodes(iter(t.to_batches(step))) for r in b.to_pylist()]
        got = {(r["depth"], r["tree"], r["k1"]) for r in out}
        ends = {labels[0][3], labels[-1][3]}
        assert want <= got and all(k in ends for _, _, k in got - want)
        of = {}
        for r in out:
            of.setdefault(r["node"], []).append((r["depth"], r["tree"], parts(next(x for x in labels if x[0] == r["tree"] and x[3] == r["k1"]))[: r["depth"]]))
        assert all(x == same[0] for same in of.values() for x in same) and len({str(x[0]) for x in of.values()}) == len(of)
    a, b = np.array([[1 << 48, 5]], np.uint64), np.array([[1 << 48, 7]], np.uint64)
    assert shared_depth(a, b).tolist() == [7] and shared_depth(a, a).tolist() == [8] and (prefix(a, 7) == prefix(b, 7)).all()
    assert first_shared_tree(np.r_[a, a].reshape(1, 4), np.r_[b, a].reshape(1, 4), 8).tolist() == [1]


def test_small_texts_near_each_other(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 16))]
        rows += [words, words + ["x"], ["y"] + words, words[1:], words + ["x", "z"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert result(similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chain_of_texts(spark):
    """Neighbours link, others don't; a chain is one component, and no link counts twice."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    got, want = result(similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows)
    assert got == want and {c for _, c, _ in got.values()} == {0}


def test_whole_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(op4_jaccard_join(spark, sf))
    want = brute(rows)
    assert sum(n > 0 for n, _, _ in want.values()) > 50
    assert got == want


def test_large_group_in_many_cells(spark, monkeypatch):
    import codeweft.llm.jaccard_join as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 30)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = [*base]
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    got, want = result(similarity_join(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows)
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert there > 10_000 and found >= 0.999 * there and all(got[i][0] <= want[i][0] for i in want)
    assert {c for _, c, _ in got.values()} == {c for _, c, _ in want.values()}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977} {i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, long), (8, long + " end"), (9, "a b c d e"), (10, " ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, k1 string, n_links int")
    want = brute(rows)
    want |= {1: (1, 1, True), 2: (1, 1, False)}  # null counts as empty
    assert result(similarity_join(df)) == want
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == sorted(i for i, (_, _, k) in want.items() if k)
    assert one_of_each(df).columns == df.columns
    assert similarity_join(df.limit(0)).count() == 0
    twice = df.where("doc_id = 9").union(df.where("doc_id = 9")).union(df.where("doc_id = 9").selectExpr("cast(null as long)", "text", "k1", "n_links"))
    assert sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in similarity_join(twice).collect()), key=str) == [(9, 2, 9, True), (9, 2, 9, True), (None, 2, 9, False)]


def test_one_row_of_each_component(spark):
    near = [" ".join(f"w{i}" for i in range(60)) + end for end in ("", " x", " y")]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, near[0], "a")] * 40 + [(7, near[1], "b"), (7, near[0], "b"), (None, near[2], "c")]  # repeated rows and ids
    rows += [(None, other, "a"), (None, other, "b"), (None, other + " x", "a"), (None, other, "a")]  # a group without ids
    rows += [(8, None, "a"), (None, "", "a"), (9, " ", "a"), (9, "alone", "a"), (7, "alone too", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = one_of_each(df)
    found = [tuple(r) for r in got.collect()]
    assert got.columns == df.columns and all(r in rows for r in found)
    of = lambda t: "near" if t in near else "other" if t in (other, other + " x") else t or ""
    assert sorted((of(t), i) for i, t, _ in found if i is not None) == [("", 8), (" ", 9), ("alone", 9), ("alone too", 7), ("near", 7)]
    assert [of(t) for i, t, _ in found if i is None] == ["other"]
    assert sorted(map(str, one_of_each(df.repartition(3)).collect())) == sorted(map(str, got.collect()))


def test_columns_of_any_name(spark):
    rows = [(1, "a b c", "keep0", "x", "y", "z"), (2, "a b c", "keep1", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _0 string, _1 string, _row string, _component string")
    assert [tuple(r) for r in one_of_each(df).collect()] == rows[:1]
    assert sorted(similarity_join(df, keep=("doc_id", "_0", "_component")).collect()) == [(1, "keep0", "z", 1, 1, True), (2, "keep1", "z", 1, 1, False)]
