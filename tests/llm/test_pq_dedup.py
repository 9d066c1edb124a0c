import math
import random

import numpy as np

from codeweft.llm import pq_dedup
from codeweft.llm.components import connected_components
from codeweft.llm.pq_dedup import near_duplicates
from codeweft.llm.queries import op2_pq_dedup


def brute(rows, cosine):
    """rows: (id, vector, label), ids all different."""
    sound = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, _, _ in rows}
    for n, (i, u, k) in enumerate(rows):
        for j, v, m in rows[:n]:
            if k is not None and k == m and sound(u) and sound(v) and len(u) == len(v):
                if sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u)) / math.sqrt(sum(b * b for b in v)) >= cosine:
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
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_matches_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.vec_id, [*map(float, r.embedding)], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        assert result(op2_pq_dedup(spark, sf)) == brute(rows, 0.98)


def test_large_group_in_many_cells(spark, monkeypatch):
    import codeweft.llm.pq_dedup as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 40)
    rng = random.Random(3)
    hub = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.08 if i % 3 else 1) for x in hub], 1 if i % 7 else 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = result(near_duplicates(df)), brute(rows, 0.98)
    found, there = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert there > 5000 and all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there, (found, there)


def test_families_that_vary_in_few_directions(spark):
    rng = random.Random(5)
    rows = []
    for directions in (1, 2, 3, 4):
        hub, *ways = ([rng.gauss(0, 1) / 8 for _ in range(64)] for _ in range(directions + 1))
        for _ in range(200):
            at = [rng.uniform(-0.5, 0.5) for _ in ways]
            rows.append((len(rows), [h + sum(a * w[d] for a, w in zip(at, ways)) for d, h in enumerate(hub)], directions))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(near_duplicates(df)) == brute(rows, 0.98)


def linked(x, labels, cosine):
    """n_links and components by plain matrix products."""
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    links = (u @ u.T >= cosine) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    root = np.arange(len(x))
    while True:
        low = np.where(links, root, len(x)).min(1)
        new = np.minimum(root, low)
        if (new == root).all():
            return links.sum(1), root
        root = new


def test_thousands_of_links_in_64_dimensions(spark, monkeypatch):
    """Families on curved surfaces of few dimensions, isotropic clusters and lone vectors, over as many lists as a large table has."""
    import codeweft.llm.pq_dedup as m

    for lists, dimensions in ((1000, 3), (256, 4)):
        monkeypatch.setattr(m, "LEAST_LISTS", lists)
        rng = np.random.default_rng(dimensions)
        ways = rng.normal(size=(dimensions, 64))
        surface = np.tanh(rng.uniform(-1, 1, (4000, dimensions)) @ ways) + 0.3 * rng.normal(size=64)
        cluster = rng.normal(size=64) + rng.normal(size=(600, 64)) * 0.1
        x = np.concatenate([surface, cluster, rng.normal(size=(400, 64))]).astype(np.float32).astype(np.float64)
        labels = np.arange(len(x)) % 2
        df = spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), labels))], "vec_id long, embedding array<float>, label int")
        n, root = linked(x, labels, 0.98)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
        assert n.sum() > 5000 and all(got[i][0] <= n[i] + 1 for i in got)
        recall = sum(min(got[i][0], int(n[i])) for i in got) / n.sum()
        assert recall >= 0.9999, recall  # all but pairs that rounding puts on either side
        assert sum(got[i][1] == root[i] for i in got) >= 0.999 * len(x)


def test_very_large_and_very_small_vectors(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1e-200, 1e-200], 1), (4, [1e-310, 1e-310], 1), (5, [1e300, -1e300], 1)]
    got = result(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert got == {**{i: (3, 1, i == 1) for i in (1, 2, 3, 4)}, 5: (0, 5, True)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [1e-30, 0.0], 1)]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    assert result(near_duplicates(df)) == brute(rows, 0.98)
    assert near_duplicates(df.limit(0)).count() == 0
    assert result(near_duplicates(df.where("vec_id = 5"))) == {5: (0, 5, True)}
    assert result(near_duplicates(df.where("vec_id = 3"))) == {3: (0, 3, True)}
    twice = near_duplicates(df.where("vec_id = 1").union(df.where("vec_id = 1")).union(df.where("vec_id = 1").selectExpr("cast(null as long)", "embedding", "label", "n_links")))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in twice.collect()), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)]


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    rng.shuffle(chain)
    rows = [*chain, (7, 7), (300, 302), (302, 301), (300, 302), (None, 5), (400, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_over_boundaries_come_once_by_half_the_reach(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2500, 64))
    x = np.concatenate([base, base[:600] + rng.normal(size=(600, 64)) * 0.17, base[:300] + rng.normal(size=(300, 64)) * 0.17])
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    assert near.sum() > len(x) + 1000 and got == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    index = pq_dedup.fit_index(u[:2500], 2500, 0.98)
    own, to = index.visits(u)
    i, j = np.nonzero(near)
    across = own[i] != own[j]
    assert across.sum() > 40 and (to[i, own[j]] | to[j, own[i]]).all()
    assert to.sum() < 5 * len(u)
