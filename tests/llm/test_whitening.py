import math

import numpy as np
import pytest

from codeweft.llm.queries import op12_whitening
from codeweft.llm.whitening import NotCertified, integers, lobpcg, whiten

SF = "/root/testdata/sf0.001"


def plain(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away.astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (away * away).sum(axis=1), centred @ u / np.sqrt(e), e / (centred**2).sum() * n


def test_whole_table_against_a_dense_solver(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    deviation, white, explained = plain([v for _, v in vectors], 32)
    got = {(r.vec_id, r.component): r for r in op12_whitening(spark, SF).collect()}
    assert len(got) == 32 * len(vectors)
    for i, (vec_id, _) in enumerate(vectors):
        assert {got[vec_id, c + 1].deviation for c in range(32)} == {int(deviation[i])}
    for c in range(32):
        mine = np.array([got[v, c + 1].whitened for v, _ in vectors])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(sign * mine - white[:, c]).max() < 1e-6
        assert got[vectors[0][0], c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    one = next(iter(got.values()))
    assert one.n == len(vectors) and 0 <= one.identity_error < 1e-9


def test_iterates_to_certified_residuals():
    dice = np.random.default_rng(5)
    d, k = 500, 32
    q = np.linalg.qr(dice.standard_normal((d, d)))[0]
    for values in (np.geomspace(1000, 0.1, d), np.concatenate([np.full(40, 7.0), np.linspace(6.9, 1, d - 40)]), np.concatenate([np.arange(20, 0, -1.0), np.zeros(d - 20)])):
        v, steps = (q * values) @ q.T, []
        times = lambda w: steps.append(w.shape[1]) or v @ w  # noqa: B023, E731
        e, u, residuals = lobpcg(times, d, k)
        assert np.allclose(e, values[:k], rtol=1e-8, atol=1e-8 * values[0]) and residuals.max() <= 1e-9 * values[0]
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and max(steps) <= 2 * (k + 8)
    with pytest.raises(NotCertified):
        lobpcg(lambda w: v @ w + 0.1 * np.random.standard_normal(w.shape), d, k)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 2.0, 0.25]), (None, [-1.0, 1.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [3.0, -1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, whitened double")
    good = [r for r in rows if r[0] in (1, 2, None, 9)]
    deviation, white, _ = plain([v for _, v in good], 3)
    got = whiten(df).collect()
    assert len(got) == 3 * len(good) and sorted(int(r.deviation) for r in got) == sorted(3 * [int(d) for d in deviation])
    assert sorted(round(abs(r.whitened), 6) for r in got) == sorted(round(abs(float(w)), 6) for w in white.ravel())
    # one direction alone, none, one row, no rows
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(50)], "vec_id long, embedding array<float>")
    assert {r.component for r in whiten(line).collect()} == {1}
    assert whiten(line.where("vec_id = 3")).count() == whiten(line.limit(0)).count() == 0
    assert whiten(spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")).count() == 0
    assert whiten(line.limit(0)).columns == whiten(line).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(0, [3.0e13, 1.0]), (1, [-2.0e13, 0.0]), (2, [1.0, 5.0])]
    got = {r.vec_id: int(r.deviation) for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()}
    assert got == dict(zip(range(3), map(int, plain([v for _, v in rows], 1)[0])))
    assert integers(spark.createDataFrame([(0, [0.49, -0.01])], "vec_id long, embedding array<double>"), (), "embedding").first().x == [31, -1]
