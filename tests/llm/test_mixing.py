import hashlib
import re

import duckdb

from codeweft.llm.mixing import ORACLE, mix, mixed_rows
from codeweft.llm.queries import op6_mixing


def plain(rows):
    """rows: (doc_id, text, source). Shares out and takes by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    h = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    own = {k: sum(n for n, (_, _, s) in zip(size, rows) if s == k) for k in names}
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, left, open_ = {}, sum(own.values()), set(names)
    while open_:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 3 * own[k]]
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * own[k]
            left -= 3 * own[k]
            open_.remove(k)
    out = []
    taken = {}
    for k in names:
        whole = min(3, int(target[k] / own[k] + 1e-9)) if own[k] else 0
        budget, before = max(0.0, target[k] - whole * own[k]), 0
        by = {}
        for j, (_, _, s) in enumerate(rows):
            if s == k and size[j]:
                by.setdefault(h[j], []).append(j)
        for x in sorted(by):
            n = sum(size[j] for j in by[x])
            for k_th, j in enumerate(by[x]):
                taken[j] = size[j] * (whole + (before + (k_th + 0.5) * size[j] <= budget))
            before += n
    for j, (i, _, s) in enumerate(rows):
        out.append((i, size[j], own[s], round(target[s], 6), taken.get(j, 0)))
    return out


def result(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_whole_table_matches_sorting_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op6_mixing(spark, sf)
    got = result(out)
    assert got == sorted(plain(rows), key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.execute(ORACLE).fetchall()
    assert [d[0] for d in c.description] == out.columns
    assert sorted(((a, b, x, round(t, 6), k) for a, b, x, t, k in want), key=str) == got


def test_odd_rows(spark):
    big = "w " * 50_000
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (4, "x y", None), (4, "x y", None), (None, "q " * 40, "b"), (None, None, None), (7, big, "c"), (8, "one", "Ä"), (9, "p " * 30, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, hash int")
    assert result(mix(df)) == sorted(plain(rows), key=str)
    assert mix(df.limit(0)).count() == 0 and result(mix(df.where("doc_id = 1"))) == [(1, 0, 0, 0.0, 0)]
    mixed = mixed_rows(df)
    assert mixed.columns == df.columns
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + len((r.text or "").split())
    want = {}
    for (i, _, _, _, n), (_, _, s) in zip(plain(rows), rows):
        want[i, s] = want.get((i, s), 0) + n
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}
    assert mixed_rows(df.limit(0)).count() == 0


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(1, "w " * 10, "a")] * 100 + [(i, "w " * (i % 7 + 1), "b") for i in range(200)] + [(5, "x y", "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(df, keep=("doc_id", "source")).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == sorted(plain(rows), key=str)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2
    mixed = mixed_rows(df).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in got)


def test_many_sources_are_ranked_in_ranges(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 977:04d}") for i in range(3000)] + [(9, "a b", None)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert result(out) == sorted(plain(rows), key=str)


def test_columns_of_any_name(spark):
    rows = [(1, "a b c", "s", "keeps", 7, 8), (2, "d", "t", "too", 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source string, _hash int, _copies int")
    got = mixed_rows(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 0


def test_no_python_in_the_plan(spark):
    plan = mix(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
