import bisect
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeweft.llm.common import held_out, labelled, one_text_each
from codeweft.llm.queries import op10_quality_gam
from codeweft.llm.quality_gam import FEATURES, classify, features, fit_gam, fit_quality

SF = "/root/testdata/sf0.01"


def test_features_are_finite():
    for t in ("", " \n", "a", "x" * 100_000, "é\u0000 \ud800", "a b c a b c\na b c"):
        f = features(t)
        assert len(f) == len(FEATURES) and all(map(math.isfinite, f))


def test_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit_gam(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) >= 0.5) == y).mean() > 0.95


def test_held_out_ranking(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op10_quality_gam(spark, SF).collect()
    assert len(out) == 1000
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    bad, good = [s for s, y in held if not y], [s for s, y in held if y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95, auc


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "", 2.0), (None, "a b", 3.0)], "doc_id long, text string, features double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 0), (None, 1, 1), (9, 7, 0)], "doc_id long, quality int, score int")
    m = fit_quality(docs, labels, F.lit(True))
    out = classify(docs, m).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in classify(docs, fit_quality(docs, labels.limit(0), ~held_out())).collect()] == [0.5] * 4
    assert classify(docs.limit(0), m).count() == 0


def test_whole_table_matches_plain_additions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = fit_quality(docs, labels, ~held_out())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert m.pairs and len(m.tables) == len(FEATURES)
    for r in op10_quality_gam(spark, SF).collect():
        x = features(texts[r.doc_id])
        z = m.base + sum(t[bisect.bisect_right(e.tolist(), v)] for e, t, v in zip(m.edges, m.tables, x))
        z += sum(t[bisect.bisect_right(m.coarse[a].tolist(), x[a]), bisect.bisect_right(m.coarse[b].tolist(), x[b])] for (a, b), t in m.pairs.items())
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_an_id_of_many_rows_counts_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(2, "c # d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    usable = labelled(labels, "doc_id", "quality", 20_000)
    assert sorted(map(tuple, one_text_each(docs, usable, "doc_id", "text").collect())) == [(1, 1, "a b"), (2, 0, "c # d")]
