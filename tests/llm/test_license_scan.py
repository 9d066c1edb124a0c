import re

from pyspark.sql import functions as F

from codeweft.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, scan_licenses
from codeweft.llm.queries import op9_license_scan

SF = "/root/testdata/sf0.01"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(text):
    low = lower(text or "")
    words = re.findall(WORD, low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    more, score = set(), 0.0
    for b in (text or "").lower().split("\n") + re.split(r"\n[\x20\t\r]*\n", (text or "").lower()):
        has = set(re.findall(WORD, b))
        for label, texts in TEMPLATES.items():
            for t in texts:
                want = set(re.findall(WORD, t.lower()))
                if (c := len(has & want) / len(want)) >= THRESHOLD - 1e-12:
                    more.add(label)
                    score = max(score, c)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score)


def row(r):
    join = lambda x: x if isinstance(x, str) else ",".join(x)
    return (r.n_words, r.n_base, r.first_word, r.last_word, join(r.base_labels), join(r.labels), r.score)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op9_license_scan(spark, SF).collect()
    assert len(out) == len(docs) and sum(r.score > 0 for r in out) > 20
    for r in out:
        assert row(r) == brute(docs[r.doc_id]), r


def test_odd_rows(spark):
    texts = [
        None, "", " ", "CC BY", "ccc by cc-bye cc_by", "ccé by", "cc by cc by cc\nby", "All rights reserved. General Public License", "éall rights reserved all  RIGHTS\treserved",
        "Licensed under the\nApache License,\nVersion 2.0\n\nother", "licensed the apache under version license 2.0 words between them", TEMPLATES["bsd"][0].replace("and", "or"),
        "x " * 20_000 + "all rights reserved " + "y " * 20_000, "Released under the MIT License.", "released the license mit", "K İ ſ Ω cc by",
    ]
    df = spark.createDataFrame([(i, t, 1, t) for i, t in enumerate(texts)], "doc_id long, text string, k1 int, labels string")
    df = df.union(df.where("doc_id = 9"))
    out = scan_licenses(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert row(r) == brute(texts[r.doc_id]), (r, texts[r.doc_id][:80])
    assert scan_licenses(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = scan_licenses(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
