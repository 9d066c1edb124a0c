import re
from collections import Counter

from pyspark.sql import functions as F

from codeweft.llm.common import held_out
from codeweft.llm.queries import op7_quality_rules
from codeweft.llm.quality_rules import counted, fit_rules, judge, kept_rows

SF = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op7_quality_rules(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.rule is None)
    ruled = [r for r in out if r.rule is not None and r.doc_id in truth]
    bad = [r for r in out if truth.get(r.doc_id) == 0 and not r.base_failed]
    good = [r for r in out if truth.get(r.doc_id) == 1]
    assert sum(truth[r.doc_id] == 0 for r in ruled) >= 0.9 * len(ruled)
    assert sum(r.rule is not None for r in bad) >= 0.8 * len(bad)
    assert sum(r.rule is not None for r in good) <= 0.02 * len(good)


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \n ", "a", "a b c", "a b c d", "a a a a", "a b c a b c", "x\nx\n\n \nx\ny", "é😀 #| $", many, many + " " + many, "a b c " * 4000, "A!! B!!"]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept int")
    got = {r.doc_id: r for r in judge(df.select("doc_id", "text"), []).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (i, t and t[:40])
    kept = kept_rows(df, [])
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [10]
    assert kept_rows(df.limit(0), []).count() == 0
    labels = spark.createDataFrame([(0, 0), (1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert fit_rules(df, labels) == [] and fit_rules(df, labels.limit(0)) == []


def test_a_rule_of_two_conditions(spark):
    # bad is what has many symbols and also many capitals; either alone is good
    rows, marks = [], []
    for i in range(600):
        symbols, capitals = i % 2, i // 2 % 2
        words = [("AB" if capitals else "ab") + str(j + i) + ("#" if symbols else "") for j in range(60)]
        rows.append((i, " ".join(words)))
        marks.append((i, 0 if symbols and capitals else 1))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    rules = fit_rules(docs, labels)
    assert len(rules) == 1 and {c.feature for c in rules[0].conditions} == {"symbols_a_word", "upper_case"}
    assert sorted(r.doc_id for r in kept_rows(docs, rules).collect()) == [i for i, y in marks if y]


def test_no_python_in_the_plan(spark):
    plan = judge(spark.range(1).select(F.lit("a").alias("text")), [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and counted(spark.range(1).select(F.lit("a").alias("text"))).count() == 1


def plain_features(text):
    text = text or ""
    n, chars, symbols, dup_lines, repeated, _ = base(text)
    lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    share = lambda a, b: a / b if b else 0.0
    return {
        "chars_a_word": share(chars, n), "symbols_a_word": share(symbols, n), "repeated_lines": share(dup_lines, lines), "repeated_words": share(repeated, n),
        "upper_case": share(len(re.findall("[A-Z]", text)), chars), "marks_a_word": share(len(re.findall(r"[!?;:()\[\]{}_=+~^@/\\-]", text)), n),
    }


def test_verdicts_match_plain_rules(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = fit_rules(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rules
    for r in op7_quality_rules(spark, SF).collect():
        x = plain_features(texts[r.doc_id])
        met = [str(rule) for rule in rules if all((x[c.feature] > c.cut) == c.above for c in rule.conditions)]
        assert r.rule == (met[0] if met else None)
        assert r.kept == (not base(texts[r.doc_id])[-1] and not met)


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = fit_rules(docs, labels.where(~held_out()))
    judged = {r.doc_id: r for r in judge(docs.where(held_out()), rules).collect()}
    held = [(judged[r.doc_id], r.quality) for r in labels.where(held_out()).collect() if r.doc_id in judged and not judged[r.doc_id].base_failed]
    bad, good = [r for r, y in held if y == 0], [r for r, y in held if y == 1]
    print("held out: rejected", sum(not r.kept for r in bad), "of", len(bad), "bad ones and", sum(not r.kept for r in good), "of", len(good), "good ones")
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad) and sum(r.kept for r in good) >= 0.95 * len(good)
