import hashlib
import itertools
import re
import time

from pyspark.sql import functions as F

from codeweft.llm.queries import op5_secret_scan
from codeweft.llm.secret_scan import RULES, redact, running, scan
from codeweft.llm.trigrams import selective, trigram_query

SF = "/root/testdata/sf0.01"


def brute(text):
    found = []
    for i, r in enumerate(RULES):
        for m in re.finditer(r.plain or r.pattern, text or "", re.ASCII):
            if len(m.group(0 if r.plain else r.group)) >= r.least:
                found.append((m.start(), i, m.end(), r.kind))
    return sorted(found)


def test_queries():
    assert trigram_query("[0-9a-f]+") == () and trigram_query("(ab|cd)?x+") == ()
    assert trigram_query("AKIA[A-Z]+") == (frozenset({frozenset({"aki", "kia"})}),)
    assert trigram_query("(foo|bars)x") == (frozenset({frozenset({"foo", "oox"}), frozenset({"bar", "ars", "rsx"})}),)
    assert trigram_query("(foo|.*)") == ()


def test_queries_miss_no_match():
    held = lambda r, t: all(any(a <= {t.lower()[i : i + 3] for i in range(len(t) - 2)} for a in c) for c in trigram_query(r.plain or r.pattern))
    samples = {"assign": ["PassWord = 'abcdefg", "api_key:abcdef", "APIKEY=======", 'token" : "x'], "access": ["AKIAA"], "github": ["ghs_" + "a" * 36], "slack": ["xoxr-123456789012"], "google": ["AIza" + "-" * 35], "stripe": ["rk_live_" + "0" * 20], "jwt": ["eyJa.eyJb.c"], "key_block": ["-----BEGIN RSA PRIVATE KEY-----\nab=\n-----END RSA PRIVATE KEY-----"]}
    for r in RULES:
        for t in samples.get(r.kind, []):
            assert re.search(r.pattern, t) and held(r, t), (r.kind, t)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op5_secret_scan(spark, SF).collect()
    assert len(out) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in out) > 20
    for r in out:
        spans = brute(docs[r.doc_id])
        name = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
        assert r.spans == name(spans)
        assert r.base_sha256 == hashlib.sha256(name([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == i for s in spans) for i in range(3))


ODD = [
    None, "", " ", "password=secret=token: abcdefgh", "token:abcde token:abcdef", "PASSWD\"  :  'x_y.z=1-", "😀😀 api_key=abcdef AKIA" + "Z" * 16 + " é",
    "AKIA" * 5, "AKIAAKIA", "f" * 23, "f" * 24, "g" + "0" * 5000 + "g", "secret = " + "ab12" * 8 + " and " + "ab12" * 8, ("token=abcdef1 " + "x" * 50) * 300,
    "ghp_" + "a" * 36 + " xoxb-123456789012 AIza" + "b" * 35 + " sk_live_" + "1" * 20 + " eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + "._-",
    "-----BEGIN PRIVATE KEY-----\nABC+/=\n-----END PRIVATE KEY-----", "$1 \\ token=$abc token=abcdef$1",
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 3, t) for i, t in enumerate(ODD)], "doc_id long, text string, n_chars long, spans string").union(spark.createDataFrame([(6, ODD[6], 3, None)], "a long, b string, c long, d string"))
    out = scan(df).collect()
    assert len(out) == len(ODD) + 1
    for r in out:
        assert [(s.start, s.rank, s.end, s.kind) for s in r.spans] == brute(ODD[r.doc_id]), ODD[r.doc_id]
    clean = redact(df, length="n_chars")
    assert clean.columns == df.columns
    for r in clean.collect():
        assert (r.text is None) == (ODD[r.doc_id] is None) and r.spans == ODD[r.doc_id] or r.doc_id == 6
        assert brute(r.text) == [] and (r.text is None or r.n_chars == len(r.text))
        if not brute(ODD[r.doc_id]):
            assert r.text == ODD[r.doc_id]
    assert redact(spark.createDataFrame([(1, "a token=abcdef b")], "doc_id long, text string")).first().text == "a [assign] b"
    assert scan(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_every_span_goes(spark):
    hexes, key = "0123456789abcdef" * 2, "-----BEGIN RSA PRIVATE KEY-----\nMII" + "Qx" * 40 + "\n-----END RSA PRIVATE KEY-----"
    odd = [f'é😀 token="{key}" é', f"x eyJ{hexes}Zz.eyJQ{hexes}.Sig-{hexes}_tail y", f"AIza{hexes}_Rest-{'Z' * 20} ü", f"token={hexes}", f"token=abcdef {hexes} token=ghijkl"]
    odd += [t for t in ODD if t]
    want = []
    for t in odd:
        out, at, runs = "", 0, []
        for a, _, b, kind in brute(t):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b, kind])
        for a, b, kind in runs:
            out, at = f"{out}{t[at:a]}[{kind}]", b
        want.append(out + t[at:])
    assert want[:4] == ['é😀 [assign]" é', "x [jwt] y", "[google] ü", "[assign]"]
    got = redact(spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(want))


def test_no_python_in_the_plan(spark):
    plan = scan(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_selective_queries_are_implied():
    for r in RULES:
        full, few = trigram_query(r.plain or r.pattern), r.query
        for clause in few:
            assert all(len(a) <= 2 for a in clause)
            assert any(all(any(b <= a for b in clause) for a in c) for c in full), r.kind  # some clause of the full query implies it
        assert bool(full) == bool(few)


def test_many_hits_in_one_text(spark):
    n = 200_000
    text = "".join(f"token=abcd{i:06d} é{'0' * 24} " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    spans = scan(df).first().spans
    clean = redact(df).first().text
    assert time.time() - began < 120
    assert [(s.start, s.rank, s.end, s.kind) for s in spans] == brute(text)
    assert clean == "[assign] é[hex] " * n


def test_no_rule_goes_over_a_run_again_and_again(spark):
    n = 200_000
    texts = [
        "eyJ" * n + " .ey", "eyJ" * n + ".eyJ" + "eyJ" * n + ".", "eyJa.eyJb" * n, "eyJ.eyJ." * n, "token " * n, "secret" + " " * n + "x", "password=\"" * n, "AKI" * n + "AKIA" * n, "0123456789abcdef0123456 " * (n // 8), "a" * n,
        "gho_" * n, "xoxb" * n + "xoxb-", "AIza" * n, "sk_live_" * n, "-----BEGIN " * n, "-----BEGIN PRIVATE KEY-----A" * (n // 8), "-----BEGIN PRIVATE KEY-----" + "A\n" * n + "-----END ", "-----BEGIN " + "A" * n + " PRIVATE KEY",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    began = time.time()
    found = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.spans] for r in scan(df).collect()}
    assert redact(df).count() == len(texts)
    assert time.time() - began < 120
    assert found[0] == found[1] == []  # the plain expressions would take hours here
    for i in range(2, len(texts)):
        assert found[i] == brute(texts[i]), texts[i][:40]


def test_running_totals(spark):
    for n in (0, 1, 255, 256, 257, 4097, 70_000):
        x = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7919 % 1009).cast("int")).alias("x")) if n else spark.range(1).select(F.array().cast("array<int>").alias("x"))
        got = x.select("x", running(F.col("x"), lambda a, b: a + b).alias("sums"), running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("most")).first()
        assert got.sums == [sum(got.x[:i]) for i in range(n)] if n < 5000 else got.sums == [0, *itertools.accumulate(got.x)][:-1]
        assert got.most == [0, *itertools.accumulate(got.x, max)][: len(got.x)]
