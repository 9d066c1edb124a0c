import hashlib
from array import array
from collections import Counter

import public_tokenizers
from test_bpe import LIB
from test_jaccard_join import brute as joined
from test_mixing import plain as mixed
from test_quality_rules import base
from test_secret_scan import brute as secrets

import corpus_pipeline
from codeweft.llm.common import written
from codeweft.llm.quality_rules import fit_rules, judge

SF = "/root/testdata/sf0.01"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "mixing", "bpe"]
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_run_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rules = fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ruled = {r.doc_id for r in judge(docs.select("doc_id", "text"), rules).collect() if r.rule is not None}
    rows = {r.doc_id: r for r in docs.collect()}
    stay = sorted(i for i, r in rows.items() if i not in ruled and not base(r.text)[-1])

    stages = {k: lambda *a, f=f: written(f(*a)) for k, f in corpus_pipeline.STAGES}
    first = stages["quality_rules"](spark, docs, SF)
    assert first.columns == columns and sorted(r.doc_id for r in first.collect()) == stay

    links = joined([(i, rows[i].text) for i in stay])
    stay = [i for i in stay if links[i][2]]
    second = stages["jaccard_join"](spark, first, SF)
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == stay

    third = stages["secret_scan"](spark, second, SF)
    clean = {r.doc_id: r for r in third.collect()}
    assert third.columns == columns and sorted(clean) == stay
    assert any(clean[i].text != rows[i].text for i in stay)
    for i in stay:
        assert not secrets(clean[i].text) and clean[i].n_chars == len(clean[i].text)
        assert (clean[i].text == rows[i].text) == (not secrets(rows[i].text))

    want = Counter({i: n // size for i, size, _, _, n in mixed([(i, clean[i].text, clean[i].source) for i in stay]) if n})
    fourth = stages["mixing"](spark, third, SF)
    assert fourth.columns == columns and Counter(r.doc_id for r in fourth.collect()) == want

    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == want
    for r in out:
        ids = LIB.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert array("I", bytes(r.token_bytes)).tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    good = " ".join(f"word{i} of text." for i in range(40))
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, good, "en", None, 9), (3, good, "en", None, 9), (None, good + " more", "en", "s", 9), (4, f"{good} token=abcdef123 {good[::-1]}", None, "s", 9)]
    df = spark.createDataFrame([(*r, "keep", "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _source string, _0 string")
    for name, docs in (("full", df), ("empty", df.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert out and {r.doc_id for r in out} <= {3, 4} and all(r.n_tokens > 0 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
