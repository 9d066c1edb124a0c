import zlib
from collections import Counter

from pyspark.sql import functions as F

from codeweft.llm.common import held_out
from codeweft.llm.language_id import PROFILE, fit_profiles, identify, ngrams
from codeweft.llm.queries import op1_language_id

SF = "/root/testdata/sf0.001"


def plain_ngrams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = f" {w} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " ")
    return out


def key(g):
    k = 0
    for c in g:
        k = k << 21 | ord(c)
    return k


def test_ngrams_match_a_plain_count():
    for t in ("", " ", "12!", "a", "Ab ab, aB", "Été  d'été\n\n日本 x", "😀a😀"):
        keys, counts = ngrams(t)
        got = dict(zip(keys.tolist(), counts.tolist()))
        want = plain_ngrams(t)
        # neighbouring words share the space between them, as in one running text
        assert got == {key(g): n for g, n in want.items()}, t


def test_long_text_in_chunks(monkeypatch):
    import codeweft.llm.language_id as m

    text = "the quick brown fox " * 50
    whole = [x.tolist() for x in ngrams(text)]
    monkeypatch.setattr(m, "CHUNK", 17)
    assert [x.tolist() for x in ngrams(text)] == whole


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", "de"), (4, "the cat and the dog", None), (5, "the cat and the dog", "en"), (6, "der hund und die katze", "de"), (6, "der hund und die katze", "de"), (None, "the cat", "en")]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id long, text string, lang string, score double")
    profiles = fit_profiles(df, F.lit(True))
    assert set(profiles) == {"en", "de"} and all(len(p) <= PROFILE for p in profiles.values())
    got = [(r.doc_id, r.lang_pred) for r in identify(df, profiles).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "de"), (6, "de"), (None, "en")], key=str)
    assert {r.lang_pred for r in identify(df, fit_profiles(df.limit(0), F.lit(True))).collect()} == {"und"}
    assert identify(df.limit(0), profiles).count() == 0


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op1_language_id(spark, SF).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_have_no_influence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert fit_profiles(docs, ~held_out()) == fit_profiles(other, ~held_out())


def plain_best(text, profiles):
    grams = sorted(plain_ngrams(text or "").items(), key=lambda x: (-x[1], key(x[0])))[:PROFILE]
    if not grams or not profiles:
        return "und", 0.0
    far = {k: sum(abs(p.index(key(g)) - i) if key(g) in p else PROFILE for i, (g, _) in enumerate(grams)) for k, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (PROFILE * len(grams))


def test_whole_table_matches_a_plain_ranking(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = fit_profiles(docs, ~held_out())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op1_language_id(spark, SF).collect():
        best, score = plain_best(texts[r.doc_id], profiles)
        assert r.lang_pred == best and abs(r.score - score) < 1e-12, r
