import math
import random
import re
from collections import Counter

from oracle import same

from codeweft.llm.lexical_search import ORACLE, build_index, search, terms
from codeweft.llm.queries import op11_lexical_search

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n_docs, all_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc_id, tf, n in held:
            m = 10 + 90 * n * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_terms():
    assert terms("A-b2 É'é_x\x7f日本\n") == [w.encode() for w in ("a", "b2", "É", "é", "x", "日本")] == [w.encode() for w in plain_terms("A-b2 É'é_x\x7f日本\n")]
    assert terms("") == terms(" .,") == []


def test_whole_tables_match_sql(spark):
    assert same(spark, SF, op11_lexical_search, ORACLE)


def test_against_a_plain_search_over_many_blocks_and_parts(spark):
    dice = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(dice.choice(words[: dice.randint(1, 60)]) for _ in range(n))
    docs = [(i, text(dice.randint(0, 40))) for i in range(400)] + [(i, "w1 w2 w59") for i in range(400, 500)] + [(500, text(4000))]
    items = [(i, text(8)) for i in range(30)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10, 1000):
        assert rows(search(build_index(df, block_docs=37), asked, k=k, block_items=7)) == plain_search(docs, items, k), k


def test_ties_nulls_repeated_rows_and_clashing_columns(spark):
    docs = [(2, "The cat"), (1, "the CAT"), (1, "the CAT"), (None, "the cat"), (3, None), (4, ""), (5, "...!"), (6, "dog"), (7, "dog " * 30_000)]
    items = [(1, "cat, cat"), (None, "dog"), (2, None), (3, "nowhere"), (4, "the"), (4, "dog"), (1, "cat, cat"), (5, "")]
    more = spark.createDataFrame([(*d, 9, 9, "x") for d in docs], "doc_id long, text string, item int, score long, term string")
    asked = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, rank int, doc_id long")
    got = rows(search(build_index(more), asked))
    assert got == plain_search(docs, items, 10)
    assert [d for i, _, d, _ in sorted(got, key=lambda r: r[1]) if i == 1] == [1, 1, 2, None]
    assert search(build_index(more.limit(0)), asked).count() == 0
    assert search(build_index(more), asked.limit(0)).count() == 0


def test_only_the_first_level_is_read_for_bounds(spark):
    index = build_index(spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string"))
    plan = index.postings.select("block", "term", "slots", "impacts")._jdf.queryExecution().executedPlan().toString()
    assert "tfs" not in plan.split("ReadSchema")[1] and "ids" not in plan.split("ReadSchema")[1]
