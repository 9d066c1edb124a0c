import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from codeweft.llm.fingerprints import BITS, CAPACITY, LEAST, LEVELS, REACH, SOUND, WINDOW, digest, edited, entropies, fingerprints, fit_ranks, likeness, selected
from codeweft.llm.queries import op13_fingerprints

SF = "/root/testdata/sf0.001"


def plain_entropies(raw):
    full = WINDOW * round(math.log2(WINDOW) * (1 << 20))
    size = lambda w: sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(w).values())
    return [(full - size(raw[i : i + WINDOW])) * LEVELS // full for i in range(len(raw) - WINDOW + 1)]


def plain_digest(text, ranks):
    raw = text.encode()
    levels = plain_entropies(raw)
    reach, times = min(REACH, len(levels)), Counter()
    runs = len(levels) - reach + 1 if levels else 0
    for s in range(runs):
        times[min(range(s, s + reach), key=lambda p: (ranks[levels[p]], p))] += 1
    names = []
    for p in range(len(levels)):
        if times[p] >= min(LEAST, runs) and SOUND[0] <= levels[p] <= SOUND[1]:
            h = hashlib.sha1(raw[p : p + WINDOW]).digest()
            if h not in names:
                names.append(h)
    names = names or [hashlib.sha1(raw).digest()]
    filters = []
    for k, h in enumerate(names):
        if k % CAPACITY == 0:
            filters.append(0)
        for i in range(0, 20, 4):
            filters[-1] |= 1 << BITS - 1 - int.from_bytes(h[i : i + 4], "big") % BITS
    return f"{len(names)}:" + "".join(f.to_bytes(BITS // 8, "big").hex() for f in filters)


def named(d):
    return f"{d.features}:{d.filters.tobytes().hex()}"


def texts():
    dice = random.Random(5)
    words = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(dice.choice(words) for _ in range(n))
    line = prose(12)
    return ["", "a", "x" * 500, "short text, shorter than a window"[:20], prose(6), prose(9), prose(60), prose(2500), "\n".join([line] * 40), "日本語 " * 60, "é" + prose(100), prose(30) * 3]


def test_entropies_and_selection_against_a_plain_count():
    ranks = np.random.default_rng(3).permutation(LEVELS + 1)
    for t in texts():
        data = np.frombuffer(t.encode(), np.uint8)
        assert entropies(data).tolist() == plain_entropies(t.encode())
        assert named(digest(t, ranks)) == plain_digest(t, ranks)
        for chunk in (1, 33, 1000):
            if len(data) < 2000 or chunk > 1:
                assert selected(data, ranks, chunk).tolist() == selected(data, ranks).tolist()


def test_likeness():
    ranks = np.arange(LEVELS + 1)
    a, b, c = (digest(t, ranks) for t in (texts()[7], texts()[6], texts()[11]))
    assert likeness(a, a) == 1 and likeness(digest("", ranks), digest("", ranks)) == 1 and likeness(digest("", ranks), digest("x", ranks)) == 0
    for x in (a, b, c):
        for y in (a, b, c):
            assert 0 <= likeness(x, y) <= 1 and likeness(x, y) == pytest.approx(likeness(y, x))
    dice = random.Random(1)
    other = digest("".join(dice.choice("abcdefghij klmnop") for _ in range(15_000)), ranks)
    assert likeness(a, other) < 0.05
    half = digest(edited(texts()[7], "".join(dice.choice("abcdefghij klmnop") for _ in range(15_000))), ranks)
    assert 0.3 < likeness(a, half) < 0.7


def test_whole_table_against_plain_digests(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    counts = Counter(e for _, t in docs for e in plain_entropies(t.encode()))
    ranks = {level: i for i, level in enumerate(sorted(range(LEVELS + 1), key=lambda e: (counts[e], e)))}
    got = {r.doc_id: r for r in op13_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    table = np.array([ranks[e] for e in range(LEVELS + 1)])
    for i, (doc_id, t) in enumerate(docs):
        r, after = got[doc_id], docs[(i + 1) % len(docs)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, other = digest(t, table), digest(changed, table)
        assert (r.fingerprint, r.edited_fingerprint) == (named(own), named(other))
        assert (r.near_edited, r.near_next) == (likeness(own, other), likeness(own, digest(after, table)))
        if len(t) < 3000:
            assert r.fingerprint == plain_digest(t, table)
    long = [r for d, r in got.items() if r.n_chars > 1000]
    assert sum(r.near_edited > 0.25 for r in long) > 0.95 * len(long)


def test_odd_rows(spark):
    rows = [(3, "c" * 10), (None, None), (1, "first text"), (2, ""), (2, None), (1, "first text"), (None, "of no id")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, task int, fingerprint string")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints(df).collect()), key=repr)
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 7 and (2, 0, h("")) in got
    assert (3, 10, h("ccccc")) in got or (3, 10, h("cccccof no")) in got  # null ids come last, in order of a hash
    assert sorted(s for d, _, s in got if d == 1) == sorted([h("first" + "first"), h("first")])
    assert len({r.fingerprint for r in fingerprints(df).where("n_chars = 0").collect()}) == 1
    one = fingerprints(df.where("doc_id = 3")).collect()
    assert [(r.edited_sha256, r.near_edited, r.near_next) for r in one] == [(h("c" * 10), 1.0, 1.0)]
    assert fingerprints(df.limit(0)).count() == 0
    assert fit_ranks(df.limit(0)).tolist() == list(range(LEVELS + 1))
