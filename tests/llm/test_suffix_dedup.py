import hashlib
import random
from collections import Counter

from codeweft.llm.deep_shallow import order, shared_ranges
from codeweft.llm.queries import op3_suffix_dedup
from codeweft.llm.suffix_dedup import to_rows, without_repeats

SF = "/root/testdata/sf0.01"


def brute(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(r[k : k + length]) for _, r in raw for k in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[hash(r[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(r)))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_order():
    rng = random.Random(1)
    for _ in range(200):
        words = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 40))]
        for _ in range(5):
            words.append(rng.choice(words)[:20] + b"b")
        filled = [w.ljust(40, b"\0") for w in words]
        got = order(filled, [int.from_bytes(x) for x in filled], [len(w) for w in words], rng.choice([0, 4]), rng.choice([0, 8, 24]))
        assert [words[i] for i in got] == sorted(words)


def test_shared_ranges():
    rng = random.Random(2)
    for _ in range(300):
        length, gram = 12, 4
        both = list({(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))), b"gram" + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(2, 30))})
        if len(both) < 2:
            continue
        got = shared_ranges(both, length, gram)
        for i, (left, right) in enumerate(both):
            ts = [t for t in range(0, length - gram + 1) if t <= len(left) and length - t <= len(right) and any(j != i and a[:t] == left[:t] and len(a) >= t and b[: length - t] == right[: length - t] for j, (a, b) in enumerate(both))]
            assert got[i] == ((min(ts), max(ts)) if ts else (length, -1))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 50
    assert result(op3_suffix_dedup(spark, SF)) == want


def odd_texts():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, p199 = noise(400), "".join(rng.choice("xyz") for _ in range(199))
    return [
        None, "", "a" * 199, "b" * 200, "c" * 201, "d" * 5000, "Orre " * 3000, noise(50) + passage + noise(70), passage, noise(300) + passage[:230], noise(10) + p199 + noise(500), noise(20) + p199 + noise(90),
        "same" * 60, "same" * 60, "short", "short", noise(900), noise(100) + "Orre " * 100 + noise(10), "\0" * 450 + noise(300), "x" + "\0" * 250, "😀" * 120, noise(40) + passage[100:] + noise(40) + passage[:350],
    ]


def query(df):
    from pyspark.sql import functions as F

    judged = without_repeats(df)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return to_rows(df, judged.select("k1", "k2", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))


def test_odd_rows(spark, monkeypatch):
    import codeweft.llm.suffix_dedup as m

    rows = [*enumerate(odd_texts()), (None, "x" * 300)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, h int, kept string")
    assert result(query(df)) == brute(rows)
    monkeypatch.setattr(m, "PIECE", 500)
    assert result(query(df)) == brute(rows)
    assert query(df.limit(0)).count() == 0 and result(query(df.where("doc_id < 3"))) == brute(rows[:3])


def test_frequent_passage_in_many_cells(spark, monkeypatch):
    import codeweft.llm.suffix_dedup as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, alone = noise(260), noise(190)
    rows = [(i, noise(rng.randrange(300)) + (passage if i % 3 else alone) + noise(rng.randrange(300))) for i in range(120)]
    rows += [(1000 + i, rows[i][1][:-20] + noise(20)) for i in range(20)]
    assert result(query(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
