import random
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeweft.llm.bpe import bpe, decode_documents, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


LIB = library()
MODEL = bpe(open(PATH, encoding="utf-8").read())
ODD = ["", " \t\n", "It's we'LL 'stop'", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΑΣ Σ ὈΔΥΣΣΕΎΣ", "İstanbul K Å ﬁ", "é é 한국어 日本語", "²Ⅷ½ 12345", "a\x1cb\x85c d e", "😀👩‍👩‍👧", "́ __ --==", "x" * 5000, "ab" * 900 + "é" * 500, "\x00\x01\x7f"]


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    got = MODEL.encode(text)
    assert array("I", got).tolist() == want, text
    assert MODEL.decode(array("I", got)) == LIB.decode(want, skip_special_tokens=False)


def test_odd_texts():
    for t in ODD:
        same(t)


def test_every_code_point():
    for at in range(0, 0x110000, 512):
        same(" ".join(f"a{chr(i)}:{chr(i)}" for i in range(at, at + 512) if not 0xD800 <= i < 0xE000))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_long_words_merge_alike():
    rng = random.Random(5)
    for _ in range(50):
        ids = [rng.choice(MODEL.inner[97:123]) for _ in range(rng.randrange(2, 300))]
        assert MODEL.merge_short([*ids]) == MODEL.merge_long([*ids])


def test_documents(spark):
    rows = [(i, t, i) for i, t in enumerate([*ODD, None, ODD[2], ODD[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = {r.doc_id: r for r in encode_documents(df, PATH).collect()}
    for i, t, _ in rows:
        want = LIB.encode(t or "", add_special_tokens=False).ids
        assert array("I", bytes(out[i].token_bytes)).tolist() == want and out[i].n_tokens == len(want)
        assert out[i].decoded == LIB.decode(want, skip_special_tokens=False)
    assert encode_documents(df.limit(0), PATH).count() == 0
    again = decode_documents(encode_documents(df, PATH).drop("decoded"), PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: r.decoded for i, r in out.items()}
