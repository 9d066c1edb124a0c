"""Byte-pair encoding and decoding with a contiguous array of ranks for each short word.

A word holds its parts and, beside them in one contiguous array, the rank of merging each part with the next. The
array is scanned for its minimum, that boundary is deleted and the two neighbouring ranks are refreshed, until no pair
has a rank. For short words this beats a heap, since the array fits in a cache line or two; words of more than
``LONG_WORD`` parts go to a heap over a linked list, so that time stays near linear for texts without spaces.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import map_texts, ship_package

LONG_WORD = 400
#: Encoded words kept by each Python worker; beyond it the older half is dropped.
CACHE_WORDS = 200_000
NO_RANK = 1 << 62
ID_BITS = 20

#: How the vocabulary's normalizer and pre-tokenizer take texts apart. Its classes are those of Unicode
#: 16; the code points that later versions call letters or numbers are symbols to it, while its lower case is newer.
LATER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
PIECE = (
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATER_LETTERS}]]+|[\p{{N}}--[{LATER_NUMBERS}]]"
    rf"|[[^\p{{White_Space}}\p{{L}}\p{{N}}]{LATER_LETTERS}{LATER_NUMBERS}]+"
)
LATER_CASE = {**{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}, 0xA7CB: 0x264, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}, ord("Σ"): ord("σ")}
HAS_LATER_CASE = regex.compile("[" + "".join(map(chr, LATER_CASE)) + "]").search

ENCODED = "n_tokens long, token_bytes binary, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next free one from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary whose words end in a marked part, read from a tokenizer's JSON text."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = [vocab.get(s) for s in byte_symbols()]
        self.last = [vocab.get(s + end) for s in byte_symbols()]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left in vocab and right in vocab:
                self.merges[vocab[left] << ID_BITS | vocab[right]] = rank << ID_BITS | vocab[left + right]
        self.find = regex.compile(PIECE).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_short(self, parts: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            parts[at] = best & ((1 << ID_BITS) - 1)
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << ID_BITS | parts[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = get(parts[at - 1] << ID_BITS | parts[at], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        get, n = self.merges.get, len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], bytearray(b"\1" * n)
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << ID_BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or parts[i] != a or j >= n or parts[j] != b:
                continue  # a neighbour has changed since
            parts[i], alive[j], after[i] = m & ((1 << ID_BITS) - 1), 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get(parts[x] << ID_BITS | parts[y])) is not None:
                    heapq.heappush(heap, (m, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def word(self, word: str) -> bytes:
        """The ids of one pre-tokenized word as little-endian 32-bit integers."""
        raw = word.encode("utf-8")
        parts = [i for b in raw[:-1] if (i := self.inner[b]) is not None]
        if (i := self.last[raw[-1]]) is not None:
            parts.append(i)
        out = array("I", (self.merge_long if len(parts) > LONG_WORD else self.merge_short)(parts)).tobytes()
        if len(word) <= 64:
            if len(self.known) >= CACHE_WORDS // 2:
                self.known, self.older = {}, self.known
            self.known[word] = out
        return out

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if HAS_LATER_CASE(text):  # also a capital sigma, which has one lower case here wherever it stands
                text = text.translate(LATER_CASE)
        text = text.lower()
        known, older, word = self.known.get, self.older.get, self.word
        return b"".join([known(w) or older(w) or word(w) for w in self.find(text)])

    def encode(self, text: str) -> bytes:
        if not self.split_special:
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.split_special.split(text) if x)

    def decode(self, ids: Iterable[int]) -> str:
        """This vocabulary has no decoder of its own: tokens are joined by single spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@cache
def bpe(definition: str) -> WordBpe:
    """One vocabulary for each Python worker, whatever the number of tasks that it runs."""
    return WordBpe(definition)


def encode_documents(documents: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_tokens, token_bytes (ids as little-endian unsigned 32-bit integers) and decoded to the columns ``keep``.

    A null or empty text, or one of white space alone, has no tokens and decodes to "". Texts are encoded whole. Rows
    are independent: repeated rows give repeated results and an empty table an empty one; other columns don't matter.
    The vocabulary (a few MB, of fixed size) is read on the driver once and travels with the task.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        definition = documents.sparkSession.sparkContext.broadcast(f.read())

    def start() -> Callable[[list[str]], list[pa.Array]]:
        model = bpe(definition.value)

        def compute(texts: list[str]) -> list[pa.Array]:
            encoded = [model.encode(t) for t in texts]
            return [pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array(encoded, pa.binary()), pa.array([model.decode(array("I", e)) for e in encoded], pa.string())]

        return compute

    return map_texts(documents, text, keep, start, ENCODED)


def decode_documents(encoded: DataFrame, vocabulary_path: str, token_bytes: str = "token_bytes") -> DataFrame:
    """Adds ``decoded`` for a column of token ids as encode_documents() writes them (null: null)."""
    ship_package(encoded.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        definition = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(ids):  # noqa: ANN001, ANN202
        model = bpe(definition.value)
        return ids.map(lambda x: None if x is None else model.decode(array("I", x)))

    return encoded.withColumn("decoded", decoded(token_bytes))
