"""Language identification by rank-order n-gram profiles.

The most frequent character n-grams of each language, in order of frequency, are its profile. A text gets a profile of
its own and the language whose ranks it disturbs least: the out-of-place distance sums, over the text's n-grams, how far
each one's rank lies from its rank in the language's profile, or the profile's length if it isn't there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import map_texts, rows_of, ship_package

#: n-grams of one to three characters; three code points of 21 bits fit in one signed 64-bit key.
LONGEST = 3
PROFILE = 300
#: A profile is learned from so many texts of its language at most (about; all of them if there are fewer).
FIT_TEXTS = 20_000
CHUNK = 1 << 20
SPACE = 0x20


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal keys; keys come back in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text in lower case as 64-bit keys, in order, and how often each occurs.

    Whatever isn't a letter ends a word; a word takes one space on each side. Long texts are counted in chunks.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, SPACE)
    code = np.r_[SPACE, code, SPACE].astype(np.uint32)
    code = code[np.r_[True, (code[1:] != SPACE) | (code[:-1] != SPACE)]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, max(len(code) - 1, 0), CHUNK):
        one = code[at : at + CHUNK + LONGEST - 1].astype(np.int64)
        own = min(CHUNK, len(one))
        two = one[:-1] << 21 | one[1:]
        three = two[:-1] << 21 | one[2:]
        keys = np.sort(np.concatenate([one[:own][one[:own] != SPACE], two[:own], three[:own][one[1:-1][:own] != SPACE]]))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found.append((keys[first], np.diff(np.r_[first, len(keys)])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else merged(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


def fit_profiles(documents: DataFrame, learn: Column, text: str = "text", lang: str = "lang", fit_texts: int = FIT_TEXTS, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language: its ``size`` most frequent n-grams, most frequent first, ties by key.

    Learns from rows for which ``learn`` is true and lang and text aren't null: about ``fit_texts`` of a language, picked by a
    hash of the text. What reaches the driver is a count and ``size`` keys for each language.
    """
    ship_package(documents.sparkSession)
    rows = documents.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, fit_texts / n)])
    spread = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(spread < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in rows_of(batches):
            by: dict[str, list[str]] = {}
            for k, t in zip(part["lang"], part["text"], strict=True):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                new = ngrams(" ".join(texts))
                old = total.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                total[k] = merged(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))
        for k, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    total = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.languages, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)
        for i, k in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.keys, profiles[k])] = np.arange(len(profiles[k]))

    def best(self, text: str) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.languages:
            return "und", 0.0
        top = keys[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.keys, top)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        i = int(far.argmin())
        return self.languages[i], 1.0 - float(far[i]) / (self.size * len(top))


def identify(documents: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score (1 less the out-of-place distance as a share of its maximum) to the columns ``keep``.

    ``und`` with score 0 for a text that is null or has no letter, and for all texts if no language was learned. Of two
    languages equally near, the first by name wins. Rows are independent: repeated rows give repeated results, an empty
    table an empty one, and columns that aren't named have no influence.
    """

    def start() -> Callable[[list[str]], list[pa.Array]]:
        model = Profiles(profiles, size)

        def compute(texts: list[str]) -> list[pa.Array]:
            found = [model.best(t) for t in texts]
            return [pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return compute

    return map_texts(documents, text, keep, start, "lang_pred string, score double")
