"""Document fingerprints: digests of improbable features.

A feature is a window of bytes. Its entropy is looked up in a table of all documents' windows: the rarer its entropy is among them, the
less probable the feature. Where a feature is the least probable one of many neighbouring positions, it is selected. Selected
features set bits in a chain of Bloom filters, and two chains are compared by how far their common bits exceed chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import partitions, rows_of, ship_package, text_or_empty, written

#: Bytes of a feature; neighbouring positions of which one is the least probable; how many such runs select a feature.
WINDOW, REACH, LEAST = 32, 32, 8
#: Bits of a filter, features it takes, bits a feature sets.
BITS, CAPACITY, HASHES = 2048, 160, 5
#: Entropies are whole numbers from 0 to LEVELS; those outside SOUND (runs of one byte, or noise) select nothing.
LEVELS, SOUND = 1000, (100, 990)
#: Common bits count from so many standard deviations above what chance gives.
DEVIATIONS = 3.0
#: Positions that are looked at together, so that the memory for a text doesn't grow with it.
CHUNK = 1 << 20

_ONE = 1 << 20
#: c log2 c in whole numbers, so that equal windows have equal entropies wherever they stand.
_TABLE = np.array([0, *(round(c * np.log2(c) * _ONE) for c in range(1, WINDOW + 1))], np.int64)
_STEP = np.append(0, np.diff(_TABLE))


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of ``data`` (bytes), from 0 to LEVELS: each follows from the one before by the byte that enters
    and the byte that leaves, whose counts are sums of comparisons."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    total = np.empty(n, np.int64)
    total[0] = _TABLE[np.bincount(data[:WINDOW])].sum()
    total[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]]
    full = int(_TABLE[WINDOW])
    return (full - np.cumsum(total)) * LEVELS // full


def selected(data: np.ndarray, ranks: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions of the selected features of a text, in order. ``ranks`` gives the place of each entropy, the least probable first."""
    n = len(data) - WINDOW + 1
    reach = min(REACH, n)
    found = []
    for at in range(0, n, chunk):
        low, high = max(at - REACH + 1, 0), min(at + chunk + REACH - 1, n)
        level = entropies(data[low : high + WINDOW - 1])
        least = ranks[level] << 32 | np.arange(low, high)  # leftmost of equals
        size = 1
        while size < reach:  # least of 1, 2, 4 ... neighbours, then of reach
            step = min(size, reach - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        times = np.bincount((least & 0xFFFFFFFF) - low, minlength=high - low)
        good = (times >= min(LEAST, n - reach + 1)) & (level >= SOUND[0]) & (level <= SOUND[1])
        here = np.flatnonzero(good) + low
        found.append(here[(here >= at) & (here < at + chunk)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Digest:
    """Filters in order as rows of bytes, and how many features they hold: CAPACITY each, the last one what is left."""

    features: int
    filters: np.ndarray

    def name(self) -> bytes:
        return self.features.to_bytes(8, "big") + self.filters.tobytes()


def digest(text: str, ranks: np.ndarray) -> Digest:
    """Each selected feature counts once, where it stands first. A text that selects none has one feature: the whole of it."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    hashes = dict.fromkeys(hashlib.sha1(raw[p : p + WINDOW]).digest() for p in selected(data, ranks).tolist())
    if not hashes:
        hashes = {hashlib.sha1(raw).digest(): None}
    words = np.frombuffer(b"".join(hashes), ">u4").reshape(-1, HASHES) % BITS
    bits = np.zeros((-(-len(words) // CAPACITY), BITS), np.uint8)
    bits[np.repeat(np.arange(len(words)) // CAPACITY, HASHES), words.ravel()] = 1
    return Digest(len(words), np.packbits(bits, axis=1))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each filter of ``a`` and each of ``b``: by how far the common bits exceed chance, against the most that they can."""
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    common, n, m = (x @ y.T).astype(float), x.sum(axis=1, dtype=float)[:, None], y.sum(axis=1, dtype=float)[None, :]
    chance, most = n * m / BITS, np.minimum(n, m)
    noise = np.sqrt(chance * (1 - n / BITS) * (1 - m / BITS))
    floor = chance + DEVIATIONS * noise
    return np.where(common >= most, 1.0, np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0.0, 1.0))


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1: each filter of the shorter chain against the filter of the other that it is most like, weighted by features;
    of chains of equal length, the mean of both ways. Equal digests have 1."""
    if a.features == b.features and np.array_equal(a.filters, b.filters):
        return 1.0
    if len(a.filters) > len(b.filters):
        a, b = b, a
    across, back = np.zeros(len(a.filters)), np.zeros(len(b.filters))
    for i in range(0, len(a.filters), 256):
        for j in range(0, len(b.filters), 256):
            part = overlaps(a.filters[i : i + 256], b.filters[j : j + 256])
            across[i : i + 256] = np.maximum(across[i : i + 256], part.max(axis=1))
            back[j : j + 256] = np.maximum(back[j : j + 256], part.max(axis=0))
    mean = lambda best, d: float(best @ np.minimum(d.features - CAPACITY * np.arange(len(best)), CAPACITY)) / d.features
    return mean(across, a) if len(a.filters) < len(b.filters) else (mean(across, a) + mean(back, b)) / 2


def fit_ranks(documents: DataFrame, text: str = "text") -> np.ndarray:
    """For each entropy its place by how many windows of all texts have it, the rarest first (equals: the lower entropy)."""
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS + 1, np.int64)
        for rows in rows_of(batches):
            for t in rows["_text"]:
                data = np.frombuffer(t.encode(), np.uint8)
                for at in range(0, len(data), CHUNK):
                    counts += np.bincount(entropies(data[at : at + CHUNK + WINDOW - 1]), minlength=LEVELS + 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["level", "n"])

    parts = documents.select(text_or_empty(text).alias("_text")).mapInArrow(run, "level long, n long")
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in parts.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS + 1)
    return ranks


def edited(text: str, after: str) -> str:
    """The last half of a text (rounded down) replaced by as many first characters of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@dataclass(frozen=True)
class _Held:
    key: tuple
    text: str
    own: Digest


def _row(held: _Held, after: str, next_digest: Digest, ranks: np.ndarray) -> tuple:
    changed = edited(held.text, after)
    other = held.own if changed == held.text else digest(changed, ranks)
    return (*held.key, len(held.text), hashlib.sha256(changed.encode()).hexdigest(), held.own.name(), other.name(), likeness(held.own, other), likeness(held.own, next_digest))


OUT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document of a row is the one after it in ascending order of ids, null last, rows of one id in order of a hash of
    their texts; the last one's is the first, a single row's is itself. Null counts as empty. A fingerprint is the number of
    features and, in hex, the filters. Equal texts have equal fingerprints, whose likeness is 1. An empty table gives an empty
    result. Other columns, whatever their names, have no influence.

    Texts move once, into ranges of ids. Each task reads its range in order and holds two texts at a time; the last document of
    each range meets the first of the next one in a second, small step.
    """
    spark, kind = documents.sparkSession, documents.schema[doc_id].dataType
    ranks = fit_ranks(documents, text)
    t = text_or_empty(text)
    order = ["_none", "_id", "_h"]
    rows = documents.select(F.col(doc_id).isNull().alias("_none"), F.col(doc_id).alias("_id"), F.xxhash64(t).alias("_h"), t.alias("_text"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    out = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(OUT)])
    schema = T.StructType([*out, *T.StructType.fromDDL("edge int, task int, whole string")])
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def batch(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, [id_type, *types], strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, found, id_type = TaskContext.get().partitionId(), None, [], None
        for b in batches:
            id_type = b.schema.field(0).type
            for part in rows_of(iter([b])):
                for i, text_ in zip(part["_id"], part["_text"], strict=True):
                    own = digest(text_, ranks)
                    if held is None:
                        found.append((None,) * 7 + (0, task, text_))
                    else:
                        found.append((*_row(held, text_, own, ranks), None, None, None))
                    held = _Held((i,), text_, own)
                if len(found) >= 256:
                    yield batch(found, id_type)
                    found = []
        if held is not None:
            found.append((held.key[0], *(None,) * 6, 1, task, held.text))
            yield batch(found, id_type)

    done = written(rows.select("_id", "_text").mapInArrow(run, schema))
    whole = done.where("edge is null").select(*out.names)
    ends = done.where("edge = 1").select(F.col("doc_id").alias("_id"), "task", F.col("whole").alias("_text"))
    # one row a task: the first text of the next task that has any, of the first task for the last one
    tasks = sorted(r["task"] for r in ends.select("task").collect())
    after = dict(zip(tasks, [*tasks[1:], *tasks[:1]], strict=True))
    follows = spark.createDataFrame([Row(task=a, other=b) for a, b in after.items()], "task int, other int")
    firsts = done.where("edge = 0").select(F.col("task").alias("other"), F.col("whole").alias("_next"))
    pairs = ends.join(follows, "task").join(firsts, "other").select("_id", "_text", "_next").repartition(partitions(spark))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in rows_of(iter([b]), 16):
                found = []
                for i, text_, next_ in zip(part["_id"], part["_text"], part["_next"], strict=True):
                    found.append((*_row(_Held((i,), text_, digest(text_, ranks)), next_, digest(next_, ranks), ranks), None, None, None))
                yield batch(found, b.schema.field(0).type)

    every = whole.unionByName(pairs.mapInArrow(close, schema).select(*out.names))
    shown = lambda c: F.concat(F.conv(F.hex(F.substring(c, 1, 8)), 16, 10), F.lit(":"), F.lower(F.hex(F.substring(c, 9, 1 << 30)))).alias(c)
    return every.select("doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
