"""Removal of passages that occur elsewhere: every byte covered by a string of ``length`` bytes that also starts anywhere else.

Sorting the suffixes of a corpus at all places would move each byte many times. It is enough to sort them at anchors: the
places whose run of GRAM bytes has the least hash in some window of ``length`` bytes. An anchor depends on the bytes of
its window alone, so that two equal strings of that length always share one at the same distance from their starts.
Only anchors whose run occurs twice or more are looked at further. What surrounds them is dealt by that run, the
suffixes that start at the anchors are put in order by deep-shallow sorting (see deep_shallow.py), and so are, in
reverse, the bytes before them; the two orders tell how far to both sides each place has an equal elsewhere.

Equal texts are one class throughout; a class of several is removed whole if it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.cells import cells_of, in_cells
from codeweft.llm.common import dealt, ship_package, text_key, text_or_empty
from codeweft.llm.deep_shallow import shared_ranges

LENGTH, GRAM = 200, 32
#: Bytes whose anchors are found at once; longer texts are cut into pieces that overlap.
PIECE = 1 << 20
#: Contexts of one anchor compared in one place; those of a more frequent anchor are dealt into cells.
BLOCK_ROWS = 4096
#: Places of one anchor in a text count as so many contexts at most, if they are more than its contexts: a passage that texts repeat
#: is dealt into more cells. A cell is never sized for fewer contexts than there are.
SPREAD = 64
FACTOR = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each window of ``width`` entries, by doubling."""
    k = 1
    while 2 * k <= width:
        x, k = pick(x[:-k], x[k:]), 2 * k
    return x if k == width else pick(x[: len(x) - (width - k)], x[width - k :])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of texts that stand one after the other in ``raw`` and end at ``ends``: their places and the hashes of their runs."""
    n = len(raw) - GRAM + 1
    if n < length - GRAM + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, k, power = mixed(raw.astype(np.uint64) + np.uint64(1)), 1, FACTOR
    while k < GRAM:
        run, power, k = run[:-k] * np.uint64(power) + run[k:], power * power % (1 << 64), 2 * k
    run = mixed(run)
    weight = (run >> np.uint64(33)).astype(np.uint32)
    cut = (ends[:-1, None] - np.arange(1, GRAM)).ravel()  # runs that reach into the next text
    weight[cut[(cut >= 0) & (cut < n)]] = np.iinfo(np.uint32).max
    width = length - GRAM + 1
    least = sliding(weight, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero((weight == sliding(np.concatenate([pad, least, pad]), width, np.maximum)) & (weight < np.iinfo(np.uint32).max))
    return at, run[at].view(np.int64)


def pieces_of(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Batches of about PIECE bytes: the texts' places in the list, where each piece starts in its text, and the pieces."""
    which, starts, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t[at : at + PIECE + length - 1]
            which.append(i)
            starts.append(at)
            parts.append(part)
            total += len(part)
            if total >= PIECE:
                yield which, starts, parts
                which, starts, parts, total = [], [], [], 0
    if parts:
        yield which, starts, parts


def anchor_table(documents: DataFrame, length: int, text: str) -> DataFrame:
    """(h, k1, k2, at, contexts): the anchors of each text by hash, with all places that share it, and how many of these differ in
    the bytes around them."""
    back = length - GRAM

    def differing(raw: bytes, places: np.ndarray) -> int:
        return len({hash((min(p, back), raw[max(0, p - back) : p + length])) for p in places.tolist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                doc, place, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                texts = part.column(2).to_pylist()
                for which, starts, parts in pieces_of(texts, length):
                    ends = np.cumsum([len(p) for p in parts])
                    found, h = anchors(np.frombuffer(b"".join(parts), np.uint8), ends, length)
                    own = np.searchsorted(ends, found, side="right")
                    doc.append(np.array(which)[own])
                    place.append(found - (ends - [len(p) for p in parts])[own] + np.array(starts)[own])
                    gram.append(h)
                d, p, h = np.concatenate(doc), np.concatenate(place), np.concatenate(gram)
                sort = np.lexsort((p, h, d))
                d, p, h = d[sort], p[sort], h[sort]
                if not len(d):
                    continue
                once = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (h[1:] != h[:-1])]  # pieces overlap
                d, p, h = d[once], p[once], h[once]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
                at_list = pa.ListArray.from_arrays(pa.array(np.r_[first, len(p)].astype(np.int32)), pa.array(p.astype(np.int32)))
                ends = np.r_[first[1:], len(p)]
                several = {int(i): differing(texts[d[first[i]]], p[first[i] : ends[i]]) for i in np.flatnonzero(ends - first > 1)}
                keys = part.select(["k1", "k2"]).take(pa.array(d[first]))
                contexts = pa.array([several.get(i, 1) for i in range(len(first))], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), *keys.columns, at_list, contexts], names=["h", "k1", "k2", "at", "contexts"])

    return documents.select(*text_key(text), text_or_empty(text).cast("binary").alias("raw")).mapInArrow(run, "h long, k1 long, k2 long, at array<int>, contexts int")


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """texts(k1, k2, text, found), found being an array of (h, group_rows, at) -> a row for each different context of an anchor in
    a text: its places there, the number of bytes before the anchor, and the bytes around it."""
    back = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "group_rows", "k1", "k2", "at", "before", "context"]
        schema = pa.schema([*((n, pa.int64()) for n in names[:4]), ("at", pa.list_(pa.int32())), ("before", pa.int32()), ("context", pa.binary())])
        rows: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, raw, found = (batch.column(c)[i].as_py() for c in range(4))
                for f in found:
                    seen: dict[tuple[int, bytes], list[int]] = {}
                    for p in f["at"]:
                        start = max(0, p - back)
                        seen.setdefault((p - start, raw[start : p + length]), []).append(p)
                    for (before, context), at in seen.items():
                        if len(context) >= length:
                            for column, x in zip(rows, (f["h"], f["group_rows"], k1, k2, at, before, context), strict=True):
                                column.append(x)
                if len(rows[0]) >= 4096:
                    yield flush()
        if rows[0]:
            yield flush()

    # n is there only so that both uses of the texts read the same exchange
    return texts.select("k1", "k2", F.col("text").cast("binary"), "found", "n").mapInArrow(run, "h long, group_rows long, k1 long, k2 long, at array<int>, before int, context binary")


def covered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cells of contexts -> (k1, k2, start, end): runs of bytes that strings occurring elsewhere cover."""
    out: list[tuple[int, int, int, int]] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "start", "end"])

    for cell in cells_of(batches):
        places: dict[tuple[int, bytes], list[tuple[int, int, list[int]]]] = {}
        for k1, k2, at, before, context in zip(*(cell.column(c).to_pylist() for c in ("k1", "k2", "at", "before", "context")), strict=True):
            places.setdefault((before, context), []).append((k1, k2, at))
        each = [*places]
        if len(each) > 1:
            ranges = shared_ranges([(c[:b][::-1], c[b:]) for b, c in each], length, GRAM)
        else:
            ranges = [(length, -1)]
        for (before, context), (lo, hi) in zip(each, ranges, strict=True):
            here = places[before, context]
            if sum(len(at) for _, _, at in here) > 1:  # the whole context occurs twice
                lo, hi = max(0, length - (len(context) - before)), before
            if lo > hi:
                continue
            for k1, k2, at in here:
                start, end = at[0] - hi, at[0] - lo + length
                for p in at[1:]:
                    if p - hi > end:
                        out.append((k1, k2, start, end))
                        start = p - hi
                    end = p - lo + length
                out.append((k1, k2, start, end))
        if len(out) >= 8192:
            yield flush()
    if out:
        yield flush()


def without_repeats(documents: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(k1, k2, n_bytes, spans, kept) for each distinct text, named by text_key(): its length in bytes, the maximal runs that
    are removed as an array of (start, end), and the remaining bytes.

    A text is judged as its UTF-8 bytes, null as none. Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else in the corpus, the same text included; strings are judged on the input. Repeated rows are
    copies of each other and go whole if they have that length. An empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    table = anchor_table(documents, length, text)
    text_of = F.xxhash64("k1", "k2")
    seen = table.groupBy("h").agg(F.min(text_of).alias("first"), F.max(text_of).alias("last"), F.max(F.size("at")).alias("most"), F.sum(F.greatest("contexts", F.least(F.size("at"), F.lit(SPREAD)))).alias("group_rows"))
    whole_blocks = (F.ceil(F.col("group_rows") / BLOCK_ROWS) * BLOCK_ROWS).alias("group_rows")  # few different values, which shuffles compress
    seen = seen.where("first < last or most > 1").select("h", whole_blocks)
    found = table.join(dealt(seen), "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "group_rows", "at")).alias("found"))
    texts = documents.select(*text_key(text), text_or_empty(text).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    around = contexts(texts.join(found, ["k1", "k2"]), length)
    cells = in_cells(around, ["h"], F.xxhash64("k1", "before", F.get("at", F.lit(0))), BLOCK_ROWS)
    # two anchors that share a cell by a collision of 64 bits do no harm: contexts are compared by their bytes
    cells = cells.select("c1", F.lit(0).cast("long").alias("c2"), "k1", "k2", "at", "before", "context")
    runs = cells.mapInArrow(lambda b: covered(b, length), "k1 long, k2 long, start long, end long")
    runs = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                k1, k2, texts, copies, found = part.columns
                sizes, spans, kept = [], [], []
                for raw, n, runs in zip(texts.to_pylist(), copies.to_pylist(), found.to_pylist(), strict=True):
                    own: list[dict[str, int]] = []
                    if n > 1 and len(raw) >= length:
                        own = [{"start": 0, "end": len(raw)}]
                    else:
                        for r in sorted(runs or [], key=lambda r: r["start"]):
                            if own and r["start"] <= own[-1]["end"]:
                                own[-1]["end"] = max(own[-1]["end"], r["end"])
                            else:
                                own.append(r)
                    rest = [0, *(x for s in own for x in (s["start"], s["end"])), len(raw)]
                    sizes.append(len(raw))
                    spans.append(own)
                    kept.append(b"".join(raw[a:b] for a, b in zip(rest[::2], rest[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([k1, k2, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["k1", "k2", "n_bytes", "spans", "kept"])

    judged = texts.join(runs, ["k1", "k2"], "left").select("k1", "k2", F.col("text").cast("binary"), "n", "runs")
    return judged.mapInArrow(cut, "k1 long, k2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def to_rows(documents: DataFrame, judged: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Puts what without_repeats() says of each distinct text, or columns derived from it, beside the columns ``keep`` of each row."""
    more = [c for c in judged.columns if c not in ("k1", "k2")]
    judged = dealt(judged.select(*(F.col(c).alias(f"_j_{c}") for c in judged.columns)))
    rows = documents.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), *text_key(text))
    joined = rows.join(judged, (F.col("k1") == F.col("_j_k1")) & (F.col("k2") == F.col("_j_k2")))
    return joined.select(*(F.col(f"_{i}").alias(k) for i, k in enumerate(keep)), *(F.col(f"_j_{c}").alias(c) for c in more))
