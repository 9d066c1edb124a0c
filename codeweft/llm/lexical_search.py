"""Ranked lexical search over an inverted index of two levels: byte impacts, rounded upwards, and exact term frequencies.

Documents are indexed in blocks of bounded size. A row of the index holds, for one term of one block, the slots of the
documents that hold the term, one byte for each that bounds its impact from above (first level), and its frequencies
(second level). A search reads the first level alone: sums of bytes bound each document's score from both sides. Only the
documents whose upper bound reaches the k-th best lower bound of all are scored by the second level, in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import rows_of, ship_package, text_or_empty, written

#: A term: letters, digits and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block ends with the document that brings it to so many documents or postings; so many items are searched together.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_ITEMS = 4096, 1_000_000, 1024
#: Fixed values of the score: 1000 times an impact is below FULL; a byte stands for FULL / 255.
FULL, STEPS = 1_000_000, 255

_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8, with A-Z in lower case."""
    return text.encode().translate(_SPLIT).split()


def terms_column(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """``blocks`` has a row for each term of each block, and one for each block without a term, which holds ids and sizes."""

    blocks: DataFrame
    documents: int
    terms: int

    @property
    def postings(self) -> DataFrame:
        return self.blocks.where("term is not null").select("block", "term", "n", "slots", "impacts", "tfs")

    @property
    def slots(self) -> DataFrame:
        """(block, slot, doc_id, size) of each indexed document."""
        rows = self.blocks.where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("slot", "d"))
        return rows.select("block", "slot", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("size"))


def spread(size: Column | np.ndarray, documents: int, all_terms: int):  # noqa: ANN201
    """What a document's length adds to its impacts: 10, and 90 for a document of mean length."""
    total = 90 * size * documents
    return total // all_terms + 10 if isinstance(total, np.ndarray) else F.expr(f"({90 * documents}L * size) div {all_terms}L") + 10


class _Block:
    """Documents that are gathered until a block is full."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.terms: list[bytes] = []
        self.tfs: list[int] = []
        self.held: list[int] = []

    def add(self, doc_id: object, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.terms.extend(counts)
        self.tfs.extend(counts.values())
        self.held.append(len(counts))

    def full(self, docs: int) -> bool:
        return len(self.ids) >= docs or len(self.terms) >= BLOCK_POSTINGS

    def batch(self, number: int, id_type: pa.DataType, documents: int, all_terms: int) -> pa.RecordBatch:
        names: dict[bytes, int] = {}
        of = np.fromiter((names.setdefault(t, len(names)) for t in self.terms), np.int64, len(self.terms))
        order = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=len(names))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        sizes = np.array(self.sizes, np.int64)
        slots = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.held)[order]
        tfs = np.array(self.tfs, np.int64)[order]
        impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * spread(sizes, documents, all_terms)[slots])
        above = ((impacts * STEPS + FULL - 1) // FULL).astype(np.uint8)
        tail = np.append(ends, ends[-1])  # the block's own row has no postings
        lists = lambda values: pa.ListArray.from_arrays(pa.array(tail), pa.array(values.astype(np.int32)))
        none = [None] * len(names)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(names) + 1, number)),
            pa.array([*names, None], pa.binary()).cast(pa.string()),
            pa.array(np.append(n, 0).astype(np.int32)),
            lists(slots),
            pa.Array.from_buffers(pa.binary(), len(names) + 1, [None, pa.py_buffer(tail.tobytes()), pa.py_buffer(above.tobytes())]),
            lists(tfs),
            pa.array([*none, self.ids], pa.list_(id_type)),
            pa.array([*none, self.sizes], pa.list_(pa.int64())),
        ], names=["block", "term", "n", "slots", "impacts", "tfs", "ids", "sizes"])


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> Index:
    """Indexes every row of ``documents`` by the terms of its whole text. Rows without a term (null and empty texts, too) count
    nowhere; rows that are equal are documents of their own. Other columns have no influence."""
    ship_package(documents.sparkSession)
    size = F.regexp_count(text_or_empty(text), F.lit(TERM)).cast("long")
    total = documents.select(size.alias("n")).where("n > 0").agg(F.count("n").alias("documents"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["documents"], total["terms"] or 1
    kind = documents.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, id_type = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for rows in rows_of(iter([batch])):
                for i, t in zip(rows["_id"], rows["_text"], strict=True):
                    if words := terms(t):
                        block.add(i, words)
                        if block.full(block_docs):
                            yield block.batch(number, id_type, n_docs, n_terms)
                            number, block = number + 1, _Block()
        if block.ids:
            yield block.batch(number, id_type, n_docs, n_terms)

    schema = T.StructType.fromDDL("block long, term string, n int, slots array<int>, impacts binary, tfs array<int>")
    schema = schema.add("ids", T.ArrayType(kind)).add("sizes", T.ArrayType(T.LongType()))
    rows = documents.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    return Index(written(rows.mapInArrow(run, schema)), n_docs, n_terms)


def bounds_of(block: pa.Table, k: int) -> pa.Table:
    """Postings of the terms that some items ask for in one block, with the weight of each term and the items that ask for it -> the
    documents (item, block, slot, lower, upper) whose upper bound reaches the item's k-th best lower bound in this block."""
    items_list, slots_list, bytes_list = (block[c].combine_chunks() for c in ("items", "slots", "impacts"))
    items = np.unique(items_list.flatten().to_numpy())
    width = int(slots_list.flatten().to_numpy().max()) + 1
    lower, upper = np.zeros((len(items), width), np.int64), np.zeros((len(items), width), np.int64)
    for asked, at, raw, w in zip(items_list, slots_list, bytes_list, block["w"].to_pylist(), strict=True):
        where = np.ix_(np.searchsorted(items, asked.values.to_numpy()), at.values.to_numpy())
        b = np.frombuffer(raw.as_buffer(), np.uint8).astype(np.int64)
        upper[where] += w * (b * FULL // STEPS)
        lower[where] += w * np.where(b > 0, (b - 1) * FULL // STEPS + 1, 0)
    level = np.partition(lower, width - k, axis=1)[:, width - k] if width >= k else np.zeros(len(items), np.int64)
    row, slot = np.nonzero((upper >= level[:, None]) & (upper > 0))
    number = np.full(len(row), block["block"][0].as_py())
    columns = [items[row], number, slot.astype(np.int32), lower[row, slot], upper[row, slot]]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["item", "block", "slot", "lower", "upper"])


def asked_terms(items: DataFrame, item_id: str, text: str, block_items: int) -> tuple[DataFrame, DataFrame]:
    """(item, item_id), and (item, part, term) with each term of an item once; rows of equal item_id are one item. Items are
    dealt into parts of about ``block_items``."""
    words = items.select(F.col(item_id).alias("item_id"), F.explode(terms_column(text)).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    words = written(words)
    parts = -(-words.count() // block_items) or 1
    numbered = written(words.repartition(parts).select(F.monotonically_increasing_id().alias("item"), F.spark_partition_id().alias("part"), "item_id", "terms"))
    return numbered.select("item", "item_id"), numbered.select("item", "part", F.explode("terms").alias("term"))


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item (all, if fewer), equal scores
    by ascending doc_id, null last.

    Scores are exact. Rows of one item_id are one item, null included, that asks for the terms of all of them; an item without
    terms, or whose terms no document holds, has no rows, and so has an empty index or table of items.
    """
    ship_package(items.sparkSession)
    names, asked = asked_terms(items, item_id, text, block_items)
    df = index.postings.select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(asked.join(df.select("term", weight.alias("w")), "term"))
    wanted = written(weighed.groupBy("part", "term").agg(F.first("w").alias("w"), F.collect_list("item").alias("items")))
    first = index.postings.select("block", "term", "slots", "impacts").join(wanted, "term")
    found = first.groupBy("block", "part").applyInArrow(lambda block: bounds_of(block, k), "item long, block long, slot int, lower long, upper long")
    found = written(found)
    best = found.select("item", "lower", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower"))).alias("r")).where(F.col("r") <= k)
    level = best.groupBy("item").agg(F.when(F.count("r") >= k, F.min("lower")).otherwise(0).alias("level"))
    reach = written(found.join(level, "item").where("upper >= level").select("item", "block", "slot"))
    second = index.postings.select("block", "term", "slots", "tfs")
    sizes = reach.select("block", "slot").distinct().join(index.slots, ["block", "slot"]).withColumn("m", spread(F.col("size"), index.documents, index.terms))
    exact = reach.join(weighed.select("item", "term", "w"), "item").join(second, ["block", "term"]).withColumn("at", F.array_position("slots", F.col("slot")).cast("int")).where("at > 0")
    exact = exact.withColumn("tf", F.get("tfs", F.col("at") - 1).cast("long")).join(sizes, ["block", "slot"])
    scores = exact.groupBy("item", "block", "slot").agg(F.first("doc_id").alias("doc_id"), F.sum(F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")).alias("score")).where("score > 0")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents),
c as (select count(*) as n_docs, sum(len(words)) as n_terms from d where len(words) > 0),
p as (select doc_id, term, any_value(n) as n, count(*) as tf from (select doc_id, len(words) as n, unnest(words) as term from d) group by doc_id, term),
w as (select term, cast(floor(1000 * ln((2.0::double * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from i join w using (term) join p using (term), c group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""
