"""Comparing all rows of a group without ever holding the group in one task, nor writing its pairs.

A group of rows is dealt by hash into blocks of bounded size, and a cell is a pair of its blocks: a row goes to the cells
of its own block with every block of the group. A group that fits in one block is one cell. Each cell is a bounded piece
of work, and what leaves it grows with its rows, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import dealt, partitions

CELL = ("c1", "c2")


def with_group_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds group_rows, the number of rows of each group; groups of a single row have no pair and are left out."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    return rows.join(dealt(sizes), group)


def in_cells(rows: DataFrame, group: list[str], spread: Column, block_rows: int) -> DataFrame:
    """Rows of with_group_rows() with columns c1, c2 (128 bits that name a cell) and side (-1: the cell is one block; else
    0 or 1 for its two blocks), dealt by cell and sorted by it within partitions."""
    rows = rows.withColumn("_blocks", F.ceil(F.col("group_rows") / block_rows).cast("int"))
    rows = rows.withColumn("_own", F.pmod(spread, F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    ends = [*(F.col(g) for g in group), F.least("_own", "_with"), F.greatest("_own", "_with")]
    side = F.when(F.col("_own") == F.col("_with"), -1).when(F.col("_own") < F.col("_with"), 0).otherwise(1)
    rows = rows.withColumns({"c1": F.xxhash64(*ends), "c2": F.xxhash64(F.lit(11), *ends), "side": side})
    return rows.drop("group_rows", "_blocks", "_own", "_with").repartition(partitions(rows.sparkSession), *CELL).sortWithinPartitions(*CELL)


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell in turn, from the batches of a partition that is sorted by cell."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c1, c2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in CELL)
        starts = [0, *(np.flatnonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if last != (now := (int(c1[a]), int(c2[a]))):
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, last = [], now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a-b, the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new
