"""Cutting the lineage of a table that later steps read more than once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary folder will do for a local session; a
    cluster's executors don't share one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (shared or os.path.join(tempfile.gettempdir(), "codeweft-checkpoints")).rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows evenly to as many tasks as a shuffle has: small tables are read by one task, and what is composed or read out of each of their rows
    may take long. It is put where rows are still narrow. They are kept: Spark takes filters, and all that these compute, to the other side of a
    shuffle, where one task would do it."""
    return cut(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Tables of so many rows may be sent whole to all executors.
FEW_ROWS = 2000


def cut(df: DataFrame, compact: bool = False, few: int = FEW_ROWS) -> DataFrame:
    """Computes a table once and keeps it in the shared folder, as Parquet: what reads it knows its size, and a lost executor costs no more
    than its own tasks. The folder's owner clears it.

    ``compact`` says that its files are many times smaller than its rows, as those of tokens and of what is made out of them are. By the
    size of its files Spark would broadcast such a table, through the driver's memory; it is joined by a shuffle unless it has few rows, no more than ``few``."""
    path = f"{checkpoint_dir(df.sparkSession)}/codeweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return written.hint("merge") if compact and written.count() > few else written
