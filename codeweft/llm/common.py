"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever a contract speaks of words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Spark in one Arrow batch by the Python operators.
OUT_ROWS = 256


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, unless its folder is on PYTHONPATH, which says that they
    have it already. The archive is staged on the driver, and Spark's own file server hands it out."""
    top, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "codeweft"), "zip", top, "codeweft"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32(doc_id as text) mod 5 is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def text_key(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes that together name a distinct text (null counts as empty)."""
    t = text_or_empty(text)
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def labelled(labels: DataFrame, doc_id: str, label: str, fit_rows: int) -> DataFrame:
    """(_id, _label) of about ``fit_rows`` ids at most, picked by a hash: one row for each id whose labels are 0 or 1, null ones aside, and
    agree. Other ids are left out, null ids, too."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    rows = rows.where("_label = _other").select("_id", "_label")
    share = fit_rows / max(rows.count(), 1)
    return rows.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows


def one_text_each(documents: DataFrame, usable: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _label, _text): the texts of labelled() ids, of several with one id the least, null last, so that an id which many rows
    share counts once."""
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(usable), "_id")
    return rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame) -> DataFrame:
    """Deals rows evenly. Put before a join, it also leaves both sides of the join as plain exchanges, so that adaptive
    execution can split a hot key (it can't split the output of an aggregation)."""
    return df.repartition(partitions(df.sparkSession))


def shared_dir(spark: SparkSession) -> str:
    """A new folder inside the one that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary one will do for
    a local session; a cluster's executors don't share one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    top = top or os.path.join(tempfile.gettempdir(), "codeweft-shared")
    return f"{top.rstrip('/')}/codeweft-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; a lost executor then costs only its own tasks."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, text: str, keep: Sequence[str | Column], start: Callable[[], Callable[[list[str]], list[pa.Array]]], out: str) -> DataFrame:
    """The columns ``keep`` as they are, beside the columns ``out`` (a schema) that start()(texts) computes from whole texts.

    A null text counts as empty. ``start`` runs once for each task; its function sees at most OUT_ROWS texts at a time.
    """
    ship_package(df.sparkSession)
    kept = df.select(*keep)
    added = T.StructType.fromDDL(out)
    fields = kept.schema.fields
    inner = [f"_{i}" for i in range(len(fields))]
    wanted = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(n) for n, k in zip(inner, keep, strict=True)], text_or_empty(text).alias("_text"))
    names = [*inner, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                new = compute(part.column(len(inner)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(inner)], *new], names=names)

    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(inner, fields, strict=True)), *added.fields])
    done = wanted.mapInArrow(run, schema)
    return done.select(*(F.col(n).alias(f.name) for n, f in zip(inner, fields, strict=True)), *added.names)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = OUT_ROWS) -> Iterator[dict[str, list]]:
    """Slices Arrow batches into small dicts of Python lists, so that only a few long texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pydict()
