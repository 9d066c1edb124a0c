"""A corpus pipeline out of the operators of codeweft.llm: each stage's result is written and is the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.bpe import encode_documents
from codeweft.llm.common import table, written
from codeweft.llm.jaccard_join import one_of_each
from codeweft.llm.mixing import mixed_rows
from codeweft.llm.quality_rules import fit_rules, kept_rows
from codeweft.llm.secret_scan import redact

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned ones reject go."""
    return kept_rows(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return one_of_each(docs, n=5, threshold=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes."""
    return redact(docs, length="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, or up to three times."""
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's tokens, and a digest of what they decode to."""
    out = encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_tokens", "token_bytes", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("bpe", bpe),
]
#: Learned rules, MinHash candidates and byte-pair merges have no SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, token_bytes, decoded_sha256, one for each time that the mix takes a document.

    A null text counts as empty and goes with the first stage, as all texts of fewer than 50 words do. Repeated rows and near
    copies leave one row, that of the least id, null after all others. Further columns of documents, whatever their names, go
    along up to the last stage and have no influence. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
