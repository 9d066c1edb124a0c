"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import lexical_search, mixing
from codeweft.llm.common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.language_id import fit_profiles, identify

    documents = table(spark, sf_dir, "documents")
    profiles = fit_profiles(documents, learn=~held_out())
    return identify(documents, profiles, keep=("doc_id", held_out().alias("held_out")))


def op2_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.pq_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.suffix_dedup import to_rows, without_repeats

    documents = table(spark, sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    judged = without_repeats(documents, length=200)
    judged = judged.select("k1", "k2", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return to_rows(documents, judged)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.jaccard_join import similarity_join

    return similarity_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.secret_scan import BASE, scan

    found = scan(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = {f"n_{r.kind}": F.size(F.array_remove(F.transform("spans", lambda s: s["rank"] == i), F.lit(False))).cast("long") for i, r in enumerate(BASE)}  # noqa: B023
    return found.select("doc_id", *(c.alias(k) for k, c in counts.items()), F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", name)).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.quality_rules import fit_rules, judge

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(documents, table(spark, sf_dir, "labels"))
    return judge(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codeweft.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({k: F.concat_ws(",", k) for k in ("base_labels", "labels")})


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.quality_gam import classify, fit_quality

    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents, table(spark, sf_dir, "labels"), learn=~held_out())
    return classify(documents, model, keep=("doc_id", held_out().alias("held_out")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.lexical_search import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings"), components=32)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pq_dedup": op2_pq_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_quality_gam": op10_quality_gam,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op11_lexical_search": lexical_search.ORACLE}
