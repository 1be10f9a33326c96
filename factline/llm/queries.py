"""One query per operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import cotraining, decontaminate, fim, jaccard, licenses, lm_score, mixing, pii, quality_rules, secrets, urls, warc, whitening
from factline.llm.sql import ORACLES as ORACLES  # DuckDB SQL for the same rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score and kept by `quality`, toxic_score and toxic by `toxic`."""
    scored = cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("quality", "toxic"))
    return scored.select(
        "doc_id", F.col("quality_content").alias("content_score"), F.col("quality_metadata").alias("metadata_score"), F.col("quality_score").alias("score"),
        F.col("quality_above").alias("kept"), "toxic_score", (F.col("toxic_score") >= 0.5).alias("toxic"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_measures=base)
    return judged.select("doc_id", *base, quality_rules.base_failed().alias("base_failed"), "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of training positions; those of each document's first and last use."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("position", "last_position")})


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


ALL = (
    op1_license_scan, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_pii, op5_secret_scan, op6_quality_classifier, op7_quality_rules, op8_mixing, op9_warc_zip,
    op10_lm_score, op11_fill_in_middle, op12_url_filter, op13_whitening,
)
QUERIES = {f.__name__: f for f in ALL}
