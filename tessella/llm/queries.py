"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, html_extraction, jaccard_join, language_model, packing, pii, quality_classifier, quality_rules, quotation, resampling, token_store, url_filters
from .common import shared_folder, table


def op1_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.summary(pii.sanitise(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return out.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extraction.extract(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.read(spark, path)


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("row.doc_id", "own_good", "p_host", "p_path", "p_good", "own_toxic", "accepted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score", "m.start", "m.end")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("scans")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_features", "weight", "score", "rank")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, rule string")
    out = url_filters.judge(pages, rules, url_filters.suspect_hosts(pages), keep=["page_id"])
    return out.select("row.page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sanitisation, op2_html_extraction, op3_token_store, op4_quotation_linking, op5_jaccard_join, op6_packing, op7_language_model, op8_quality_classifier, op9_quality_rules, op10_decontamination, op11_centroids, op12_resampling, op13_url_filters)}

ORACLE_SQL: dict[str, str] = {"op4_quotation_linking": quotation.SQL, "op11_centroids": centroids.SQL, "op12_resampling": resampling.SQL, "op13_url_filters": url_filters.SQL}
