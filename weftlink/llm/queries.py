"""The queries of the corpus operators: thin digests over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, lm, packing, passages, quality, secrets, substrings, urls
from .common import crc_mod
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    labelled = docs.filter(~held_out & F.col("doc_id").isNotNull())
    plain = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.predict(plain, labelled).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_md5", "comp")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.find(docs, items)


#: The URL rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    counts = [F.size(F.filter("secrets", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "random")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_quality_rules, op4_lm_scores, op5_jaccard_join, op6_decontamination, op7_url_filters, op8_best_fit_packing, op9_substring_dedup, op10_secret_scans)}

