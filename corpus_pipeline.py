"""A corpus pipeline of five stages over ``documents``, each one of the operators of weftlink.llm.

Each stage takes what the one before kept, written as Parquet. All but the last
return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm import common, decontaminate, jaccard, packing, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A side of fewer rows than this is broadcast; rows are 32-character digests.
SMALL = 200_000


def _md5(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _sized(df: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns, with n_chars that fits the text."""
    return df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts with them; boilerplate lines go from the others."""
    kept = quality.judge(docs, rest=True).filter("kept")
    return _sized(kept.withColumn("text", F.col("text_left")), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the smallest doc_id, nulls last, then the smallest md5 of the text.

    Groups are told apart by the operator's own number, so rows that share an id or have none are judged by their texts.
    Texts without words are linked with nothing and stay; rows of one id and text stay once.
    """
    found = jaccard.join(docs.select("doc_id", "text"))
    alone = F.col("comp").isNull()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_md5").alias("md5"))).alias("x")
    first = found.groupBy("comp", F.when(alone, F.col("doc_id")).alias("_i"), F.when(alone, F.col("text_md5")).alias("_t")).agg(best)
    first = first.select(F.col("x.id").alias("_id"), F.col("x.md5").alias("_md5"))
    one = F.row_number().over(Window.partitionBy("doc_id", "_md5").orderBy(F.lit(1)))
    mine = docs.withColumn("_md5", _md5())
    stay = mine.join(first.select(F.col("_id"), F.col("_md5").alias("_m")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_m")), "left_semi")
    return stay.withColumn("_one", one).filter("_one = 1").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; whether one does depends on its text alone. Null and empty texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    mine = docs.withColumn("_md5", _md5())
    found = _written(decontaminate.find(mine.select("_md5", "text"), items, key="_md5").select("_md5").distinct())
    if found.count() <= SMALL:
        found = F.broadcast(found)
    return mine.join(found, "_md5", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; null texts stay null. Every row stays."""
    found = secrets.scan(docs)
    return _sized(found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets"))), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null or empty text is one piece of the end id. An empty table gives none."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{common.shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = _written(docs)
    return docs
