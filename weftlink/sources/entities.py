"""Record-linkage sources out of the ``documents`` table.

Documents are dealt to S1, S2 and S3 by id; a document's first line is its name, the
second its address (led by its length, which gives it digits), its language the country.
S1 rows match S2 and S3 rows of equal text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    one, two = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(2))
    return docs.select(
        F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), F.substring(one, 1, 60).alias("business_name"),
        F.when(two == "", "").otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(" "), F.substring(two, 1, 80))).alias("business_address"),
        F.col("lang").alias("country"), F.md5(F.col("text").cast("binary")).alias("content"),
    )


def edges(e: DataFrame) -> DataFrame:
    """(s1_id, target_id, target_source): pairs of equal content."""
    one = e.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "content")
    other = e.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), "content")
    return one.join(other, "content").select("s1_id", "target_id", "target_source")


def truth_file(e: DataFrame) -> DataFrame:
    """The ground truth as its file has it: one row for each S1, targets in a comma list."""
    lists = edges(e).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("matched_entity_ids"))
    return e.filter("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))
